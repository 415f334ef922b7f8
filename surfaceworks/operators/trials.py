"""Roll-up of trials: the last row of each, classes, cells with exact distributions, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TASK_SERVERS, TRANSCRIPT_TASKS
from ..functions import figures
from .medians import MOST_ROWS, medians

KEY = ("suite_version", "server", "client", "task", "trial")
CELL = ("suite_version", "server", "client", "task")


def last_of_each(trials: DataFrame, key=KEY, order: str = "line_no") -> DataFrame:
    """The last row, in the order of the file, of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return trials.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def cells(trials: DataFrame, measures: tuple[str, ...], key=CELL, most_rows: int = MOST_ROWS) -> DataFrame:
    """Per cell trials, successes, failures, and of each measure what isn't null: _n, _median (exact, whatever the cell's size), _min, _max. Runs jobs."""
    success = F.coalesce(F.col("success"), F.lit(False))
    spread = [x for m in measures for x in (F.count(m).alias(f"{m}_n"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"))]
    counts = [F.count("*").alias("trials"), F.count_if(success).alias("successes"), F.count_if(~success).alias("failures")]
    if (trials.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= most_rows:
        out = trials.groupBy(*key).agg(*counts, *spread, *[F.median(m).alias(f"{m}_median") for m in measures])
    else:
        out = trials.groupBy(*key).agg(*counts, *spread)
        for m in measures:
            middle = medians(trials, list(key), m, most_rows).select(*[F.col(k).alias(f"of_{k}") for k in key], F.col("median").alias(f"{m}_median"))
            same = F.lit(True)
            for k in key:
                same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
            out = out.join(middle, same, "left").drop(*[f"of_{k}" for k in key])
    return out.select(*key, "trials", "successes", "failures", *[f"{m}_{c}" for m in measures for c in ("n", "median", "min", "max")])


def client_reported_error(valid: Column, client: Column, error: Column) -> Column:
    """Whether the client itself reported a failure: no valid output, or for one client an error in it."""
    return ~valid.eqNullSafe(F.lit(True)) | F.coalesce((client == "gemini") & error.isNotNull(), F.lit(False))


def reclassified(trials: DataFrame) -> DataFrame:
    """Trials (success, client_json_valid, client, client_error_text, tool_calls, refusal_markers, classification) classed anew from what was recorded.

    The class that a row came with is kept as recorded_classification; adds client_reported_error.
    """
    failed = client_reported_error(F.col("client_json_valid"), F.col("client"), F.col("client_error_text"))
    refused = F.size(F.coalesce("refusal_markers", F.array().cast("array<string>"))) > 0
    now = figures.trial_class(F.coalesce("success", F.lit(False)), failed, F.coalesce("tool_calls", F.lit(0)), refused)
    rows = trials.withColumnRenamed("classification", "recorded_classification") if "classification" in trials.columns else trials
    return rows.withColumn("client_reported_error", failed).withColumn("classification", now)


#: Of a cell's first trial in the order of the suite.
FIRST = ("model", "resolved_model", "check_kind", "server_image_digest")


def rollup(trials: DataFrame, measures: tuple[str, ...], key=CELL, first: tuple[str, ...] = FIRST, series: tuple[str, ...] = (), unions_of: tuple[str, ...] = ()) -> DataFrame:
    """One row per cell of trials (``last_of_each`` of them), as a summary holds it.

    The fields of ``first`` come from the cell's first trial by suite_seq, then trial. Each measure
    becomes struct<n, median, min, max, values> of what isn't null, the values in that order too;
    ``unions_of`` are array columns, of which the sorted distinct members stay; ``series`` are the
    columns of per_trial. classifications maps the classes that occur to their counts. A cell is a
    handful of trials, so its rows fit in one array.
    """
    place = F.struct("suite_seq", "trial")
    is_true = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    not_true = lambda c: F.count_if(~F.coalesce(F.col(c), F.lit(False)))
    held = lambda c: F.count_if(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0)
    counts = [
        F.count("*").alias("trials"), is_true("success").alias("successes"), not_true("success").alias("failures"), is_true("timed_out").alias("timed_out_trials"), not_true("client_json_valid").alias("client_json_invalid_trials"),
        is_true("client_reported_error").alias("client_reported_error_trials"), F.count_if(F.coalesce("permission_denials", F.lit(0)) > 0).alias("permission_denial_trials"),
        held("fixture_extra_paths").alias("fixture_extra_path_trials"), is_true("harness_suspect").alias("harness_suspect_trials"),
    ]

    def spread(c: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("suite_seq", "trial", F.col(c).alias("v")))))
        return F.struct(F.count(c).alias("n"), F.median(c).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"), F.transform(ordered, lambda x: x["v"]).alias("values")).alias(c)

    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c)
    classes = F.array_sort(F.collect_list("classification"))
    kinds = F.transform(F.array_distinct(classes), lambda k: F.struct(k.alias("key"), F.size(F.filter(classes, lambda x: x == k)).alias("value")))
    more = [F.array_sort(F.collect_list(F.struct("suite_seq", "trial", *[c for c in series if c not in ("suite_seq", "trial")]))).alias("per_trial")] if series else []
    return trials.groupBy(*key).agg(
        *[F.min_by(c, place).alias(c) for c in first], *counts, F.map_from_entries(kinds).alias("classifications"), *[spread(c) for c in measures], *[joined(c) for c in unions_of], *more
    )


def flags(trials: DataFrame, footers: DataFrame, key=KEY) -> DataFrame:
    """One row of all trials, superseded ones too, and footers: superseded_trial_rows, suite_versions, mixed_suite_versions, version_drift, drifted_runs."""
    each = trials.groupBy(*key).agg(F.count("*").alias("n"))  # one row for each trial goes on
    seen = each.agg((F.sum("n") - F.count("*")).alias("superseded_trial_rows"), F.array_sort(F.collect_set("suite_version")).alias("suite_versions"))
    drift = footers.agg(F.coalesce(F.bool_or("version_drift"), F.lit(False)).alias("version_drift"), F.array_sort(F.collect_list(F.when(F.col("version_drift"), F.col("run_id")))).alias("drifted_runs"))
    out = seen.crossJoin(drift)  # one row each
    return out.select(F.coalesce("superseded_trial_rows", F.lit(0)).alias("superseded_trial_rows"), "suite_versions", (F.size("suite_versions") > 1).alias("mixed_suite_versions"), "version_drift", "drifted_runs")


def drifted(start_versions: Column, end_versions: Column, start_digest: Column, end_digest: Column) -> Column:
    """Whether a client or a server's image changed during a run."""
    return ~start_versions.eqNullSafe(end_versions) | ~F.coalesce(start_digest, F.lit("")).eqNullSafe(F.coalesce(end_digest, F.lit("")))


def check_kind(task: Column) -> Column:
    """What a task's success is read from."""
    return F.when(task.isin(*TRANSCRIPT_TASKS), "transcript").otherwise("state")


def server_of_task(task: Column) -> Column:
    prefix = F.split_part(task, F.lit("-"), F.lit(1))
    out = F.lit(None).cast("string")
    for mark, server in TASK_SERVERS.items():
        out = F.when(prefix == mark, server).otherwise(out)
    return out


def selected(wanted: DataFrame, suite: DataFrame) -> DataFrame:
    """(server, task, error) of wanted tasks: one of another server, or one that the suite hasn't, is an error."""
    known = suite.select("server", "task").distinct().withColumn("known", F.lit(True))
    error = F.when(~server_of_task(F.col("task")).eqNullSafe(F.col("server")), F.format_string("task %s does not belong to server %s", "task", "server")).when(F.col("known").isNull(), F.format_string("unknown task: %s", "task"))
    return wanted.join(known, ["server", "task"], "left").select("server", "task", error.alias("error"))


def models_used(usage: Column) -> Column:
    """array<struct<model, input_tokens, output_tokens, cost_usd>> of a map<model, struct<input_tokens, output_tokens, cost_usd>>, in its order."""
    entry = lambda e: F.struct(e["key"].alias("model"), *[e["value"][c].alias(c) for c in ("input_tokens", "output_tokens", "cost_usd")])
    return F.coalesce(F.transform(F.map_entries(usage), entry), F.array().cast("array<struct<model:string,input_tokens:bigint,output_tokens:bigint,cost_usd:double>>"))


def model_sums(usage: Column, fields: tuple[str, ...] = ("cached", "prompt", "candidates", "total")) -> Column:
    """struct of the sums over a map<model, struct<...>> of token figures; what a model lacks counts as 0 here, as no model at all does."""
    total = lambda c: F.coalesce(F.aggregate(F.map_values(usage), F.lit(0).cast("long"), lambda a, m: a + F.coalesce(m[c], F.lit(0))), F.lit(0)).cast("long").alias(c)
    return F.struct(*map(total, fields))


def class_counts(trials: DataFrame, key=CELL) -> DataFrame:
    return trials.groupBy(*key, "classification").agg(F.count("*").alias("n"))


def totals(trials: DataFrame, server: str = "server", client: str = "client") -> DataFrame:
    """(level, server, client, trials, successes): all, by server, by client, in one pass."""
    out = trials.groupingSets([[], [F.col(server)], [F.col(client)]], F.col(server), F.col(client)).agg(
        F.when((F.grouping(server) == 1) & (F.grouping(client) == 1), "all").when(F.grouping(client) == 1, "by_server").otherwise("by_client").alias("level"),
        F.count("*").alias("trials"), F.count_if(F.coalesce(F.col("success"), F.lit(False))).alias("successes"),
    )
    return out.select("level", F.col(server).alias("server"), F.col(client).alias("client"), "trials", "successes")


def runs(headers: DataFrame, footers: DataFrame) -> DataFrame:
    """Headers with the last footer of their run, or nulls."""
    last = last_of_each(footers, ("run_id",))
    return headers.join(last.drop("line_no"), "run_id", "left")


def to_do(planned: DataFrame, done: DataFrame, key=KEY, force: bool = False) -> DataFrame:
    """What is planned and not done; all of it with ``force``."""
    if force:
        return planned
    return planned.join(done.select(*key).distinct(), list(key), "left_anti")


def matrix(tasks: DataFrame, n: int) -> DataFrame:
    """Every task (at most a few thousand) with each trial number."""
    return tasks.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(n))))


def unions(trials: DataFrame, column: str, key=CELL) -> DataFrame:
    """Sorted distinct members of an array column in each cell."""
    return trials.select(*key, F.explode(column).alias("x")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias(column))


def merged(state: DataFrame | None, batch: DataFrame, key=KEY, order: str = "line_no") -> DataFrame:
    """The trials that count after a batch: the last of each, whichever batch it came with. ``state`` is what came out before.

    Batches may come in any order and more than once; a trial that a later line supersedes leaves the state.
    """
    return last_of_each(batch if state is None else state.unionByName(batch), key, order)


def refreshed(cells_: DataFrame | None, state: DataFrame, batch: DataFrame, roll, key=CELL) -> DataFrame:
    """Cells after a batch: those that it touches rolled up anew by ``roll(trials)`` from the state, the others as they were.

    ``state`` is what ``merged`` gave for the batch. Work follows the cells that a batch touches, not all trials.
    """
    touched = batch.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()

    def same(rows: DataFrame):
        out = F.lit(True)
        for k in key:
            out = out & rows[k].eqNullSafe(touched[f"_{k}"])
        return out

    fresh = roll(state.join(touched, same(state), "left_semi"))
    return fresh if cells_ is None else cells_.join(touched, same(cells_), "left_anti").unionByName(fresh)
