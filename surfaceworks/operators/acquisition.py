"""How each corpus entry would be reached, with which credential, and what it resolved to: pure expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import figures, text

SCRATCH = "{{SCRATCH}}"
LISTING = "struct<prefix:string,packages:array<array<string>>>"


def launches(corpus: DataFrame, scratch: str) -> DataFrame:
    """(id, transport, source, command, args, recorded, pinned, endpoint, deps, error) of corpus entries; a package beats an endpoint.

    recorded holds the arguments as the corpus has them, args those with the scratch folder filled
    in. deps is struct<method, sdk, note>: how what a launch resolves is to be listed, or why it isn't.
    """
    p, none = F.col("package")["stdio"], F.array().cast("array<string>")
    own, wanted = F.coalesce(p["args"], none), F.coalesce(p["with"], none)
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    spec = lambda sep: F.concat(p["name"], F.when(filled(p["version"]), F.concat(F.lit(sep), p["version"])).otherwise(""))
    deps = lambda method, sdk=None: F.struct(F.lit(method).alias("method"), F.lit(sdk).cast("string").alias("sdk"), F.lit(C.DEPS_NOTES.get(method)).cast("string").alias("note"))
    plan = lambda source, command, args, pinned, how: F.struct(source.alias("source"), command.alias("command"), args.alias("args"), pinned.alias("pinned"), how.alias("deps"))
    with_args = F.flatten(F.transform(wanted, lambda w: F.array(F.lit("--with"), w)))
    with_text = F.concat(F.lit("pypi:"), spec("=="), F.array_join(F.transform(wanted, lambda w: F.concat(F.lit(" --with "), w)), ""))
    image_args = F.concat(F.array(*map(F.lit, ("run", "--rm", "-i")), p["image"]), own)
    stdio = (
        F.when((p["type"] == "npm") & filled(p["name"]), plan(F.concat(F.lit("npm:"), spec("@")), F.lit("npx"), F.concat(F.array(F.lit("-y"), spec("@")), own), filled(p["version"]), deps(C.BY_NPX, C.NPM_SDK)))
        .when(p["type"].isin("pypi", "uv", "uvx") & filled(p["name"]), plan(with_text, F.lit("uvx"), F.concat(with_args, F.array(spec("==")), own), filled(p["version"]), deps(C.BY_UVX, C.PYPI_SDK)))
        .when((p["type"] == "docker") & filled(p["image"]), plan(F.concat(F.lit("docker:"), p["image"]), F.lit("docker"), image_args, F.contains(p["image"], F.lit("@sha256:")), deps(C.BY_IMAGE)))
        .when((p["type"] == "binary") & filled(p["command"]), plan(F.concat(F.lit("binary:"), p["command"]), p["command"], own, filled(p["version"]), deps(C.NOT_LISTED + "/binary")))
    )
    remote = filled(F.col("endpoint")) & (declares("remote") | (F.size(F.coalesce("transport", none)) == 0))
    out = corpus.withColumn("s", stdio)
    found = F.col("s").isNotNull()
    error = F.when(found | remote, None).when(declares("sse") & ~declares("remote") & ~declares("stdio"), C.ONLY_SSE).otherwise(C.NO_LAUNCH)
    how = F.when(found, F.col("s.deps")).when(remote, deps(C.NOT_LISTED + "/remote"))
    how = F.when(how.isNotNull(), F.struct(F.split_part(how["method"], F.lit("/"), F.lit(1)).alias("method"), how["sdk"].alias("sdk"), how["note"].alias("note")))
    return out.select(
        "id", F.when(found, "stdio").when(remote, "remote").alias("transport"), F.when(found, F.col("s.source")).when(remote, F.concat(F.lit("endpoint:"), "endpoint")).alias("source"),
        "s.command", F.transform("s.args", lambda a: F.replace(a, F.lit(SCRATCH), F.lit(scratch))).alias("args"), F.col("s.args").alias("recorded"), "s.pinned",
        F.when(~found & remote, F.col("endpoint")).alias("endpoint"), how.alias("deps"), error.alias("error"),
    )


def declares(transport: str) -> Column:
    return F.array_contains(F.coalesce("transport", F.array().cast("array<string>")), transport)


def credentials(corpus: DataFrame, environment: dict[str, str]) -> DataFrame:
    """(id, token_env, present, error): whether an entry's credential is set; the environment holds names only as keys here."""
    required, name = F.coalesce(F.col("auth.required"), F.lit(True)), F.nullif("auth.token_env", F.lit(""))
    present = F.coalesce(name.isin(*[k for k, v in environment.items() if v] or [""]), F.lit(False))
    error = F.when(required & name.isNull(), C.NO_VARIABLE).when(required & ~present, F.format_string(C.UNSET_VARIABLE, name))
    return corpus.select("id", name.alias("token_env"), present.alias("present"), error.alias("error"))


def inherited(environment: Column) -> Column:
    """Of a map of variables those that a launch inherits: none holds a secret."""
    return F.map_filter(environment, lambda k, _: k.isin(*C.INHERITED))


def acquisitions(launches_: DataFrame, credentials_: DataFrame, resolved: DataFrame, acquired_at: str) -> DataFrame:
    """(id, acquisition): the record of each launch, with the names (never values) of the variables passed and what was resolved.

    ``resolved``: (id, listed struct<prefix, packages, error>) as ``dependency_listing`` gives it; one
    that failed is recorded with its error and fails nothing else.
    """
    rows = launches_.where("error is null").join(credentials_.select("id", "token_env", "present"), "id", "left").join(resolved, "id", "left")
    passed = F.when(F.col("present"), F.array("token_env")).otherwise(F.array().cast("array<string>"))
    sdk = find_package(F.col("listed.packages"), F.coalesce("deps.sdk", F.lit("")))
    deps = F.struct("deps.method", "deps.note", F.col("listed.prefix").alias("env"), "listed.packages", sdk.alias("sdk"), "listed.error")
    record = F.struct("transport", "source", "command", F.col("recorded").alias("args"), "endpoint", passed.alias("env_passed"), "pinned", F.lit(acquired_at).alias("acquired_at"), deps.alias("resolved_deps"))
    return rows.select("id", record.alias("acquisition"))


def dependency_listing(stdout: Column) -> Column:
    """struct<prefix, packages, error> of the last line that is a listing; a malformed pair is an error."""
    whole = F.split(F.coalesce(stdout, F.lit("")), "\n", -1)
    lines = F.filter(F.transform(whole, F.trim), lambda x: F.startswith(x, F.lit("{")))
    parsed = F.filter(F.transform(lines, lambda x: F.from_json(x, LISTING)), lambda l: (F.coalesce(l["prefix"], F.lit("")) != "") | l["packages"].isNotNull())
    last = F.try_element_at(parsed, F.lit(-1))
    pairs = F.coalesce(last["packages"], F.array().cast("array<array<string>>"))
    odd = lambda p: (F.size(p) != 2) | F.exists(p, lambda x: x.isNull() | (x == ""))
    worst = F.array_join(F.get(F.filter(pairs, odd), 0), " ", "")
    error = F.when(last.isNull(), F.format_string(C.NO_LISTING, F.size(whole))).when(F.exists(pairs, odd), F.format_string(C.BAD_LISTING, worst))
    named = F.transform(pairs, lambda p: F.struct(F.get(p, 0).alias("name"), F.get(p, 1).alias("version")))
    return F.struct(last["prefix"].alias("prefix"), F.when(error.isNull(), named).alias("packages"), error.alias("error"))


def find_package(packages: Column, name: Column) -> Column:
    """The first package whose normalised name is that of ``name``, or null."""
    return F.get(F.filter(packages, lambda p: (name != "") & (text.package_name(p["name"]) == text.package_name(name))), 0)


def resolved_model(usage: Column, pinned: Column) -> Column:
    """The model with most output tokens of a map<model, tokens> (null counts as 0, of equals the last), else the pinned one."""
    entries = F.transform(F.map_entries(usage), lambda e, i: F.struct(F.coalesce(e["value"], F.lit(0)).alias("n"), i.alias("i"), e["key"].alias("model")))
    return F.coalesce(F.array_max(entries)["model"], pinned)


def rendered(template: Column, trial_id: Column, port: Column, output_dir: Column) -> Column:
    """A prompt with its placeholders filled."""
    for mark, value in (("{trial_id}", trial_id), ("{port}", port.cast("string")), ("{output_dir}", output_dir)):
        template = F.replace(template, F.lit(mark), value)
    return template


def normal_path(path: Column, wanted: str) -> Column:
    """A path without blanks, one layer of quotes, a final comma or full stop and a leading ./; an absolute spelling of ``wanted`` becomes it."""
    p = F.regexp_replace(text.stripped(path), "^[`\"']", "")
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "[`\"']$", ""), "[.,]$", ""), r"^\./", "")
    return F.when(F.endswith(p, F.lit("/" + wanted)), F.lit(wanted)).otherwise(p)


def normal_count(count: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(text.stripped(count), "^[`\"']", ""), "[`\"']$", ""), F.lit(","), F.lit(""))


def succeeded(transcript: Column, state: Column, trial_id: Column, check: Column) -> Column:
    """Whether a trial passed. ``check``: struct<kind, needles>.

    contains: the transcript holds every needle; equals: the state is the first needle; path_count:
    the state is a path and a count, compared in their normal forms. {trial_id} in needles is filled.
    """
    needles = F.transform(check["needles"], lambda n: F.replace(n, F.lit("{trial_id}"), trial_id))
    lines = F.split(F.regexp_replace(F.replace(F.coalesce(state, F.lit("")), F.lit("\r"), F.lit("")), r"\s+$", ""), "\n")
    two = (F.size(lines) == 2) & (normal_path(F.get(lines, 0), "logs/access.log") == F.get(needles, 0)) & (normal_count(F.get(lines, 1)) == F.get(needles, 1))
    held = F.forall(needles, lambda n: F.contains(F.coalesce(transcript, F.lit("")), n))
    return F.coalesce(F.when(check["kind"] == "contains", held).when(check["kind"] == "equals", state == F.get(needles, 0)).when(check["kind"] == "path_count", two), F.lit(False))


def extra_paths(found: DataFrame, known: DataFrame, key: tuple[str, ...] = ("path",)) -> DataFrame:
    """Paths found more often than they are known (key and times), as often as that; each with the key's columns."""
    n = found.groupBy(*key).agg(F.count("*").alias("n_found"))
    over = n.join(known.groupBy(*key).agg(F.sum("times").alias("n_known")), list(key), "left").withColumn("over", F.col("n_found") - F.coalesce("n_known", F.lit(0))).where("over > 0")
    return over.select(*key, F.explode(F.array_repeat(F.lit(0), F.col("over").cast("int"))).alias("_i")).select(*key)


def swept(entries: DataFrame, measure) -> DataFrame:
    """(id, status, error, payload) of entries (id, ...): what ``measure(row) -> text`` gives for each, or how it failed.

    A failure is a row, never a stop: an exception is the status of its entry, by ``failure_class``
    of its text, and the others go on. ``measure`` runs where the rows are, one row at a time, as it
    waits for a server; entries are few and dealt one to a task.
    """
    names = entries.columns

    def run(batches):
        for batch in batches:
            out = []
            for values in zip(*[batch[c] for c in names], strict=True):
                row = dict(zip(names, values, strict=True))
                try:
                    out.append((row["id"], None, measure(row)))
                except Exception as e:
                    out.append((row["id"], f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(out, columns=["id", "error", "payload"])

    rows = entries.repartition(F.col("id")).mapInPandas(run, f"id {entries.schema['id'].dataType.simpleString()}, error string, payload string")
    return rows.select("id", figures.failure_class(F.col("error")).alias("status"), "error", "payload")


def row_status(error_class: Column, tools: Column, excluded: Column, partial: Column) -> Column:
    """Status of a server's row: its failure, a surface without usable tools, an enumeration that broke off, or ok."""
    return F.when(error_class != "ok", error_class).when((tools > 0) & (tools == excluded), "schema_invalid").when(partial, "partial_surface").otherwise("ok")


def gated(rows: DataFrame) -> DataFrame:
    """Rows of servers (status, counted, total, total_error, per_tool map<string, long>, per_tool_errors, scores) with what may be published.

    Scores only of a surface with counted tools; tokens and modes only if the total and every tool
    were counted: a partial count is withheld whole, never published as a smaller one.
    """
    complete = F.coalesce((F.col("status") == "ok") & F.col("total_error").isNull() & (F.coalesce("per_tool_errors", F.lit(0)) == 0) & F.col("total").isNotNull(), F.lit(False))
    whole = lambda c: F.when(complete, F.col(c)).alias(c)
    keep = [F.col(c) for c in rows.columns if c not in ("total", "per_tool", "scores")]
    scored = F.when((F.col("status") == "ok") & (F.col("counted") > 0), F.col("scores")).alias("scores")
    modes = F.when(complete, figures.modes(F.col("total"), F.size(F.map_keys("per_tool")).cast("long"))).alias("modes")
    return rows.select(*keep, complete.alias("available"), whole("total"), whole("per_tool"), scored, modes)


def per_tool(counts: DataFrame) -> DataFrame:
    """(server, per_tool, per_tool_errors) of tool counts (server, tool, name, tokens, error): the map is null if any tool failed."""
    out = counts.groupBy("server").agg(F.count_if(F.col("error").isNotNull() | F.col("tokens").isNull()).alias("per_tool_errors"), F.map_from_entries(F.collect_list(F.struct("name", "tokens"))).alias("m"))
    return out.select("server", F.when(F.col("per_tool_errors") == 0, F.col("m")).alias("per_tool"), "per_tool_errors")


def published(rows: DataFrame, operator_abort: bool) -> tuple[DataFrame, bool]:
    """Rows without those that an operator's abort broke off, and whether the run is marked aborted."""
    return (rows.where("status <> 'aborted'"), True) if operator_abort else (rows, False)


def stamped(cells: DataFrame, model: str, encoding: str, measured_at: str) -> DataFrame:
    """Cells with model and encoding, and the time of measurement where there is a measurement."""
    return cells.withColumn("model", F.lit(model)).withColumn("encoding", F.lit(encoding)).withColumn("measured_at", F.when(F.col("available"), F.lit(measured_at)))


#: The stamps that every published number carries.
STAMPS = ("model", "tokenizer", "measured_at", "protocol_revision", "server_version", "tools_list_sha256", "methodology_version", "harness_version")


def releasable(cells: DataFrame, stamps: tuple[str, ...] = STAMPS) -> DataFrame:
    """An extension: cells that carry every stamp."""
    whole = F.lit(True)
    for s in stamps:
        whole = whole & (F.coalesce(F.col(s).cast("string"), F.lit("")) != "")
    return cells.where(whole)


def removals(runs: DataFrame, last_change: DataFrame, today: str) -> DataFrame:
    """An extension: (id, reason) of servers unreachable in their last two runs (id, run_date, status), or without change (id, changed_at) for 12 months."""
    order = Window.partitionBy("id").orderBy(F.desc("run_date"))
    last = runs.withColumn("k", F.row_number().over(order)).where("k <= 2").groupBy("id").agg(F.count_if(F.col("status") == "unreachable").alias("n"))
    gone = last.where("n = 2").select("id", F.lit("unreachable in two runs").alias("reason"))
    old = last_change.where(F.add_months(F.to_date("changed_at"), 12) <= F.to_date(F.lit(today))).select("id", F.lit("abandoned").alias("reason"))
    return gone.unionByName(old)


def slots(candidates: DataFrame, slots_: int = 15, most: int = 5) -> DataFrame:
    """An extension: candidates (id, category, official, installs, overlap, stars) that get a slot: at most ``most`` of a category, every category one first.

    Within a category official maintainers come first, then installs, overlap and stars.
    """
    rank = Window.partitionBy("category").orderBy(F.desc("official"), F.desc_nulls_last("installs"), F.desc_nulls_last("overlap"), F.desc_nulls_last("stars"), "id")
    rows = candidates.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)
    return rows.orderBy(F.when(F.col("rank") == 1, 0).otherwise(1), F.desc("official"), F.desc_nulls_last("installs"), F.desc_nulls_last("overlap"), F.desc_nulls_last("stars"), "id").limit(slots_)


def native_tools(name: Column, description: Column, input_schema: Column) -> Column:
    """struct<name, description, input_schema> as a hosted counter takes a tool; a tool without a schema has an empty object's."""
    return F.struct(name.alias("name"), description.alias("description"), F.when(F.coalesce(input_schema, F.lit("")) != "", input_schema).otherwise(C.EMPTY_SCHEMA).alias("input_schema"))


def metric_inputs(tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What retrieval and hygiene are computed over: the counted tools, each with the one descriptor that the surface carries."""
    counted = tools.where("error is null and not excluded").withColumn("descriptor", text.descriptor(F.col("name"), F.col("title"), F.col("description")))
    return counted.select("server", "tool", "name", "title", "description", "descriptor"), counted.select("server", "tool", "name", "title", "description", "descriptor", "input_schema")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """An extension: (id, change) between two runs (id, canonical_sorted_sha256, tokenizer, harness_version, total)."""
    a = before.select("id", *[F.col(c).alias(f"{c}_0") for c in ("canonical_sorted_sha256", "tokenizer", "harness_version", "total")])
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"{c}_0"))
    what = F.when(differs("canonical_sorted_sha256"), "server changed").when(differs("total") & differs("tokenizer"), "tokenizer changed").when(differs("total") & differs("harness_version"), "harness changed").when(differs("total"), "unexplained")
    return after.join(a, "id").select("id", F.coalesce(what, F.lit("unchanged")).alias("change"))
