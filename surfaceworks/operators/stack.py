"""The stack calculator: totals of chosen servers under each client mode, shares, exclusions, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import figures
from ..functions.figures import MODELS
from ..stash import held


def chosen(stacks: DataFrame, servers: DataFrame) -> DataFrame:
    """Stacks (stack, server, place) with the servers' status, total and n_tools; unknown servers go.

    Rows are dealt by stack here, before the modes treble them, and into a fixed number of parts, as many as the session's
    shuffles have: small in bytes, they would be put together into few tasks with many stacks each.
    """
    return stacks.join(servers, "server").repartition(int(stacks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stack")


def by_mode(rows: DataFrame, run_date: str, model: str = MODELS[0]) -> DataFrame:
    """Each row under the three modes: tokens, low and high, and why it is excluded, if it is.

    ``total`` holds the tokens of ``model``; n_tools may be null. Always all three modes.
    """
    mean = figures.mean_tokens(F.col("total"), F.col("n_tools"))
    search = lambda k: F.when(F.col("total").isNotNull(), figures.search_tokens(mean, k)).cast("long")
    naive, code = F.col("total"), F.when(F.col("total").isNotNull(), figures.code_tokens(F.col("total")))
    mode = lambda m, a, b, c, why: F.struct(F.lit(m).alias("mode"), a.alias("tokens"), b.alias("low"), c.alias("high"), F.lit(why).alias("why"))
    each = F.explode(F.array(
        mode("naive", naive, naive, naive, C.NO_MEASUREMENT % figures.MODEL_LABELS[model]),
        mode("tool_search", search(C.MIDDLE_K), search(C.K_RANGE[0]), search(C.K_RANGE[1]), C.NO_SEARCH_MODEL), mode("code_mode", code, code, code, C.NO_CODE_MODEL),
    ))
    reason = F.when(F.col("status") != "ok", F.format_string(C.NO_DATA, F.col("status"), F.lit(run_date))).when(F.col("m.tokens").isNull(), F.col("m.why"))
    return rows.select("*", each.alias("m")).withColumn("reason", reason).select("*", "m.*").drop("m", "why")


def totals(moded: DataFrame) -> DataFrame:
    """(stack, mode, kind, servers, excluded, total, low, high, window_percent): null totals, never 0, if nothing counts."""
    ok = F.col("reason").isNull()
    out = moded.groupBy("stack", "mode").agg(
        F.count_if(ok).alias("servers"), F.count_if(~ok).alias("excluded"), *[F.sum(F.when(ok, F.col(c))).alias(n) for c, n in (("tokens", "total"), ("low", "low"), ("high", "high"))]
    )
    return out.select("stack", "mode", figures.kind_of(F.col("mode")).alias("kind"), "servers", "excluded", "total", "low", "high", figures.window_share(F.col("total")).alias("window_percent"))


def attribution(moded: DataFrame) -> DataFrame:
    """(stack, mode, server, tokens, fraction, bar, place): place 1 is the largest of its stack, of equals the smaller server.

    bar is the share of the largest, at least of 1 token.
    """
    rows = moded.where("reason is null")
    whole = Window.partitionBy("stack", "mode")
    total = F.sum("tokens").over(whole)
    bar = F.col("tokens") / F.greatest(F.max("tokens").over(whole), F.lit(1))
    place = F.row_number().over(whole.orderBy(F.desc("tokens"), "server")).cast("long")
    return rows.select("stack", "mode", "server", "tokens", F.when(total == 0, F.lit(0.0)).otherwise(F.col("tokens") / total).alias("fraction"), bar.alias("bar"), place.alias("place"))


def priced(totals_: DataFrame, prices: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Totals under each of ``models``: cold and cached-read dollars, whether the prefix can be cached, and pricing_unavailable.

    ``prices``: model, price, write, read, least; a model that isn't among them has null dollars.
    """
    rows = totals_.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    rows = rows.join(prices.withColumn("known", F.lit(True)), "model", "left")
    t = F.col("total")
    return rows.select(
        "stack", "mode", "model", "total", figures.cold_dollars(t, F.col("price"), F.col("write")).alias("cold"), figures.read_dollars(t, F.col("price"), F.col("read")).alias("cached"),
        F.when(F.col("known"), figures.cacheable(t, F.col("least"))).alias("achievable"), F.col("known").isNull().alias("pricing_unavailable"),
    )


def measured(chosen_: DataFrame, published: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen servers (stack, server) with their published call traffic, and those that have none; never summed into a total."""
    return chosen_.join(published, "server"), chosen_.join(published.select("server").distinct(), "server", "left_anti")


def availability(servers: DataFrame) -> DataFrame:
    """(model, available): whether any server is measured for each model (columns of the same names); the local tokenizer always is."""
    any_of = servers.agg(*[F.coalesce(F.bool_or(F.col(m).isNotNull()), F.lit(False)).alias(m) for m in MODELS[1:]])
    each = F.explode(F.array(F.struct(F.lit(MODELS[0]).alias("model"), F.lit(True).alias("available")), *[F.struct(F.lit(m).alias("model"), F.col(m).alias("available")) for m in MODELS[1:]]))
    return any_of.select(each.alias("x")).select("x.*")


def status_label(status: Column, run_date: Column) -> Column:
    return F.when(status != "ok", F.format_string(C.NO_DATA, status, run_date))


def leaderboard_columns(rows: DataFrame) -> DataFrame:
    """Adds data_ok, naive and per_tool to rows (status, available, total, tool_count)."""
    ok = (F.col("status") == "ok") & F.coalesce("available", F.lit(True))
    rows = rows.withColumn("data_ok", F.coalesce(ok, F.lit(False))).withColumn("naive", F.when(F.col("data_ok"), F.col("total")))
    return rows.withColumn("per_tool", F.when(F.col("tool_count") > 0, figures.js_round(F.col("naive") / F.col("tool_count")).cast("long")))


def failures(rows: DataFrame) -> DataFrame:
    """(status, n) of the rows that are not ok."""
    return rows.where("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n"))


def with_place(rows: DataFrame, keys: list[Column], place: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in the order of ``keys``, which must tell all rows apart. Runs a job.

    A range sort and the sizes of its parts, one number for each, give the places: no task sees all rows.
    """
    spark = rows.sparkSession
    named = rows.select("*", *[k.alias(f"_by{i}") for i, k in enumerate(keys)])
    by = [f"_by{i}" for i in range(len(keys))]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = held(named.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    sizes = sorted(ordered.groupBy("_part").count().collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    starts = spark.createDataFrame(starts, "_part int, _start long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return ordered.join(F.broadcast(starts), "_part").withColumn(place, F.col("_start") + within).drop("_part", "_start", *by)


def leaderboard(rows: DataFrame, key: str, ascending: bool = False) -> DataFrame:
    """Adds place: rows with data first, then by the number ``key`` with nulls last in both directions, then by server. Runs a job."""
    value = F.col(key) if ascending else -F.col(key)
    return with_place(rows, [~F.col("data_ok"), F.col(key).isNull(), value, F.col("server")])


def tool_call_gap(served: DataFrame, client: DataFrame, wire: DataFrame) -> DataFrame:
    """(server, gap): sum of the positive differences of calls that clients report and the wire shows, over served tools.

    Clients may name a tool by itself or with a prefix of its server; a server that serves nothing is not in it.
    """
    own = served.select("server", "tool", F.concat_ws("_", F.lit("mcp"), "server", "tool").alias("long"))
    bare = client.groupBy("server", F.col("name").alias("tool")).agg(F.sum("calls").alias("bare"))
    long = client.groupBy("server", F.col("name").alias("long")).agg(F.sum("calls").alias("prefixed"))
    seen = wire.groupBy("server", "tool").agg(F.sum("calls").alias("seen"))
    rows = own.join(bare, ["server", "tool"], "left").join(long, ["server", "long"], "left").join(seen, ["server", "tool"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.groupBy("server").agg(F.sum(F.greatest(zero("bare") + zero("prefixed") - zero("seen"), F.lit(0))).alias("gap"))
