"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with built-in functions only.

Every document gets the key -ln(u) / quality, where u is a hash of its id in (0, 1): in ascending
order of it, documents are a weighted sample without replacement. A source's target is taken in
that order: complete epochs of the whole source first, then documents by key until the running sum
of their sizes meets what is left; the document across which it falls gives its first words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, Stash

#: Sources in ascending order take these weights in turn.
WEIGHTS = (5.0, 2.0, 1.0)
#: What all sources share, in times all sizes; the most a source gives, in times its own size.
SHARE, MOST_EPOCHS = 1.5, 2.0
#: About so many documents of a source are sorted in one task.
BUCKET_ROWS = 2_000
#: Qualities are told apart by so many steps for each doubling, and as many doublings at most in all, for cutting buckets.
LEVELS, MOST_LEVEL = 8, 128
SEED = "mix-1"


def words(text: Column) -> Column:
    """Words in a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*of: Column) -> Column:
    """A number in (0, 1) with 52 random bits that depends on the columns alone."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(c.cast("string"), F.lit("null")) for c in of])), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def fingerprint(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def letter_share(text: Column) -> Column:
    """Quality weight of a text: the share of its characters that are letters or white space, from 0.05 to 1."""
    odd = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{L}\s]+", ""))
    n = F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - odd / n)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """To (source, source_size, ...) adds target, the fixed point of sharing by weight under the caps.

    One row per source. A source that reaches its cap does so before all with a larger cap per
    weight, so the capped ones are a prefix in that order and running sums find the level at which
    the others meet the total.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    out = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(whole)
    left = total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    free = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    out = out.withColumn("level", left / free)
    # the first source in this order whose cap is above the level, and all behind it, share by weight
    out = out.withColumn("place", F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last())))
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(whole)
    return out.withColumn("at", level["level"]).select(
        *sizes.columns, F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("at"))).alias("target")
    )


def bucketed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS,
) -> DataFrame:
    """Documents with key, size, what their source is to give, and the bucket of their key among its source's. Runs jobs."""
    spark = docs.sparkSession
    text = F.col(text_col)
    weight = letter_share(text) if quality is None else quality
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text).alias("size"),
        fingerprint(text).alias("print"), weight.cast("double").alias("weight"), (-F.log(uniform(F.col(id_col), fingerprint(text))) / weight).alias("key"),
    )
    stash = Stash(spark, "mix")
    slim = stash.put(slim)
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(per_source, weights, share, most).select(F.col("source").alias("s"), "source_size", "target", F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))
    # how the keys of a source spread follows from its qualities: of quality q, 1 - exp(-q * key) are below a key
    level = F.least(F.greatest(F.round(F.log2("weight") * LEVELS), F.lit(-MOST_LEVEL)), F.lit(MOST_LEVEL)).cast("int")
    levels = slim.groupBy("source", level.alias("level")).agg(F.count("*").alias("k"))
    spread = levels.groupBy(F.col("source").alias("o")).agg(F.collect_list(F.struct(F.pow(F.lit(2.0), F.col("level") / LEVELS).alias("q"), F.col("k"))).alias("levels"), F.sum("k").alias("all"))
    goal = stash.put(goal.join(spread, F.col("s").eqNullSafe(F.col("o"))).drop("o"))
    rows = slim.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # ascending in the key, and about as many rows in each
    below = F.aggregate("levels", F.lit(0.0), lambda a, x: a + x["k"] * (F.lit(1.0) - F.exp(-x["q"] * F.col("key")))) / F.col("all")
    rows = rows.withColumn("bucket", F.least(F.floor(below * F.col("buckets")), F.col("buckets") - 1)).drop("levels", "all", "weight")
    return rows


def plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, with_print: bool = False,
) -> DataFrame:
    """How many words of each document the mix takes. Runs a job.

    One row per row of docs: doc_id, source, size, source_size, target, epochs (whole copies),
    extra (words of one more, partial or whole copy), taken = epochs * size + extra. A source's taken
    words are its target, rounded down. Sizes and keys are stashed, so texts are read once. A hot source
    is sorted in buckets of its keys, whose sizes are summed first, and not in one task. A null
    source is a source, a null or empty text has size 0 and takes nothing, rows that repeat an id
    have different keys if their texts differ and are interchangeable otherwise.
    """
    rows = bucketed(docs, id_col, text_col, source_col, quality, weights, share, most)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("base"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    running = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(running), F.lit(0)))
    goal_words = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs)
    rest = goal_words - F.col("epochs") * F.col("source_size")
    rows = rows.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long"))
    more = ["print"] if with_print else []
    return rows.select("doc_id", *more, "source", "size", "source_size", "target", "epochs", "extra", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def _first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    found, between = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n.cast("int")), F.slice(F.split(text, WORD, -1), F.lit(1), n.cast("int"))
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))
    return F.substring(text, F.lit(1), length(found) + length(between))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus: docs' rows as often as ``plan`` takes them, with docs' columns. Runs jobs.

    A document of which the mix takes part of a copy gives its first words. A text without words is
    not taken. The plan finds its rows by id and text; rows that repeat both are taken alike. An empty
    table gives an empty one; the columns may have any names.
    """
    taken = plan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), **how, with_print=True)
    taken = taken.groupBy("doc_id", "print").agg(*[F.max(c).alias(c) for c in ("size", "epochs", "extra")]).where("size > 0 and epochs + extra > 0")
    taken = taken.withColumnRenamed("doc_id", "of").withColumnRenamed("print", "of_print")
    # the documents' own columns travel as one, so no name of theirs can be mistaken for one used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("print"))
    rows = rows.join(taken, F.col("id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print")))
    parts = F.concat(F.array_repeat(F.lit(False), F.col("epochs").cast("int")), F.when(F.col("extra") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = rows.withColumn("last", F.explode(parts))
    text = F.col(f"doc.`{text_col}`")
    cut = F.when(F.col("last") & (F.col("extra") < F.col("size")), _first_words(text, F.col("extra"))).otherwise(text)
    return rows.select(*[cut.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
