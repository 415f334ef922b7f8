"""Exact medians of groups of any size.

``F.median`` keeps the values of a group in one buffer. Here a group's two middle places are looked
for by ranges: the values between the ends that are known so far fall into ``BINS`` bins of equal width,
whose counts, least and greatest values are aggregated before they are shuffled; the bin that holds
the place gives the next ends. Bins' ends are values, so every round narrows a range that isn't one value
yet, and counts below a range are carried along: what comes out is the value itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stash import Stash

BINS = 4096
#: A range with so many values is ranked at once.
MOST_VALUES = 200_000
#: A group with so many values keeps them in one buffer.
MOST_ROWS = 2_000_000


def medians(rows: DataFrame, keys: list[str], value: str, most_rows: int = MOST_ROWS, most_values: int = MOST_VALUES, bins: int = BINS) -> DataFrame:
    """(keys, n, median) of a number: the middle value, or the mean of the two middle ones, as a double. Runs jobs.

    Nulls and NaNs are no values; a group without any has n 0 and a null median, an empty table no rows. A null key is a key.
    """
    v = F.col(value)
    kept = rows.select(F.struct(*[F.col(k) for k in keys]).alias("key"), F.when(~F.isnan(v.cast("double")), v).alias("v"))
    sizes = kept.groupBy("key").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= most_rows:
        return kept.groupBy("key").agg(F.count("v").alias("n"), F.median("v").alias("median")).select("key.*", "n", "median")

    stash = Stash(rows.sparkSession, "medians")
    sizes = stash.put(sizes)
    kept = stash.put(kept.where("v is not null"))
    places = F.explode(F.array_distinct(F.array(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1"))))
    # below: values under the range; among: values in it
    now = stash.put(sizes.where("n > 0").select("key", places.alias("place"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("among")))

    def inside(ranges: DataFrame) -> DataFrame:
        return ranges.join(kept.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).where(F.col("v").between(F.col("lo"), F.col("hi")))

    found = None
    while True:
        small = (F.col("lo") == F.col("hi")) | (F.col("among") <= most_values)
        done = now.where(small)
        found = done if found is None else found.unionByName(done)
        now = now.where(~small)
        if not now.limit(1).count():
            break
        low, high, x = (F.col(c).cast("double") for c in ("lo", "hi", "v"))
        # halved before they are subtracted where the width would overflow
        share = F.when(high - low < float("inf"), F.try_divide(x - low, high - low)).otherwise(F.try_divide(x / 2 - low / 2, high / 2 - low / 2))
        which = F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int")
        which = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), bins - 1).otherwise(F.greatest(F.lit(0), F.coalesce(which, F.lit(0))))
        counted = inside(now).withColumn("bin", which).groupBy("key", "place", "below", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("key", "place").orderBy("bin"))
        counted = counted.withColumn("upto", upto).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
        now = stash.put(counted.select("key", "place", "lo", "hi", (F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("among")))
    found = stash.put(found)
    one = found.where("lo = hi").select("key", "place", F.col("lo").alias("v"))
    ranked = inside(found.where("lo <> hi")).withColumn("rank", F.row_number().over(Window.partitionBy("key", "place").orderBy("v")) + F.col("below"))
    middle = one.unionByName(ranked.where("rank = place").select("key", "place", "v")).groupBy("key").agg((F.min("v").cast("double") * 0.5 + F.max("v").cast("double") * 0.5).alias("median"))
    out = sizes.join(middle.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left")
    return out.select("key.*", "n", "median")
