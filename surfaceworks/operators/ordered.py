"""Neighbours and places in an order, whether keys are small or one holds most rows.

A window keeps a key in one task. As long as no key has more than ``MOST_ROWS`` rows that is the
plan. Beyond, rows are dealt by ranges of (keys, order), so a large key lies in many ranges; windows run
within a range, and what crosses an end is carried by one row for each range: its least and its greatest
row, and how many rows its last key has there. Both plans give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stash import held

#: Rows of a key that one task takes.
MOST_ROWS = 2_000_000
#: Rows of a range, about.
RANGE_ROWS = 500_000


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def neighbours(rows: DataFrame, keys: list[str], order: list[str], before: list[str] = (), after: list[str] = (), place: str | None = None, most_rows: int = MOST_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``before`` and ``after``: structs of the listed columns of the row before and behind in its key, null if there is none;
    and, under the name ``place``, the row's place there, from 1.

    Order columns must tell the rows of a key apart. Null keys are a key, nulls come first. Runs a job that counts
    the rows of the keys; where one is large, also one that writes the rows in their ranges.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    beside = lambda of: F.struct(*[F.col(c) for c in of])
    if (counted.most or 0) <= most_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        out = rows
        if before:
            out = out.withColumn("before", F.lag(beside(before)).over(w))
        if after:
            out = out.withColumn("after", F.lead(beside(after)).over(w))
        return out.withColumn(place, F.row_number().over(w).cast("long")) if place else out

    parts = max(2, -(-counted.n // max(1, range_rows)))
    dealt = held(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = ["_part", *keys]
    carried = list(dict.fromkeys([*before, *after]))
    whole = F.struct(*[F.col(c) for c in [*keys, *order]], *[F.col(c) for c in carried if c not in keys and c not in order])
    of_key = dealt.groupBy(*own).agg(F.count("*").alias("n"), F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    key = F.struct(*[F.col(k) for k in keys])
    ends = of_key.groupBy("_part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max_by("n", key).alias("n"))
    # a row for each range: in order, with what the ranges before hold of the key that this one begins with
    line = Window.orderBy("_part")
    same = Window.partitionBy(*[F.col(f"hi.{k}") for k in keys]).orderBy("_part")
    ends = ends.withColumn("so_far", F.sum("n").over(same))
    ends = ends.select("_part", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.lag("hi").over(line).alias("_last"), F.lead("lo").over(line).alias("_next"), F.lag("so_far").over(line).alias("_so_far"))
    ends = held(ends.withColumnRenamed("_part", "_of"), "range-ends")
    w = Window.partitionBy(*own).orderBy(*order)
    here = dealt.withColumn("_k", key)
    out = here.withColumn("_at", F.row_number().over(w))
    if before:
        out = out.withColumn("before", F.lag(beside(before)).over(w))
    if after:
        out = out.withColumn("after", F.lead(beside(after)).over(w))
    out = out.join(ends, F.col("_part") == F.col("_of"), "left")
    from_last, in_next = _same("_last", "_k", keys), _same("_next", "_k", keys)
    across = lambda side, of: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in of])
    if before:
        out = out.withColumn("before", F.when(F.col("before").isNull() & F.col("_last").isNotNull() & from_last, across("_last", before)).otherwise(F.col("before")))
    if after:
        out = out.withColumn("after", F.when(F.col("after").isNull() & F.col("_next").isNotNull() & in_next, across("_next", after)).otherwise(F.col("after")))
    if place:
        out = out.withColumn(place, F.col("_at").cast("long") + F.when(F.col("_last").isNotNull() & from_last, F.col("_so_far")).otherwise(F.lit(0)))
    return out.drop("_part", "_of", "_k", "_at", "_lo", "_hi", "_last", "_next", "_so_far")
