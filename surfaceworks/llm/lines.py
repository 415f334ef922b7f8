"""Line dedup by site-relative frequency, with built-in functions.

A line is boilerplate of a host if the share of the host's pages that hold it is above ``RATIO``.
Counting needs the distinct lines of each page as 64-bit hashes only. A host can have at most
(mean distinct lines of its pages) / ``RATIO`` boilerplate lines, so they travel as one array for
each host; that table is stashed, and Spark broadcasts it only if its files are small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Stash
from .ngram_join import of_ids

#: What doesn't count around a line.
BLANKS = " \t\r\x0b\x0c"
#: A line must be on two pages at least to be a repetition at all; the ratio decides otherwise.
RATIO, REPETITION = 0.1, 2

_SCRIPT = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
_BLOCK = r"(?i)</?(p|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|aside|main|table|br|tr|td|th|title|body|html|head)\b[^>]*>"


def html_lines(html: Column) -> Column:
    """The text of a page: scripts, styles and comments go, block tags end a line, other tags vanish.

    Null stays null and an empty page is empty. A script or comment without an end stays as text; each
    pattern goes over a page once, whatever its length.
    """
    bare = F.regexp_replace(html, _SCRIPT, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, _BLOCK, "\n"), "<[^>]*>", ""), "[ \t]+", " ")


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without its port; empty for null and for what is no address."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _held_by(seen: DataFrame) -> DataFrame:
    """(host, h, n) of the distinct (host, h, group)."""
    return seen.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= REPETITION)


def _common(often: DataFrame, totals: DataFrame, ratio: float) -> DataFrame:
    """Of often (host, h, n) the boilerplate by totals (host, total)."""
    of = totals.select(F.col("host").alias("of"), "total")
    return often.join(of, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.lit(ratio) * F.col("total")).select("host", "h")


def drop_boilerplate(
    pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, copies_once: bool = False, counts: tuple[str, str] | None = ("_n_lines", "_n_dropped"), near=None
) -> DataFrame:
    """All rows and columns of pages, without boilerplate lines in the text; adds the columns ``counts``. Runs jobs.

    Lines are what newlines separate, compared without ASCII white space around them (carriage returns
    included); blank lines are neither counted nor dropped. A line goes if more than ``ratio`` of its host's
    rows hold it, and two of them. With ``copies_once``, rows of a host that hold the same lines in the same
    order count as one, so copies of a text don't make its lines boilerplate; else repeated rows count each.
    ``near`` goes further: a function from (id, text) to (id, group), near copies in one group. It gets the
    documents that hold lines found so far, and of a host those of one group count as one too if they share more
    than half of their lines with others of it, in a second count that must also be above the ratio. A null host is a host of its own, a null text stays null and has
    no lines, an empty table gives an empty one. The columns of pages may have any names; those that
    ``counts`` names are replaced.
    """
    spark = pages.sparkSession
    # the pages' own columns travel as one, so no name of theirs can be mistaken for one used here
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page")
    rows = pages.select(own, host.alias("host"), F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n", -1).alias("lines"))
    hashes = F.transform(F.filter(F.transform("lines", _bare), lambda x: x != ""), lambda x: F.xxhash64(x))
    same = F.xxhash64("host", hashes)
    counted = rows.select("host", hashes.alias("hashes"))
    if copies_once or near:
        counted = counted.select("host", F.xxhash64("host", "hashes").alias("same"), "hashes").groupBy("host", "same").agg(F.first("hashes").alias("hashes"))
        counted = Stash(spark, "line-sets").put(counted)
    often = _held_by(counted.select("host", F.explode(F.array_distinct("hashes")).alias("h")))
    common = _common(often, counted.groupBy("host").agg(F.count("*").alias("total")), ratio)
    if near:
        common = Stash(spark, "lines").put(common)
        of = common.select(F.col("host").alias("of"), F.col("h").alias("line"))
        seen = counted.select("host", "same", F.explode(F.array_distinct("hashes")).alias("h"))
        seen = Stash(spark, "lines").put(seen.join(of, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("line"))).select("host", "same", "h"))
        holders = Stash(spark, "lines").put(seen.select(F.col("same").alias("id")).distinct())
        text = F.col(f"page.`{text_col}`").alias("text")
        groups = near(of_ids(rows.select(same.alias("same"), text), F.col("same"), holders).select(F.col("same").alias("id"), "text"))
        groups = Stash(spark, "lines").put(groups.groupBy("id").agg(F.min("group").alias("group")))
        # a document is of its group if the group has more than half of its lines twice: sharing boilerplate isn't enough
        own_lines = counted.join(groups, F.col("same") == F.col("id")).select("same", "group", F.explode(F.array_distinct("hashes")).alias("h"))
        twice = own_lines.groupBy("group", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("group").alias("of_group"), F.col("h").alias("line"))
        alike = own_lines.join(twice, (F.col("group") == F.col("of_group")) & (F.col("h") == F.col("line")), "left").groupBy("same", "group").agg((F.count("line") * 2 > F.count("*")).alias("alike"))
        one = F.when(F.col("alike"), F.xxhash64(F.lit(1), "group")).otherwise(F.xxhash64(F.lit(2), "same")).alias("group")
        alike = alike.select(F.col("same").alias("id"), one)
        grouped = seen.join(alike, F.col("same") == F.col("id"), "left").withColumn("group", F.coalesce("group", F.xxhash64(F.lit(2), "same")))
        saved = grouped.groupBy("host", "same", "group").agg(F.lit(1)).groupBy("host").agg((F.count("*") - F.count_distinct("group")).alias("saved"))
        saved = saved.select(F.col("host").alias("of"), "saved")
        totals = counted.groupBy("host").agg(F.count("*").alias("total")).join(saved, F.col("host").eqNullSafe(F.col("of")), "left")
        often = _held_by(grouped.select("host", "h", "group").distinct())
        common = _common(often, totals.select("host", (F.col("total") - F.coalesce("saved", F.lit(0))).alias("total")), ratio)
    listed = Stash(spark, "lines").put(common.groupBy(F.col("host").alias("of")).agg(F.collect_list("h").alias("common")))
    rows = rows.join(listed, F.col("host").eqNullSafe(F.col("of")), "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))
    # a page's own boilerplate first: a line is looked up among its page's, not among its host's
    rows = rows.withColumn("common", F.when(F.size("common") == 0, F.col("common")).otherwise(F.array_intersect(hashes, "common")))
    kept = F.filter("lines", lambda x: (_bare(x) == "") | ~F.array_contains("common", F.xxhash64(_bare(x))))
    rows = rows.withColumn("kept", F.when(F.size("common") == 0, F.col("lines")).otherwise(kept))
    text = F.when(F.col(f"page.`{text_col}`").isNotNull(), F.array_join("kept", "\n"))
    added = dict(zip(counts or (), (F.size(hashes).cast("long"), (F.size("lines") - F.size("kept")).cast("long")), strict=False))
    full = [text.alias(c) if c == text_col else F.col(f"page.`{c}`").alias(c) for c in pages.columns if c not in added]
    return rows.select(*full, *[c.alias(n) for n, c in added.items()])
