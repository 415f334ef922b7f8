"""Schema hygiene: six dimensions of a server's tools, their mean and letter, and similar siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SIMILAR
from ..functions import text
from ..stash import held
from . import cells


def description_dims(tools: DataFrame) -> DataFrame:
    """(server, n_tools, description_adequacy, when_to_use_signal)."""
    return tools.groupBy("server").agg(
        F.count("*").alias("n_tools"),
        text.percent(F.avg(text.adequacy(F.col("description")))).alias("description_adequacy"),
        text.percent(F.avg(text.says_when(F.col("description")).cast("double"))).alias("when_to_use_signal"),
    )


def naming(tools: DataFrame) -> DataFrame:
    """(server, naming_clarity): mean share of three checks; the casing of most names is the server's."""
    each = tools.select("server", "name", text.casing(F.col("name")).alias("style"))
    same, style = Window.partitionBy("server", "name"), Window.partitionBy("server", "style")
    each = each.select(
        "server", (text.conforming(F.col("name")) & (F.count("*").over(same) == 1)).cast("double").alias("ok"), (~text.weak(F.col("name"))).cast("double").alias("strong"), F.count("*").over(style).alias("alike")
    )
    return each.groupBy("server").agg(text.percent((F.avg("ok") + F.avg("strong") + F.max("alike") / F.count("*")) / F.lit(3.0)).alias("naming_clarity"))


def token_sets(tools: DataFrame) -> DataFrame:
    """(server, tool, name, set, n): distinct content words of the descriptor; tools without any are similar to none."""
    return tools.select("server", "tool", "name", F.array_distinct(text.content_words(F.coalesce("descriptor", F.lit("")))).alias("set")).withColumn("n", F.size("set")).where("n > 0")


def _near(nodes: DataFrame, least: float) -> DataFrame:
    """(server, i, j, own, print) of nodes (server, print, n, bits) in the cells in which their bitmaps don't rule out that they are similar to another."""
    return held(cells.marked(cells.of_pairs(nodes.select("server", "print", "n", "bits"), F.col("print")), least), "near")


def _members(sets: DataFrame, x: str) -> DataFrame:
    return sets.select("server", F.col("print").alias(f"p{x}"), F.col("tool").alias(f"t{x}"), F.col("name").alias(x))


def similar(tools: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(server, ta, tb, a, b, similarity): pairs of a server's tools whose sets of content words reach a Jaccard of ``least``. Runs jobs.

    Texts are cut once, into sorted 64-bit hashes of their words. Equal sets are one node. Nodes of a server meet in
    cells of two blocks, where no pair leaves the task that isn't similar; what is moved grows with the sets, not
    with the pairs that are compared. Links between nodes become pairs of tools at the end.
    """
    sets = held(cells.with_bitmaps(token_sets(tools)), "sets")
    nodes = held(sets.groupBy("server", "print").agg(F.min("tool").alias("lo"), F.max("tool").alias("hi"), F.first("n").alias("n"), F.first("bits").alias("bits")), "nodes")
    full = sets.join(nodes.select("server", "print", "lo", "hi"), ["server", "print"]).where("tool = lo").select("server", "print", "lo", "hi", "n", "bits", "set")
    found = cells.links(_near(nodes, least).join(full, ["server", "print"]), least)
    across = found.select("server", F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("j"))
    across = across.join(_members(sets, "a"), ["server", "pa"]).join(_members(sets, "b"), ["server", "pb"])
    first = F.col("ta") < F.col("tb")
    turn = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y)).alias(x)
    across = across.where("ta <> tb").select("server", turn("ta", "tb"), turn("tb", "ta"), turn("a", "b"), turn("b", "a"), "j")
    alike = sets.groupBy("server", "print").agg(F.count("*").alias("copies")).where("copies > 1").select("server", F.col("print").alias("pa"))
    same = _members(sets, "a").join(alike, ["server", "pa"]).join(_members(sets, "b").withColumnRenamed("pb", "pa"), ["server", "pa"]).where(first)
    out = across.unionByName(same.select("server", "ta", "tb", "a", "b", F.lit(1.0).alias("j")))
    return out.select("server", "ta", "tb", "a", "b", text.rounded(F.col("j"), 4).alias("similarity"))


def flagged(tools: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(server, name) of the tools that are similar to another, as ``similar`` would pair them; pairs aren't listed. Runs jobs.

    A word that one set alone holds is common to no two. Sets with the same other words and as many of their own are
    equally similar to any other set, so one of them stands for all in the cells. Only words with a digit, as serial
    numbers have, are looked at for that: texts have few of them.
    """
    none = F.lit(0).cast("long")
    x1, x2 = F.aggregate("set", none, lambda a, w: a.bitwiseXOR(w)), F.aggregate("set", none, lambda a, w: a.bitwiseXOR(F.xxhash64(w)))
    sets = token_sets(tools).where(cells.USABLE).withColumn("numbers", cells.hashes(F.filter("set", lambda w: w.rlike(r"\p{Nd}")))).withColumn("set", cells.hashes(F.col("set")))
    sets = held(sets.select("server", "tool", "name", x1.alias("x1"), x2.alias("x2"), "numbers", "set"), "sets")
    groups = held(_groups(sets), "groups")
    key = ["server", "c1", "c2", "common", "own"]
    size, own = F.col("common"), F.col("own")
    kinds = groups.groupBy(key).agg(F.count("*").alias("members"), F.min("x1").alias("x1"))
    same = kinds.where((F.col("members") > 1) & (size / (2 * (size + own) - size) >= least)).select(key)
    # of each kind a real set is compared, with the words of its own
    one = groups.join(kinds.select(*key, "x1"), [*key, "x1"]).join(sets.select("server", "tool", "x1", "x2", "set"), ["server", "x1", "x2"]).where("tool = lo")
    nodes = held(cells.mapped(one.select(*key, "x1", "x2", "lo", "hi", "set")).drop("set"), "nodes")
    near = _near(nodes, least)
    full = nodes.join(near.select("server", "print").distinct(), ["server", "print"], "left_semi").join(sets.select("server", "x1", "x2", F.col("tool").alias("lo"), "set"), ["server", "x1", "x2", "lo"])
    full = cells.mapped(full.select("server", "lo", "hi", "set"))
    linked = cells.linked(near.join(full, ["server", "print"]), least)
    found = same.unionByName(nodes.join(linked.distinct(), ["server", "print"], "left_semi").select(key)).distinct()
    prints = groups.where("lo < hi").select("server", "x1", "x2").unionByName(groups.join(found, key, "left_semi").select("server", "x1", "x2"))
    return sets.select("server", "x1", "x2", "name").join(prints, ["server", "x1", "x2"], "left_semi").select("server", "name")


def _groups(sets: DataFrame) -> DataFrame:
    """(server, x1, x2, lo, hi, own, common, c1, c2) of each different set of rows (server, tool, x1, x2, numbers, set): how many numbers it
    alone holds and how many words besides, these by the exclusive or of their hashes (c1, c2; x1, x2 of all its words), and the ends of its tools.

    A tool that has several sets is similar to none of its own; these count as if all their words were common.
    """
    none = F.lit(0).cast("long")
    words = sets.select("server", "x1", "x2", F.explode("numbers").alias("word")).groupBy("server", "word")
    alone = words.agg(F.count("*").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")).where("n = 1")
    no_tool = F.lit(None).cast(sets.schema["tool"].dataType)
    rows = sets.select("server", "x1", "x2", F.col("tool").alias("lo"), F.col("tool").alias("hi"), F.size("set").cast("long").alias("n"), none.alias("own"), none.alias("o1"), none.alias("o2"))
    rows = rows.unionByName(alone.select("server", "x1", "x2", no_tool.alias("lo"), no_tool.alias("hi"), none.alias("n"), F.lit(1).cast("long").alias("own"), F.col("word").alias("o1"), F.xxhash64("word").alias("o2")))
    nodes = rows.groupBy("server", "x1", "x2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"), F.sum("own").alias("own"), F.bit_xor("o1").alias("o1"), F.bit_xor("o2").alias("o2"))
    several = sets.groupBy("server", "tool").agg(F.min("x1").alias("a1"), F.max("x1").alias("b1"), F.min("x2").alias("a2"), F.max("x2").alias("b2")).where("a1 < b1 or a2 < b2")
    nodes = nodes.join(several.select("server", F.col("tool").alias("lo"), F.lit(True).alias("several")), ["server", "lo"], "left")
    one = F.col("several").isNull()
    own = F.when(one, F.col("own")).otherwise(none)
    return nodes.select(
        "server", "x1", "x2", "lo", "hi", own.alias("own"), (F.col("n") - own).alias("common"),
        *(F.when(one, F.col(f"x{i}").bitwiseXOR(F.col(f"o{i}"))).otherwise(F.col(f"x{i}")).alias(f"c{i}") for i in (1, 2)),
    )


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Similar pairs as they are listed: by similarity, largest first, then by names."""
    return pairs.orderBy("server", F.desc("similarity"), "a", "b")


def disambiguation(tools: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(server, disambiguation): share of tools whose name is in no similar pair; one tool alone has 100."""
    ends = flagged(tools) if pairs is None else pairs.select("server", F.explode(F.array("a", "b")).alias("name"))
    ends = ends.groupBy("server").agg(F.countDistinct("name").alias("flagged"))
    n = tools.groupBy("server").agg(F.count("*").alias("n"))
    share = F.lit(1.0) - F.coalesce("flagged", F.lit(0)) / F.col("n")
    return n.join(ends, "server", "left").select("server", F.when(F.col("n") < 2, F.lit(100.0)).otherwise(text.percent(share)).alias("disambiguation"))


def property_dims(properties: DataFrame, servers: DataFrame) -> DataFrame:
    """(server, parameter_descriptions, enum_documentation) of all schema properties of a surface; none give 100."""
    has = F.size("enum") > 0
    out = properties.groupBy("server").agg(
        (F.count_if("described") / F.count("*")).alias("p"),
        (F.count_if(has & text.enum_documented(F.col("enum"), F.coalesce("enum_desc", F.lit("")))) / F.nullif(F.count_if(has), F.lit(0))).alias("e"),
    )
    share = lambda c: F.coalesce(text.percent(F.col(c)), F.lit(100.0))
    return servers.select("server").distinct().join(out, "server", "left").select("server", share("p").alias("parameter_descriptions"), share("e").alias("enum_documentation"))


DIMENSIONS = ("description_adequacy", "when_to_use_signal", "parameter_descriptions", "enum_documentation", "naming_clarity", "disambiguation")


def graded(tools: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """(server, six dimensions, score, grade)."""
    out = description_dims(tools).join(naming(tools), "server").join(disambiguation(tools), "server")
    if properties is None:
        out = out.withColumn("parameter_descriptions", F.lit(100.0)).withColumn("enum_documentation", F.lit(100.0))
    else:
        out = out.join(property_dims(properties, tools), "server")
    total = sum((F.col(d) for d in DIMENSIONS[1:]), F.col(DIMENSIONS[0]))
    out = out.withColumn("score", text.rounded(total / F.lit(6.0), 2))
    return out.select("server", *DIMENSIONS, "score", text.grade(F.col("score")).alias("grade"))
