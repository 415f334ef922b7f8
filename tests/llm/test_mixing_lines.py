import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from surfaceworks.llm import lines, mixing


def share(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if per * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: per * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 300, None: 5}, {"a": 1}, {"a": 0, "b": 7}, {f"s{i}": (i * 37) % 101 for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(share(sizes))


def test_plan_meets_targets(spark, odd, empty):
    many = spark.createDataFrame([(i, "w " * (i % 50), "hot" if i % 3 else f"s{i % 5}") for i in range(6000)], "doc_id long, text string, source string")
    for df in (many, odd):
        rows = mixing.plan(df).collect()
        assert len(rows) == df.count()
        taken, size, goal = collections.Counter(), collections.Counter(), {}
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
            size[r.source] += r.size
            goal[r.source] = r.target
        assert all(r.source_size == size[r.source] for r in rows)
        assert goal == pytest.approx(share(size)) and all(abs(taken[s] - int(goal[s])) <= 1 for s in goal)
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, mixing.plan(many).collect())) == sorted(map(key, mixing.plan(many.repartition(7)).collect()))
    assert mixing.plan(empty).count() == 0


def test_mix_takes_what_the_plan_says(spark):
    docs = spark.createDataFrame([(i, f"a\tb{i}  " * (i % 7 + 1), f"s{i % 4}", "keep") for i in range(400)], "doc_id long, text string, source string, epochs string")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: r.taken for r in mixing.plan(docs).collect() if r.taken}
    got = collections.Counter()
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
    assert got == want


def test_common_lines_go(spark, odd, empty):
    rows = [(i, "h", f"menu\n own {i}\n\nmenu \nfooter {i % 2}") for i in range(20)] + [(100 + i, "g", "menu\nown") for i in range(3)] + [(200, None, None), (201, None, "")]
    df = spark.createDataFrame(rows, "id long, host string, text string")
    got = {r.id: r for r in lines.drop_boilerplate(df, F.col("host"), ratio=0.6).collect()}
    assert got[7].text == " own 7\n\nfooter 1" and (got[7]._n_lines, got[7]._n_dropped) == (4, 2)
    assert got[100].text == "" and got[200].text is None and got[201].text == "" and len(got) == len(rows)
    # on a small host the ratio decides as well, but one page alone is no repetition
    few = spark.createDataFrame([(i, "h", f"same line\nmine {i}") for i in range(2)] + [(9, "one", "all my own")], "id long, host string, text string")
    assert {r.id: r.text for r in lines.drop_boilerplate(few, F.col("host")).collect()} == {0: "mine 0", 1: "mine 1", 9: "all my own"}
    assert lines.drop_boilerplate(odd, F.col("source")).count() == odd.count() and lines.drop_boilerplate(empty, F.col("source")).count() == 0


CLASH = ("page", "host", "lines", "common", "kept", "of", "h", "hashes", "total", "_host", "_lines", "_n_lines")


def test_columns_named_like_helpers_stay_as_they_are(spark):
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH)
    rows = [(i, f"menu\nown {i}", "s", *(f"{c}{i}" for c in CLASH)) for i in range(20)]
    out = lines.drop_boilerplate(spark.createDataFrame(rows, schema), F.col("source"), counts=None)
    assert sorted(map(tuple, out.collect())) == [(r[0], f"own {r[0]}", *r[2:]) for r in rows]
    names = ("doc", "id", "print", "of", "size", "epochs", "extra", "taken", "_id", "_own", "_last", "key", "bucket")
    rows = [(i, "a b c", "s", *(f"{c}{i}" for c in names)) for i in range(20)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names)))
    got = out.collect()
    assert {r.doc_id for r in got} == set(range(20)) and all(r[f"{c}"] == f"{c}{r.doc_id}" for r in got for c in names) and out.columns[3:] == list(names)


def test_plan_takes_the_documents_of_smallest_keys(spark):
    """Exponential keys scaled by quality, sorted within a source, cut at the budget: all of it anew, in Python."""
    texts = [("word " * (1 + i % 9) + "7" * (i % 23), ("hot", "b", "c", None)[min(i % 7, 3)]) for i in range(5000)]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "doc_id long, text string, source string")
    rows = mixing.plan(docs).collect()
    key = {}
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", mixing.fingerprint(F.col("text")).alias("h")).collect()}
    for i, (t, _) in enumerate(texts):
        bits = int(hashlib.md5(f"{mixing.SEED}:{i}:{hashes[i]}".encode()).hexdigest()[:13], 16)
        odd = len(re.sub(r"[^\W\d_]|\s", "", t))
        key[i] = -math.log((bits + 0.5) / 2**52) / max(0.05, 1 - odd / len(t))
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert len(by) == 4
    for own in by.values():
        left = math.floor(own[0].target)
        epochs, left = divmod(left, own[0].source_size)
        for r in sorted(own, key=lambda r: key[r.doc_id]):
            part = min(r.size, left)
            assert (r.epochs, r.extra) == (epochs, part)
            left -= part


def test_buckets_hold_about_as_many_documents_whatever_their_quality(spark):
    n = 60_000
    for quality in (0.05, 0.25, 1.0):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("s").alias("source"))
        mixed = F.when(F.col("doc_id") % 2 == 0, F.lit(quality)).otherwise(F.lit(0.5))
        counts = [r["count"] for r in mixing.bucketed(docs, quality=mixed).groupBy("bucket").count().collect()]
        assert max(counts) <= 3 * mixing.BUCKET_ROWS and sum(counts) == n


def test_html_lines(spark):
    html = '<html><head><style>p{}</style><script>var t="</p>";</script></head><body><p>One <b>two</b></p><!-- x --><li>three</li>'
    got = spark.createDataFrame([(html,)], "h string").select(lines.html_lines(F.col("h")).alias("t")).first().t
    assert [x.strip() for x in got.split("\n") if x.strip()] == ["One two", "three"]
    long = "<p>line</p>" * 50_000
    rows = spark.createDataFrame([(None, None), ("", ""), (long, "HTTP://A.b:80/x"), (long, "no address")], "h string, u string").select(lines.html_lines(F.col("h")).alias("t"), lines.host_of(F.col("u")).alias("o")).collect()
    assert [(r.t or "").count("line") for r in rows] == [0, 0, 50_000, 50_000] and [r.o for r in rows] == ["", "", "a.b", ""]
