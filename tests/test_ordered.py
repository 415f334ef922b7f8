import random

import pytest
from pyspark.sql import functions as F

from surfaceworks.constants import MORE_WARNINGS
from surfaceworks.operators import frames
from surfaceworks.operators.ordered import neighbours
from surfaceworks.sources import readers

FILES = {
    "crlf.txt": b"".join(b"line %d \xc3\xa9\r\n" % i if i % 3 else b"\n" for i in range(3000)), "plain.txt": b"x\n\ny", "empty.txt": b"", "blank.txt": b"\n\n", "cr.txt": b"a\rb\r\n\r\n",
    "long.txt": b"s\n" + b"w" * 50_000 + b"\n" + b"t" * 10_000,
}


@pytest.mark.parametrize("block", ["700", "128m"])
def test_lines_of_split_files(spark, tmp_path, block):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = readers.lines(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    got = {}
    for r in rows:
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line, r.text))
    want = {name: data.decode().removesuffix("\n").split("\n") for name, data in FILES.items() if data}
    assert {name: sorted(x) for name, x in got.items()} == {name: list(enumerate(x)) for name, x in want.items()}


def messages(n):
    r = random.Random(n)
    rows = []
    for line in range(n):
        kind = r.choice(["request", "response", "request", "response", "notification", "unrecognised"])
        method = r.choice(["tools/call", "tools/call", "ping"]) if kind != "response" else None
        params = r.choice(["", '{"a":1}', '{"b":2}']) if kind == "request" else ""
        log = "hot" if r.random() < 0.8 else r.choice(["a", "b", None])
        rows.append((log, line, 0, r.choice(["c2s", "s2c"]), 10, False, "t", line * 1_500_000, kind, r.choice([None, "1", "1", "2", str(line)]), method, params))
    return rows


MESSAGE = "log string, line long, item int, dir string, bytes long, batch boolean, ts string, ts_ns long, kind string, id string, method string, params string"


def test_ranges_give_what_windows_give(spark):
    m = spark.createDataFrame(messages(2500), MESSAGE).repartition(6)
    for f in (frames.correlated, frames.retries):
        window, ranges = (sorted(map(str, f(m, most_rows=k).collect())) for k in (10**9, 0))
        assert window == ranges and len(window) > 500


@pytest.mark.parametrize("range_rows", [1, 7, 400, 10_000])
def test_neighbours_across_many_ranges(spark, range_rows):
    r = random.Random(range_rows)
    rows = [(r.choice(["h", "h", "h", "h", "h", "k", None]), i, r.choice([None, 1, 2])) for i in range(500)]
    if range_rows == 1:
        rows = rows[:60]
    by = {}
    for k, i, v in rows:
        by.setdefault(k, []).append((i, v))
    want = {(k, i): (x[j - 1] if j else None, x[j + 1] if j + 1 < len(x) else None, j + 1) for k, x in by.items() for j, (i, _) in enumerate(x)}
    out = neighbours(spark.createDataFrame(rows, "k string, i int, v int").repartition(5), ["k"], ["i"], ["i", "v"], ["i", "v"], "place", most_rows=0, range_rows=range_rows)
    got = {(r.k, r.i): (r.before and tuple(r.before), r.after and tuple(r.after), r.place) for r in out.collect()}
    assert got == want and set(out.columns) == {"k", "i", "v", "before", "after", "place"}
    assert neighbours(out.limit(0).select("k", "i"), ["k"], ["i"], ["i"], most_rows=0).count() == 0


def test_warnings_of_a_long_log(spark):
    found = spark.range(5000).select(F.when(F.col("id") % 50 > 0, "hot").otherwise("cold").alias("log"), F.col("id").alias("line"), F.lit(0).alias("item"), F.concat(F.lit("w"), "id").alias("warning"))
    got = {r.log: r.warnings for r in frames.warnings(found.repartition(7)).collect()}
    hot = [i for i in range(5000) if i % 50]
    assert got == {"hot": [*(f"w{i}" for i in hot[:50]), MORE_WARNINGS % (len(hot) - 50)], "cold": [*(f"w{i * 50}" for i in range(50)), MORE_WARNINGS % 50]}
