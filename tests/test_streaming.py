import random
import time

from surfaceworks.operators import frames
from surfaceworks.sources import writers
from surfaceworks.streaming import frame_stream

SCHEMA = "log string, line long, item int, dir string, kind string, id string, method string, ts_ns long"


def test_stream_matches_as_the_batch_does(spark, tmp_path):
    kinds = [("c2s", "request", "1"), ("c2s", "request", "2"), ("s2c", "response", "1"), ("c2s", "request", "1"), ("s2c", "response", "2"), ("s2c", "response", "1"), ("s2c", "response", "3")]
    df = spark.createDataFrame([("l", i, 0, d, k, key, "m", i * 10**9) for i, (d, k, key) in enumerate(kinds)], SCHEMA)
    df.where("line < 4").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.where("line >= 4").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = frame_stream.correlate(stream).writeStream.format("memory").queryName("matched").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    pairs = lambda d: {(r.request_line, r.response_line, r.latency_ms) for r in d.collect()}
    assert pairs(spark.table("matched")) == pairs(frames.pairs(df)) == {(0, 2, 2000), (1, 4, 3000), (3, 5, 2000)}


def test_append_writes_a_key_once(spark, tmp_path):
    write = frame_stream.append_new(f"{tmp_path}/t", ["k"])
    for i, ks in ((0, [1, 2, 2]), (1, [2, 3]), (1, [2, 3]), (0, [1, 2, 2])):  # a batch that is written again replaces itself
        write(spark.createDataFrame([(k,) for k in ks], "k int"), i)
    assert sorted(r.k for r in writers.committed(spark, f"{tmp_path}/t", "k int").collect()) == [1, 2, 3]


def test_a_writer_that_dies_leaves_no_repeat_and_no_loss(spark, tmp_path):
    path, rows = f"file://{tmp_path}/m", lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    assert writers.committed(spark, path, "k int") is None and writers.append_manifest(rows(1, 2), path, "a")
    rows(3, 4).write.parquet(f"{path}/batches/b")  # written, but not committed: the writer died here
    assert sorted(r.k for r in writers.committed(spark, path, "k int").collect()) == [1, 2]
    assert writers.append_manifest(rows(3, 4), path, "b") and not writers.append_manifest(rows(3, 4), path, "b") and not writers.append_manifest(rows(9), path, "a")
    assert sorted(r.k for r in writers.committed(spark, path, "k int").collect()) == [1, 2, 3, 4]


def log_rows(logs=3, lines=150, seed=3):
    """Logs of several messages a line: rows of ``frames`` and the same as records of a stream."""
    r = random.Random(seed)
    messages, records_ = [], []
    for log in map(str, range(logs)):
        for line in range(lines):
            items = [(i, r.choice(["c2s", "s2c"]), r.choice(["request", "response", "notification"]), r.choice([None, "1", "2", "3", str(line)]), "m", line * 1_700_000) for i in range(r.choice([0, 1, 1, 2]))]
            records_.append((log, line, line == lines - 1, line, items))
            messages += [(log, line, i, d, k, key, m, t) for i, d, k, key, m, t in items]
    r.shuffle(records_)
    return messages, records_ + records_[:5]


def test_a_shuffled_stream_gives_what_the_whole_log_gives(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        messages, rows = log_rows()
        for at in range(0, len(rows), 120):
            spark.createDataFrame(rows[at : at + 120], frame_stream.RECORD).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame_stream.RECORD).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = frame_stream.records(stream).writeStream.format("memory").queryName("whole").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set(provider, was)
    whole = frames.correlated(spark.createDataFrame(messages, SCHEMA))
    answered = {(r.log, r.request_line, r.line, r.latency_ms) for r in whole.where("state = 'matched'").collect()}
    unanswered = {(r.log, r.line, None, None) for r in whole.where("unanswered").collect()}
    got = spark.table("whole").collect()
    assert {(r.log, r.request_line, r.response_line, r.latency_ms) for r in got} == answered | unanswered and len(answered) > 20 and unanswered
    for name in ("next", "early", "open"):  # closed logs leave no state; a row that came again after its log's end waits for a new one
        left = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", name).load()
        assert left.count() <= (5 if name == "early" else 3 if name == "next" else 0)


def test_a_log_that_goes_idle_gives_out_what_was_never_answered(spark, tmp_path):
    df = spark.createDataFrame([("l", 0, 0, "c2s", "request", "1", "m", 0), ("l", 1, 0, "c2s", "request", "2", "m", 0), ("l", 2, 0, "s2c", "response", "2", None, 10**9)], SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = frame_stream.correlate(stream, idle=1).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").start()
    for _ in range(200):
        time.sleep(0.2)
        if spark.table("ended").count() == 2:
            break
    q.stop()
    assert {(r.request_line, r.response_line) for r in spark.table("ended").collect()} == {(0, None), (1, 2)}


def test_runs_of_other_dates_stay(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    doc = lambda *rows: spark.createDataFrame([(d, i, f"{d}{i}", q) for d, i, q in rows], "run_date string, server_id string, text string, queries string")
    writers.latest(spark, path)
    first, second = doc(("2026-01-01", "a", "q"), ("2026-01-01", "b", None)), doc(("2026-01-02", "a", "q"))
    for rows in (first, second, doc(("2026-01-01", "b", "new"))):
        writers.server_documents(rows, path)
        writers.query_sets(rows, path)
        writers.latest(spark, path)
    read = lambda name: sorted((str(r.run_date), r.server_id, r.text) for r in spark.read.json(f"{path}/{name}").collect())
    assert read("runs") == [("2026-01-01", "a", "2026-01-01a"), ("2026-01-01", "b", "2026-01-01b"), ("2026-01-02", "a", "2026-01-02a")]
    assert read("queries") == read("runs") and read("latest") == [("2026-01-02", "a", "2026-01-02a")]
    reports = lambda *logs: spark.createDataFrame([(f"x/{i}", i) for i in logs], "log string, n string")
    writers.trial_reports(reports("p", "q"), f"{path}/t")
    writers.trial_reports(reports("q", "r"), f"{path}/t")
    assert sorted(r.n for r in spark.read.json(f"{path}/t").collect()) == ["p", "q", "r"]
    pages = lambda *rows: spark.createDataFrame(list(rows), "server string, page_no long, raw string")
    writers.wire_pages(pages(("a", 1, "y"), ("a", 0, "x")), f"{path}/w")
    writers.wire_pages(pages(("b", 0, "z")), f"{path}/w")
    assert sorted((r.server, r.value) for r in spark.read.text(f"{path}/w").collect()) == [("a", "x"), ("a", "y"), ("b", "z")]
    writers.summary(reports("p"), f"{path}/s")
    writers.summary(reports("q"), f"{path}/s")
    assert [r.n for r in spark.read.json(f"{path}/s").collect()] == ["q"]
