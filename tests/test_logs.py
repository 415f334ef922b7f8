import json

from pyspark.sql import functions as F

from surfaceworks.operators import frames, stack, trials
from surfaceworks.sources import readers

HEAD = {"interposer_version": "0.1", "pid": 1}


def frame(ts, d, size, **more):
    return {"ts": f"2026-01-01T00:00:00.{ts:09d}Z", "dir": d, "size_bytes": size} | more


LOG = [
    HEAD,
    frame(100_000_000, "c2s", 10, method="initialize", id=1),
    frame(150_000_001, "s2c", 20, id=1, is_response=True),
    "not json",
    "",
    frame(200_000_000, "c2s", 30, batch=True, items=[{"method": "tools/call", "id": 2, "params_full": {"name": "a", "x": 1}}, {"method": "tools/call", "id": "2", "params_full": {"x": 1, "name": "a"}}]),
    frame(300_000_000, "s2c", 40, id=2, is_response=True, result_summary={"is_error": True, "bytes": 7, "content_blocks": 1, "text_len": 5}),
    frame(400_000_000, "s2c", 50, id=9, is_response=True, error={"code": -1, "message": "no"}),
    frame(900_000_000, "c2s", 60, method="notifications/x"),
    {"neither": 1},
    frame(950_000_000, "s2c", 1, unparseable=True),
]


def test_frame_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in LOG) + "\n")
    lines = readers.frame_lines(spark, f"file://{tmp_path}/log.jsonl").cache()
    assert [r.line for r in lines.where("line_kind = 'unreadable'").collect()] == [3]
    m = readers.frame_messages(lines).cache()
    r = json.loads(frames.reports(m, lines).toJSON().first())
    assert r["totals"] == {
        "frames": 7, "frames_c2s": 3, "frames_s2c": 4, "bytes": 211, "bytes_c2s": 100, "bytes_s2c": 111, "batch_frames": 1, "batch_messages": 2, "requests": 3, "notifications": 1, "responses": 3, "tool_calls": 2,
        "tool_call_arg_bytes": 42, "tool_call_arg_tokens": 0, "tool_call_result_bytes": 7, "jsonrpc_errors": 1, "tool_errors": 1, "retries": 1, "unmatched_requests": 1, "unmatched_responses": 1, "duplicate_request_ids": 0,
        "unparseable_lines": 1, "unparseable_frames": 1, "unrecognized_lines": 1,
    }
    assert (r["sessions"], r["interposer_version"], r["wall"]["duration_ms"], r["wall"]["last_frame"]) == (1, "0.1", 850, "2026-01-01T00:00:00.950000000Z")
    first, second = r["tool_calls"]
    assert (first["seq"], first["id"], first["tool"], first["arg_bytes"], first["retry"]) == (1, "2", "a", 21, False) and second["retry"] and "response" not in second
    assert (first["response"]["latency_ms"], first["response"]["is_tool_error"], first["response"]["text_len"]) == (100, True, 5)
    assert r["warnings"] == [
        "line 4: not valid JSON, skipped", "line 8: response id 9 has no logged request", "line 10: neither a header nor a frame, skipped",
        "result tokens unavailable: 0 of 1 tool-call responses carry result_full; rerun the interposer with --full-results to measure them",
    ]
    assert {(x.request_line, x.response_line, x.latency_ms) for x in frames.pairs(m).collect()} == {(1, 2, 50), (5, 6, 100)}
    stats = {x.method: (x.requests, x.notifications, x.responses, x.errors, x.result_bytes) for x in frames.method_stats(m).collect()}
    assert stats == {"initialize": (1, 0, 1, 0, 0), "tools/call": (2, 0, 1, 0, 7), "(unmatched)": (0, 0, 1, 1, 0), "notifications/x": (0, 1, 0, 0, 0)}


def test_a_log_of_oddities(spark, tmp_path):
    odd = [{"started_at": "x"}, {"interposer_version": "2"}, {"interposer_version": "1", "server_cmd": ["a", "b"]}, frame(1, "up", 1, method="m", id=None), frame(2, "c2s", 1, batch=True, items=[]), frame(3, "s2c", 1), frame(4, "s2c", 1, is_response=True)]
    (tmp_path / "odd.jsonl").write_text("\n".join(map(json.dumps, odd)))
    lines = readers.frame_lines(spark, f"file://{tmp_path}/odd.jsonl")
    r = json.loads(frames.reports(readers.frame_messages(lines), lines).toJSON().first())
    t = r["totals"]
    assert (t["frames"], t["batch_frames"], t["batch_messages"], t["requests"], t["unrecognized_lines"], t["unmatched_responses"]) == (4, 1, 0, 1, 2, 1) and "tool_call_result_tokens" not in t
    assert (r["sessions"], r["interposer_version"], r["interposer_versions"]) == (2, "2", ["2", "1"])
    assert r["warnings"] == [
        "line 1: neither a header nor a frame, skipped", 'line 4: unknown direction "up"', "line 6: message carries neither a method nor a response payload", "line 7: response id  has no logged request",
        "log carries 2 interposer versions ([2 1]); frames from different versions are not comparable and this report is not publishable", "log contains 2 sessions; one log per trial is the section 6 convention",
    ]


def test_result_tokens_need_every_full_result(spark, tmp_path):
    call = lambda i: frame(i * 10, "c2s", 1, method="tools/call", id=i, params_full={"name": "t"})
    answer = lambda i, **more: frame(i * 10 + 1, "s2c", 1, id=i, is_response=True, result_summary={"bytes": 4}, **more)
    for name, last, want in (("all", answer(2, result_full="xy"), 8), ("some", answer(2), None)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, [HEAD, call(1), answer(1, result_full="xy"), call(2), last])))
        m = readers.frame_messages(readers.frame_lines(spark, f"file://{tmp_path}/{name}.jsonl"), Letters)
        assert frames.totals(m).first().tool_call_result_tokens == want


class Letters:
    """Counts a text's characters as its tokens."""

    def encode_batch(self, texts):
        return texts


def test_result_summary(spark):
    texts = ['{"content":[{"type":"text","text":"h\u00e4"},{"type":"image"}],"isError":true}', '{"tools":[]}', None]
    rows = spark.createDataFrame([(x,) for x in texts], "r string").select(readers.result_summary(F.col("r")).alias("s")).collect()
    assert (rows[0].s.content_blocks, rows[0].s.text_len, rows[0].s.is_error) == (2, 3, True) and (rows[1].s.bytes, rows[1].s.content_blocks) == (12, None) and rows[2].s is None


def test_a_later_request_takes_an_ids_place(spark):
    rows = [("l", i, 0, d, k, "1", "m", "", 1, i * 10**9) for i, (d, k) in enumerate([("c2s", "request"), ("c2s", "request"), ("s2c", "response"), ("s2c", "response"), ("s2c", "request")])]
    m = spark.createDataFrame(rows, "log string, line long, item int, dir string, kind string, id string, method string, params string, bytes long, ts_ns long")
    states = [(r.state, r.unanswered) for r in frames.correlated(m).orderBy("line").collect()]
    assert states == [("first", False), ("duplicate", False), ("matched", False), ("unmatched", False), ("first", True)]
    assert frames.pairs(m).first().request_line == 1


def test_warnings_are_cut_and_counted(spark):
    rows = spark.createDataFrame([("l", i, 0, f"w{i}") for i in range(7)], "log string, line long, item int, warning string")
    assert frames.warnings(rows, 5).first().warnings == ["w0", "w1", "w2", "w3", "w4", "2 further warnings suppressed"]


def test_trials(spark):
    rows = [("1", "s", "c", "t", 1, 0, True, 4), ("1", "s", "c", "t", 1, 5, None, 1), ("1", "s", "c", "t", 2, 1, True, 2), ("1", "s", "c", "t", 3, 2, False, None), ("1", "s", "c", "t", 4, 3, True, 10), ("1", "s", "c", "t", 5, 4, True, 3)]
    t = spark.createDataFrame(rows, "suite_version string, server string, client string, task string, trial int, line_no long, success boolean, tokens long")
    last = trials.last_of_each(t)
    c = trials.cells(last, ("tokens",)).first()
    assert (c.trials, c.successes, c.failures, c.tokens_n, c.tokens_median, c.tokens_min, c.tokens_max) == (5, 3, 2, 4, 2.5, 1, 10)
    assert {(r.level, r.trials) for r in trials.totals(last).collect()} == {("all", 5), ("by_server", 5), ("by_client", 5)}
    assert trials.to_do(trials.matrix(t.select("suite_version", "server", "client", "task").distinct(), 7), t).count() == 2


def test_stack_keeps_absence_apart_from_zero(spark):
    rows = spark.createDataFrame([(1, "a", "ok", 900, 3), (1, "b", "auth", None, None), (2, "c", "ok", None, 2)], "stack long, server string, status string, total long, n_tools long")
    got = {(r.stack, r.mode): (r.total, r.low, r.high, r.excluded) for r in stack.totals(stack.by_mode(rows, "2026-01-01")).collect()}
    assert got[1, "naive"] == (900, 900, 900, 1) and got[1, "tool_search"] == (1700, 1400, 2000, 1) and got[1, "code_mode"] == (900, 900, 900, 1)
    assert got[2, "naive"] == (None, None, None, 1)


def test_leaderboard_puts_nulls_last_both_ways(spark):
    rows = spark.createDataFrame([("a", True, 5), ("b", True, None), ("c", False, 9), ("d", True, 7)], "server string, data_ok boolean, k long")
    assert [r.server for r in stack.leaderboard(rows, "k").collect()] == ["d", "a", "b", "c"]
    assert [r.server for r in stack.leaderboard(rows, "k", True).collect()] == ["a", "d", "b", "c"]
