"""Analysis of JSON-RPC frame logs: which response answers which request, retries, totals, warnings.

``messages``: one row per message with log, line, item, dir, kind (request, response, notification,
unparseable, unrecognised), id (compact text or null), method, params (canonical text), tool, bytes
and batch of its frame, ts, ts_ns, arg_bytes, arg_tokens, result_bytes, result_tokens,
content_blocks, text_len, rpc_error, is_rpc_error, is_tool_error. ``lines``: one row per line of the
log with log, line, line_kind (header, frame, unreadable, unrecognised), dir, bytes, ts, batch and
what a header says.

Requests and responses of a key are neighbours in the order of the log: a response is matched if what
precedes it is a request, a request repeats an id if what precedes it is a request, and stays
unanswered if it is the last. ``ordered.neighbours`` finds them, in windows or, where one log or id has
too many messages for a task, in ranges. The rest are aggregations, in which no log needs a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.figures import epoch_ns
from ..stash import held
from .ordered import MOST_ROWS, neighbours

TOOL_CALL = "tools/call"
_AT = ("line", "item")


def opposite(direction: Column) -> Column:
    return F.when(direction == "c2s", "s2c").otherwise("c2s")


def span_ms(start_ns: Column, end_ns: Column) -> Column:
    """Whole milliseconds, truncated; null if either end is."""
    return F.call_function("div", end_ns - start_ns, F.lit(1_000_000).cast("long"))


def correlated(messages: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Requests, and all responses, with state: matched / unmatched for responses, first / duplicate for requests.

    A matched response has its request's line, method and place among the calls; a request has its
    answer, if it got one before another request took its id.
    """
    key = F.when(F.col("kind") == "request", opposite(F.col("dir"))).otherwise(F.col("dir"))
    events = messages.where("kind = 'response' or (kind = 'request' and id is not null)").withColumn("key_dir", key).withColumn("key_id", F.coalesce("id", F.lit("")))
    events = neighbours(events, ["log", "key_dir", "key_id"], list(_AT), before=["kind", "line", "method", "ts_ns"], after=["kind", "line", "item"], most_rows=most_rows)
    response = F.col("kind") == "response"
    asked = F.coalesce(F.col("before.kind") == "request", F.lit(False))
    return events.select(
        *messages.columns, "key_dir", "key_id",
        F.when(response, F.when(asked, "matched").otherwise("unmatched")).when(asked, "duplicate").otherwise("first").alias("state"),
        F.when(response & asked, F.col("before.line")).alias("request_line"),
        F.when(response & asked, F.col("before.method")).alias("request_method"),
        F.when(response & asked, span_ms(F.col("before.ts_ns"), F.col("ts_ns"))).alias("latency_ms"),
        (~response & F.col("after").isNull()).alias("unanswered"),
        F.when(~response & (F.col("after.kind") == "response"), F.struct("after.line", "after.item")).alias("answer"),
    )


def pairs(messages: DataFrame) -> DataFrame:
    """(log, request_line, response_line, method, latency_ms) of answered requests."""
    out = correlated(messages).where("state = 'matched'")
    return out.select("log", "request_line", F.col("line").alias("response_line"), F.col("request_method").alias("method"), "latency_ms")


def _calls(method: str = TOOL_CALL) -> Column:
    return (F.col("kind") == "request") & (F.col("method") == method)


def retries(messages: DataFrame, method: str = TOOL_CALL, most_rows: int = MOST_ROWS) -> DataFrame:
    """(log, line, item, seq, is_retry) of calls: a retry has the canonical parameters of the call just before it in the log."""
    calls = messages.where(_calls(method)).select("log", "line", "item", "params")
    calls = neighbours(calls, ["log"], list(_AT), before=["params"], place="seq", most_rows=most_rows)
    return calls.select("log", "line", "item", "seq", F.coalesce(F.col("before.params") == F.col("params"), F.lit(False)).alias("is_retry"))


def tool_calls(messages: DataFrame) -> DataFrame:
    """One row per call: log, seq, id, tool, ts, arg_bytes, arg_tokens, retry, and response, which is null if none came.

    response: struct<ts, result_bytes, content_blocks, text_len, is_tool_error, rpc_error, result_tokens, latency_ms>.
    """
    asked = correlated(messages.where("kind in ('request', 'response')"))
    calls = asked.where(_calls()).select("log", "line", "item", "id", "tool", "ts", "arg_bytes", "arg_tokens", F.col("answer.line").alias("a_line"), F.col("answer.item").alias("a_item"))
    fields = [F.coalesce(c, F.lit(0)).alias(c) if c == "result_bytes" else F.col(c) for c in ("ts", "result_bytes", "content_blocks", "text_len", "is_tool_error", "rpc_error", "result_tokens", "latency_ms")]
    answers = asked.where("state = 'matched'").select("log", F.col("line").alias("a_line"), F.col("item").alias("a_item"), F.struct(*fields).alias("response"))
    rows = calls.join(retries(messages), ["log", "line", "item"]).join(answers, ["log", "a_line", "a_item"], "left")
    return rows.select("log", "seq", "id", "tool", "ts", "arg_bytes", "arg_tokens", F.col("is_retry").alias("retry"), "response")


def method_stats(messages: DataFrame) -> DataFrame:
    """(log, method, requests, notifications, responses, errors, tool_errors, params_bytes, params_tokens, result_bytes).

    Responses count under the method of their request, unmatched ones under a method of their own.
    """
    matched = correlated(messages).where("state = 'matched'").select("log", "line", "item", F.col("request_method").alias("m"))
    rows = messages.where("kind in ('request', 'response', 'notification')").join(matched, ["log", "line", "item"], "left")
    response = F.col("kind") == "response"
    name = F.when(response, F.coalesce("m", F.lit(C.UNMATCHED))).otherwise(F.col("method"))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long").alias
    return rows.groupBy("log", name.alias("method")).agg(
        F.count_if(F.col("kind") == "request").alias("requests"), F.count_if(F.col("kind") == "notification").alias("notifications"), F.count_if(response).alias("responses"),
        F.count_if(response & F.col("is_rpc_error")).alias("errors"), F.count_if(response & F.col("is_tool_error")).alias("tool_errors"),
        total("arg_bytes", ~response)("params_bytes"), total("arg_tokens", ~response)("params_tokens"), total("result_bytes", response)("result_bytes"),
    )


def lines_of(messages: DataFrame) -> DataFrame:
    """The lines of a log of which only the messages of its frames are at hand."""
    return messages.groupBy("log", "line").agg(F.lit("frame").alias("line_kind"), *[F.first(c).alias(c) for c in ("dir", "bytes", "ts", "batch")], F.count("*").alias("items"))


def totals(messages: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Per log the 25 counters of its frames, messages, calls, errors and oddities.

    A frame's bytes count once, and a batch is one frame. JSON-RPC errors and results that call
    themselves errors are counted apart. tool_call_result_tokens is null, not 0, unless every answered
    call's response has its tokens.
    """
    lines = lines_of(messages) if lines is None else lines
    frame, batch = F.col("line_kind") == "frame", (F.col("line_kind") == "frame") & F.col("batch")
    to, back = frame & (F.col("dir") == "c2s"), frame & (F.col("dir") == "s2c")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long").alias
    of_lines = lines.groupBy("log").agg(
        F.count_if(frame).alias("frames"), F.count_if(to).alias("frames_c2s"), F.count_if(back).alias("frames_s2c"),
        total("bytes", frame)("bytes"), total("bytes", to)("bytes_c2s"), total("bytes", back)("bytes_s2c"),
        F.count_if(batch).alias("batch_frames"), total("items", batch)("batch_messages"),
        F.count_if(F.col("line_kind") == "unreadable").alias("unparseable_lines"), F.count_if(F.col("line_kind") == "unrecognised").alias("odd_lines"),
    )
    is_a = lambda kind: F.col("kind") == kind
    of_messages = messages.groupBy("log").agg(
        F.count_if(is_a("request")).alias("requests"), F.count_if(is_a("notification")).alias("notifications"), F.count_if(is_a("response")).alias("responses"),
        F.count_if(_calls()).alias("tool_calls"), total("arg_bytes", _calls())("tool_call_arg_bytes"), total("arg_tokens", _calls())("tool_call_arg_tokens"),
        F.count_if(is_a("response") & F.col("is_rpc_error")).alias("jsonrpc_errors"), F.count_if(is_a("response") & F.col("is_tool_error")).alias("tool_errors"),
        F.count_if(is_a("unparseable")).alias("unparseable_frames"), F.count_if(is_a("unrecognised")).alias("odd_messages"),
    )
    answered = (F.col("state") == "matched") & (F.col("request_method") == TOOL_CALL)
    full = F.count_if(answered & F.col("result_tokens").isNotNull())
    states = correlated(messages).groupBy("log").agg(
        F.count_if(F.col("state") == "unmatched").alias("unmatched_responses"), F.count_if(F.col("state") == "duplicate").alias("duplicate_request_ids"), F.count_if("unanswered").alias("unmatched_requests"),
        total("result_bytes", answered)("tool_call_result_bytes"), F.when((full == F.count_if(answered)) & (full > 0), F.sum(F.when(answered, F.col("result_tokens")))).cast("long").alias("tool_call_result_tokens"),
        F.count_if(answered).alias("tool_responses"), full.alias("full_results"),
    )
    repeated = retries(messages).groupBy("log").agg(F.count_if("is_retry").alias("retries"))
    out = of_lines.join(of_messages, "log", "left").join(states, "log", "left").join(repeated, "log", "left")
    zero = [c for c in out.columns if c not in ("log", "tool_call_result_tokens")]
    out = out.fillna(0, zero).withColumn("unrecognized_lines", F.col("odd_lines") + F.col("odd_messages"))
    return out.drop("odd_lines", "odd_messages")


def wall(messages: DataFrame) -> DataFrame:
    """(log, first_ts_ns, last_ts_ns, wall_ms): first and last stamp in the order of the file."""
    stamped = messages.where("ts_ns is not null")
    at = F.struct(*_AT)
    out = stamped.groupBy("log").agg(F.min_by("ts_ns", at).alias("first_ts_ns"), F.max_by("ts_ns", at).alias("last_ts_ns"))
    return out.withColumn("wall_ms", span_ms(F.col("first_ts_ns"), F.col("last_ts_ns")))


def found_warnings(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """(log, line, item, warning) of all that is odd in a log, in its order; what is known at the end only has the last places."""
    # a log's lines are numbered from 1 in its warnings
    number = (F.col("line") + 1).cast("long")
    say = lambda text, *of: F.format_string(text.replace("%d", "%s"), *[x.cast("string") for x in of])
    of_line = F.when(F.col("line_kind") == "unreadable", say(C.BAD_LINE, number)).when(F.col("line_kind") == "unrecognised", say(C.ODD_LINE, number)).when(
        (F.col("line_kind") == "frame") & ~F.col("dir").isin("c2s", "s2c"), say(C.ODD_DIRECTION, number, F.col("dir"))
    )
    first = lines.select("log", "line", F.lit(-1).alias("item"), of_line.alias("warning"))
    odd = messages.where("kind = 'unrecognised'").select("log", "line", "item", say(C.ODD_MESSAGE, number).alias("warning"))
    key = F.coalesce("id", F.lit(""))
    state = F.when(F.col("state") == "duplicate", say(C.REUSED_ID, number, key)).when(F.col("state") == "unmatched", say(C.LOST_RESPONSE, number, key))
    states = correlated(messages).select("log", "line", "item", state.alias("warning"))
    counted, told = totals(messages, lines), sessions(lines)
    last = lambda rows, item, when, text: rows.where(when).select("log", F.lit(2**62).alias("line"), F.lit(item).alias("item"), text.alias("warning"))
    ends = [
        last(counted, 0, "tool_responses > full_results", say(C.NO_RESULT_TOKENS, F.col("full_results"), F.col("tool_responses"))),
        last(told, 1, "versions is not null", say(C.MIXED_VERSIONS, F.size("versions"), F.array_join("versions", " "))),
        last(told, 2, "sessions = 0", F.lit(C.NO_HEADER)), last(told, 3, "sessions > 1", say(C.MANY_SESSIONS, F.col("sessions"))),
    ]
    out = first.unionByName(odd).unionByName(states)
    for x in ends:
        out = out.unionByName(x)
    return out.where("warning is not null")


def warnings(found: DataFrame, most: int = C.MOST_WARNINGS) -> DataFrame:
    """(log, warnings): the first ``most`` of (log, line, item, warning), then how many more there were."""
    # a limited rank: Spark keeps the first ones of each task before they meet
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("log").orderBy(*_AT))).where(F.col("k") <= most)
    kept = first.groupBy("log").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "warning"))), lambda x: x["warning"]).alias("w"))
    kept = kept.join(found.groupBy("log").agg(F.count("*").alias("n")), "log")
    more = F.when(F.col("n") > most, F.array(F.format_string(C.MORE_WARNINGS, F.col("n") - most))).otherwise(F.array().cast("array<string>"))
    return kept.select("log", F.concat("w", more).alias("warnings"))


def sessions(lines: DataFrame) -> DataFrame:
    """(log, sessions, version, started_at, server_cmd, versions) of the header lines; versions, in the order seen, only if they differ."""
    head = F.col("line_kind") == "header"
    first = lambda c: F.min_by(c, F.when(head, F.col("line")))
    each = lines.where(head).groupBy("log", "interposer_version").agg(F.min("line").alias("line"))
    seen = each.groupBy("log").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "interposer_version"))), lambda x: x["interposer_version"]).alias("versions"))
    rows = lines.groupBy("log").agg(F.count_if(head).alias("sessions"), *[F.when(F.count_if(head) > 0, first(c)).alias(n) for c, n in (("interposer_version", "version"), ("started_at", "started_at"), ("server_cmd", "server_cmd"))])
    rows = rows.join(seen, "log", "left")
    return rows.withColumn("versions", F.when(F.size("versions") > 1, F.col("versions")))


def reports(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """One nested row per log: its header's stamps, wall, totals, tool_calls, methods and warnings, as a trial's report holds them. Runs jobs."""
    messages, lines = held(messages, "messages"), held(lines, "log-lines")  # read and parsed once for all that follows
    stamps = lines.where("line_kind = 'frame' and ts <> ''").groupBy("log").agg(F.min_by("ts", "line").alias("first_frame"), F.max_by("ts", "line").alias("last_frame"))
    counted = totals(messages, lines).drop("tool_responses", "full_results")
    nested = counted.select("log", F.struct(*[c for c in counted.columns if c != "log"]).alias("totals"))
    listed = lambda rows, name, key: rows.groupBy("log").agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in rows.columns if c not in ("log", key)]))).alias(name))
    calls, methods = tool_calls(messages), method_stats(messages)
    # a response is no part of what calls are sorted by: seq alone differs already
    out = sessions(lines).join(nested, "log").join(stamps, "log", "left").join(listed(calls, "tool_calls", "seq"), "log", "left")
    out = out.join(listed(methods, "methods", "method"), "log", "left").join(warnings(found_warnings(messages, lines)), "log", "left")
    span = F.struct("first_frame", "last_frame", span_ms(epoch_ns(F.col("first_frame")), epoch_ns(F.col("last_frame"))).alias("duration_ms")).alias("wall")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("log", F.col("version").alias("interposer_version"), F.col("versions").alias("interposer_versions"), "sessions", "started_at", "server_cmd", span, "totals", none("tool_calls"), none("methods"), none("warnings"))
