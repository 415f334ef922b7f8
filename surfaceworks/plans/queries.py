"""One query for each operator of the reference's inventory, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import AUTH, REFUSALS, TIMEOUT, UNREACHABLE, WHEN_TO_USE
from ..functions import figures, ordered_json, text
from ..operators import acquisition, frames, hygiene, retrieval, stack, trials
from ..sources import readers
from ..stash import held
from . import bindings as b
from .registry import query, table

D = lambda x: f"CAST({x} AS DOUBLE)"
ROUND = lambda x, n: f"floor(({x}) * {D(10**n)} + {D(0.5)}) / {D(10**n)}"
PERCENT = lambda x: ROUND(f"({x}) * {D(100)}", 2)


@query(f"SELECT c_custkey AS id, array_to_string({b.sql_tokens('c_name')}, ' ') AS tokens FROM customer UNION ALL SELECT p_partkey, array_to_string({b.sql_tokens('p_name')}, ' ') FROM part")
def tokenize_names(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return c.unionByName(p).select("id", F.array_join(text.tokens(F.col("name")), " ").alias("tokens"))


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {b.sql_content('text')} AS w FROM documents)")
def content_words(spark, d):
    w = table(spark, d, "documents").select("doc_id", text.content_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


T = r"regexp_replace(regexp_replace(description, '^\s+', ''), '\s+$', '')"
ADEQUACY = rf"(CAST({T} <> '' AS INT) + CAST(length({T}) BETWEEN 20 AND 1000 AS INT) + CAST(len(list_filter(string_split_regex({T}, '\s+'), lambda x: x <> '')) >= 4 AND regexp_matches({T}, '^\p{{L}}') AS INT)) / {D(3)}"
SAYS = f"CAST(len(list_filter({b.sql_list(WHEN_TO_USE)}, lambda k: contains(lower(description), k))) > 0 AS DOUBLE)"


@query(f"WITH {b.TOOLS} SELECT server, tool, {ROUND(ADEQUACY, 4)} AS adequacy FROM tools")
def description_adequacy(spark, d):
    return b.tools(spark, d).select("server", "tool", text.rounded(text.adequacy(F.col("description")), 4).alias("adequacy"))


@query(f"WITH {b.TOOLS} SELECT server, {PERCENT(f'avg({SAYS})')} AS when_to_use_signal FROM tools GROUP BY server")
def when_to_use_signal(spark, d):
    return b.tools(spark, d).groupBy("server").agg(text.percent(F.avg(text.says_when(F.col("description")).cast("double"))).alias("when_to_use_signal"))


NAMES = rf"""names AS (SELECT server, name, CAST(regexp_full_match(name, '[A-Za-z0-9_-]{{1,128}}') AND count(*) OVER (PARTITION BY server, name) = 1 AS DOUBLE) AS ok,
  CAST(len(f) > 0 AND len(list_filter(f, lambda x: length(x) < 2 OR regexp_full_match(x, '\p{{Nd}}+'))) = 0 AS DOUBLE) AS strong, count(*) OVER (PARTITION BY server, style) AS alike
  FROM (SELECT server, name, {b.sql_fragments('name', 1, True)} AS f, CASE WHEN contains(name, '_') THEN 'snake' WHEN contains(name, '-') THEN 'kebab' WHEN contains(name, '.') THEN 'dotted' WHEN lower(name) <> name THEN 'camel' ELSE 'flat' END AS style FROM named)),
naming AS (SELECT server, {PERCENT(f"(avg(ok) + avg(strong) + max(alike) / CAST(count(*) AS DOUBLE)) / {D(3)}")} AS naming_clarity FROM names GROUP BY server)"""


@query(f"WITH named AS (SELECT p_brand AS server, p_name AS name FROM part UNION ALL SELECT c_mktsegment, c_name FROM customer), {NAMES} SELECT * FROM naming")
def naming_clarity(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("server"), F.col("p_name").alias("name"))
    return hygiene.naming(p.unionByName(table(spark, d, "customer").select(F.col("c_mktsegment").alias("server"), F.col("c_name").alias("name"))))


SIMILAR = f"""sets AS (SELECT server, tool, name, list_distinct({b.sql_content('descriptor')}) AS s FROM tools),
compared AS (SELECT x.server, x.tool AS ta, y.tool AS tb, x.name AS a, y.name AS b, len(list_intersect(x.s, y.s)) AS c, len(x.s) AS na, len(y.s) AS nb FROM sets x JOIN sets y ON x.server = y.server AND x.tool < y.tool WHERE len(x.s) > 0 AND len(y.s) > 0),
pairs AS (SELECT server, ta, tb, a, b, {ROUND('c / CAST(na + nb - c AS DOUBLE)', 4)} AS similarity FROM compared WHERE c / CAST(na + nb - c AS DOUBLE) >= {D(0.6)})"""


@query(f"WITH {b.TOOLS}, {SIMILAR} SELECT * FROM pairs")
def similar_pairs(spark, d):
    return hygiene.similar(b.tools(spark, d))


DISAMBIGUATION = f"""flagged AS (SELECT server, count(DISTINCT name) AS f FROM (SELECT server, a AS name FROM pairs UNION ALL SELECT server, b FROM pairs) GROUP BY server),
clear AS (SELECT t.server, CASE WHEN count(*) < 2 THEN {D(100)} ELSE {PERCENT(f"{D(1)} - coalesce(any_value(f), 0) / CAST(count(*) AS DOUBLE)")} END AS disambiguation FROM tools t LEFT JOIN flagged g ON t.server = g.server GROUP BY t.server)"""


@query(f"WITH {b.TOOLS}, {SIMILAR}, {DISAMBIGUATION} SELECT * FROM clear")
def disambiguation(spark, d):
    return hygiene.disambiguation(b.tools(spark, d))


@query(
    f"""WITH {b.TOOLS}, {SIMILAR}, {DISAMBIGUATION}, named AS (SELECT server, name FROM tools), {NAMES},
dims AS (SELECT server, {PERCENT(f'avg({ADEQUACY})')} AS description_adequacy, {PERCENT(f'avg({SAYS})')} AS when_to_use_signal FROM tools GROUP BY server),
scored AS (SELECT d.server, description_adequacy, when_to_use_signal, {D(100)} AS parameter_descriptions, {D(100)} AS enum_documentation, naming_clarity, disambiguation,
  {ROUND(f"(description_adequacy + when_to_use_signal + {D(100)} + {D(100)} + naming_clarity + disambiguation) / {D(6)}", 2)} AS score
  FROM dims d JOIN naming n ON d.server = n.server JOIN clear c ON d.server = c.server)
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM scored"""
)
def hygiene_grade(spark, d):
    return hygiene.graded(b.tools(spark, d))


@query(f"WITH {b.INDEX} SELECT server, n_docs, {ROUND('avgdl', 6)} AS avgdl FROM stats")
def bm25_index_stats(spark, d):
    return retrieval.server_stats(b.tools(spark, d)).withColumn("avgdl", text.rounded(F.col("avgdl"), 6))


@query(f"WITH {b.INDEX} SELECT server, term, df, {ROUND('idf', 6)} AS idf FROM idfs")
def bm25_idf(spark, d):
    return retrieval.term_stats(b.tools(spark, d)).withColumn("idf", text.rounded(F.col("idf"), 6))


@query(f"WITH {b.INDEX}, queries AS (SELECT s.server, CAST(item_id AS VARCHAR) AS query, {b.sql_content('text')} AS terms FROM benchmark, stats s), {b.SCORES} SELECT server, query, name, {ROUND('score', 4)} AS score, rank FROM ranked WHERE rank <= 3")
def bm25_search_top3(spark, d):
    tools = b.tools(spark, d)
    asked = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query"), text.content_words(F.col("text")).alias("terms"))
    return retrieval.search_everywhere(asked, tools).select("server", "query", "name", text.rounded(F.col("score"), 4).alias("score"), F.col("rank").cast("long").alias("rank"))


DERIVED = f"""bare AS (SELECT server, tool, name, list_filter({b.sql_content('description')}, lambda x: NOT list_contains({b.sql_tokens('name')}, x)) AS w FROM tools),
pair AS (SELECT server, tool, a, b, pos FROM (SELECT server, tool, unnest(w) AS a, unnest(list_concat(w[2:], [NULL])) AS b, generate_subscripts(w, 1) AS pos FROM bare) WHERE b IS NOT NULL),
valued AS (SELECT p.*, coalesce(x.idf, u.v) + coalesce(y.idf, u.v) AS s FROM pair p LEFT JOIN idfs x ON p.server = x.server AND p.a = x.term LEFT JOIN idfs y ON p.server = y.server AND p.b = y.term
  JOIN (SELECT server, ln({D(1)} + (n_docs + {D(0.5)}) / {D(0.5)}) AS v FROM stats) u ON p.server = u.server),
best AS (SELECT server, tool, a, b FROM (SELECT *, row_number() OVER (PARTITION BY server, tool ORDER BY s DESC, pos) AS k FROM valued) WHERE k = 1),
first_seen AS (SELECT server, tool, list(x ORDER BY i) AS u FROM (SELECT server, tool, x, min(i) AS i FROM (SELECT server, tool, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM bare) GROUP BY ALL) GROUP BY server, tool),
forms AS (
  SELECT server, tool, name, 0 AS no, 'leading' AS form, w[1:3] AS terms FROM bare WHERE len(w) > 0
  UNION ALL SELECT n.server, n.tool, n.name, 1, 'bigram', [a, b] FROM bare n JOIN best t ON n.server = t.server AND n.tool = t.tool
  UNION ALL SELECT n.server, n.tool, n.name, 2, 'content', u[1:12] FROM bare n JOIN first_seen f ON n.server = f.server AND n.tool = f.tool),
derived AS (SELECT server, tool, name, form, array_to_string(terms, ' ') AS text, terms FROM (SELECT *, row_number() OVER (PARTITION BY server, tool, array_to_string(terms, ' ') ORDER BY no) AS k FROM forms) WHERE k = 1)"""


@query(f"WITH {b.INDEX}, {DERIVED} SELECT server, tool, form, text FROM derived")
def derived_queries(spark, d):
    return retrieval.derived(b.tools(spark, d)).select("server", "tool", "form", "text")


RANKS = f"""{b.INDEX}, {DERIVED}, queries AS (SELECT server, tool, name, form, text, tool || chr(31) || form AS query, terms FROM derived), {b.SCORES},
own AS (SELECT q.server, q.tool, q.form, coalesce(min(r.rank), 0) AS rank FROM queries q LEFT JOIN ranked r ON q.server = r.server AND q.query = r.query AND q.name = r.name GROUP BY q.server, q.tool, q.form)"""


@query(
    f"""WITH {RANKS}, found AS (SELECT server, tool, bool_or(rank BETWEEN 1 AND 3) AS top3 FROM own GROUP BY ALL),
share AS (SELECT t.server, count(*) AS n_tools, {ROUND("avg(CAST(coalesce(top3, false) AS DOUBLE))", 4)} AS top3_fraction FROM tools t LEFT JOIN found f ON t.server = f.server AND t.tool = f.tool GROUP BY t.server),
back AS (SELECT server, count(*) AS n_queries, {ROUND(f"avg(CASE WHEN rank > 0 THEN {D(1)} / rank ELSE 0 END)", 4)} AS mrr FROM own GROUP BY server)
SELECT s.server, n_tools, coalesce(n_queries, 0) AS n_queries, top3_fraction, coalesce(mrr, 0) AS mrr FROM share s LEFT JOIN back b ON s.server = b.server"""
)
def retrievability(spark, d):
    return retrieval.retrievability(b.tools(spark, d))


@query(f"WITH {b.TALK} SELECT log, before_line AS request_line, line AS response_line, before_method AS method, CAST((ts_ns - before_ts) // 1000000 AS BIGINT) AS latency_ms FROM events WHERE kind = 'response' AND before = 'request'")
def request_response_pairs(spark, d):
    return frames.pairs(b.talk(spark, d))


@query(
    "SELECT user_id AS log, event_id AS line, row_number() OVER w AS seq, coalesce(lag(props) OVER w = props, false) AS is_retry FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"
)
def retries(spark, d):
    return frames.retries(b.calls(spark, d), "click").drop("item")


@query(
    f"""WITH {b.TALK}, named AS (SELECT t.*, CASE WHEN t.kind <> 'response' THEN t.method WHEN e.before = 'request' THEN e.before_method ELSE '(unmatched)' END AS m
  FROM talk t LEFT JOIN events e ON t.log = e.log AND t.line = e.line)
SELECT log, m AS method, count(*) FILTER (kind = 'request') AS requests, count(*) FILTER (kind = 'notification') AS notifications, count(*) FILTER (kind = 'response') AS responses,
  count(*) FILTER (is_rpc_error) AS errors, count(*) FILTER (is_tool_error) AS tool_errors, CAST(coalesce(sum(bytes) FILTER (kind <> 'response'), 0) AS BIGINT) AS params_bytes,
  CAST(coalesce(sum(tokens) FILTER (kind <> 'response'), 0) AS BIGINT) AS params_tokens, CAST(coalesce(sum(bytes) FILTER (kind = 'response'), 0) AS BIGINT) AS result_bytes FROM named GROUP BY log, m"""
)
def method_stats(spark, d):
    return frames.method_stats(b.talk(spark, d))


CALLS = """calls AS (SELECT log, line, tool, bytes, tokens, coalesce(lag(params) OVER (PARTITION BY log ORDER BY line) = params, false) AS again, row_number() OVER (PARTITION BY log ORDER BY line) AS seq FROM talk WHERE kind = 'request')"""


@query(
    f"""WITH {b.TALK}, {CALLS}, r AS (SELECT log, count(*) FILTER (again) AS retries FROM calls GROUP BY log),
s AS (SELECT log, count(*) FILTER (kind = 'response' AND before IS DISTINCT FROM 'request') AS unmatched_responses, count(*) FILTER (kind = 'request' AND before = 'request') AS duplicate_request_ids,
  count(*) FILTER (kind = 'request' AND after IS NULL) AS unmatched_requests, count(*) FILTER (kind = 'response' AND before = 'request') AS tool_responses,
  count(full_tokens) FILTER (kind = 'response' AND before = 'request') AS full_results, coalesce(sum(bytes) FILTER (kind = 'response' AND before = 'request'), 0) AS result_bytes,
  sum(full_tokens) FILTER (kind = 'response' AND before = 'request') AS result_tokens FROM events GROUP BY log),
t AS (SELECT log, count(*) AS frames, count(*) FILTER (dir = 'c2s') AS frames_c2s, count(*) FILTER (dir = 's2c') AS frames_s2c, sum(bytes) AS bytes, coalesce(sum(bytes) FILTER (dir = 'c2s'), 0) AS bytes_c2s,
  coalesce(sum(bytes) FILTER (dir = 's2c'), 0) AS bytes_s2c, count(*) FILTER (kind = 'request') AS requests, count(*) FILTER (kind = 'notification') AS notifications, count(*) FILTER (kind = 'response') AS responses,
  coalesce(sum(bytes) FILTER (kind = 'request'), 0) AS arg_bytes, coalesce(sum(tokens) FILTER (kind = 'request'), 0) AS arg_tokens,
  count(*) FILTER (is_rpc_error) AS jsonrpc_errors, count(*) FILTER (is_tool_error) AS tool_errors FROM talk GROUP BY log)
SELECT t.log, frames, frames_c2s, frames_s2c, CAST(bytes AS BIGINT) AS bytes, CAST(bytes_c2s AS BIGINT) AS bytes_c2s, CAST(bytes_s2c AS BIGINT) AS bytes_s2c, 0 AS batch_frames, 0 AS batch_messages, requests, notifications, responses,
  requests AS tool_calls, CAST(arg_bytes AS BIGINT) AS tool_call_arg_bytes, CAST(arg_tokens AS BIGINT) AS tool_call_arg_tokens, CAST(coalesce(result_bytes, 0) AS BIGINT) AS tool_call_result_bytes,
  CASE WHEN tool_responses > 0 AND tool_responses = full_results THEN CAST(result_tokens AS BIGINT) END AS tool_call_result_tokens, jsonrpc_errors, tool_errors, coalesce(retries, 0) AS retries,
  coalesce(unmatched_requests, 0) AS unmatched_requests, coalesce(unmatched_responses, 0) AS unmatched_responses, coalesce(duplicate_request_ids, 0) AS duplicate_request_ids,
  0 AS unparseable_lines, 0 AS unparseable_frames, 0 AS unrecognized_lines
FROM t LEFT JOIN s ON t.log = s.log LEFT JOIN r ON t.log = r.log"""
)
def frame_totals(spark, d):
    return frames.totals(b.talk(spark, d)).drop("tool_responses", "full_results")


@query(
    f"""WITH {b.RAW_TALK}
SELECT log, count(*) FILTER (frame) AS frames, count(*) FILTER (frame AND role <> 'assistant') AS frames_c2s, count(*) FILTER (frame AND role = 'assistant') AS frames_s2c,
  CAST(coalesce(sum(size) FILTER (frame), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(size) FILTER (frame AND role <> 'assistant'), 0) AS BIGINT) AS bytes_c2s, CAST(coalesce(sum(size) FILTER (frame AND role = 'assistant'), 0) AS BIGINT) AS bytes_s2c,
  count(*) FILTER (what = 'batch') AS batch_frames, 3 * count(*) FILTER (what = 'batch') AS batch_messages, count(*) FILTER (what = 'bad') AS unparseable_lines, count(*) FILTER (what = 'broken') AS unparseable_frames,
  count(*) FILTER (what = 'odd') + count(*) FILTER (what = 'batch') AS unrecognized_lines, count(*) FILTER (what = 'batch') + count(*) FILTER (what = 'plain' AND role = 'user') AS requests,
  count(*) FILTER (what = 'batch') + count(*) FILTER (what = 'plain' AND role NOT IN ('user', 'assistant')) AS notifications, count(*) FILTER (what = 'plain' AND role = 'assistant') AS responses,
  count(*) FILTER (what = 'batch') + count(*) FILTER (what = 'plain' AND role = 'user') AS tool_calls, count(*) FILTER (what = 'plain' AND role = 'assistant' AND size % 7 = 0) AS jsonrpc_errors,
  count(*) FILTER (what = 'plain' AND role = 'assistant' AND size % 11 = 0) AS tool_errors, CAST(coalesce(sum(size) FILTER (what = 'plain' AND role = 'user'), 0) + 2 * count(*) FILTER (what = 'batch') AS BIGINT) AS tool_call_arg_bytes
FROM raw_talk GROUP BY log"""
)
def raw_log_totals(spark, d):
    """Counters of logs with batches, headers, unreadable lines and frames of lines as they are written."""
    of_lines = held(readers.parsed_lines(b.raw_talk(spark, d)), "log-lines")
    out = frames.totals(held(readers.frame_messages(of_lines), "messages"), of_lines)
    return out.select(
        "log", "frames", "frames_c2s", "frames_s2c", "bytes", "bytes_c2s", "bytes_s2c", "batch_frames", "batch_messages", "unparseable_lines", "unparseable_frames", "unrecognized_lines", "requests", "notifications", "responses",
        "tool_calls", "jsonrpc_errors", "tool_errors", "tool_call_arg_bytes",
    )


@query(
    f"""WITH {b.RAW_TALK}, heads AS (SELECT log, line, 'v' || line % 3 AS version FROM raw_talk WHERE what = 'head'),
firsts AS (SELECT log, version, min(line) AS line FROM heads GROUP BY log, version), listed AS (SELECT log, string_agg(version, ' ' ORDER BY line) AS versions, count(*) AS n FROM firsts GROUP BY log)
SELECT r.log, count(h.line) AS sessions, arg_min(h.version, h.line) AS version, CASE WHEN any_value(n) > 1 THEN any_value(versions) END AS versions FROM raw_talk r LEFT JOIN heads h ON r.log = h.log AND r.line = h.line LEFT JOIN listed l ON r.log = l.log GROUP BY r.log"""
)
def log_sessions(spark, d):
    told = frames.sessions(readers.parsed_lines(b.raw_talk(spark, d)))
    return told.select("log", "sessions", "version", F.array_join("versions", " ").alias("versions"))


@query(
    f"""WITH {b.TALK}, {CALLS} SELECT c.log, c.seq, c.tool, c.bytes AS arg_bytes, c.tokens AS arg_tokens, c.again AS retry, after IS NOT DISTINCT FROM 'response' AS answered,
  CASE WHEN after = 'response' THEN after_bytes END AS result_bytes, CASE WHEN after = 'response' THEN after_tokens END AS result_tokens, CASE WHEN after = 'response' THEN after_error END AS is_tool_error,
  CASE WHEN after = 'response' THEN CAST((after_ts - ts_ns) // 1000000 AS BIGINT) END AS latency_ms FROM calls c JOIN events e ON c.log = e.log AND c.line = e.line"""
)
def tool_calls(spark, d):
    rows = frames.tool_calls(b.talk(spark, d))
    return rows.select("log", "seq", "tool", "arg_bytes", "arg_tokens", "retry", F.col("response").isNotNull().alias("answered"), "response.result_bytes", "response.result_tokens", "response.is_tool_error", "response.latency_ms")


@query(
    f"""WITH {b.TALK}, w AS (SELECT log, line, CASE WHEN kind = 'request' AND before = 'request' THEN 'line ' || line + 1 || ': request id 1 reused before the earlier one was answered'
  WHEN kind = 'response' AND before IS DISTINCT FROM 'request' THEN 'line ' || line + 1 || ': response id 1 has no logged request' END AS warning FROM events
  UNION ALL SELECT log, 2000000, 'result tokens unavailable: ' || count(full_tokens) || ' of ' || count(*) || ' tool-call responses carry result_full; rerun the interposer with --full-results to measure them'
    FROM events WHERE kind = 'response' AND before = 'request' GROUP BY log HAVING count(full_tokens) < count(*)
  UNION ALL SELECT DISTINCT log, 2000001, 'log has no header line, so interposer_version is unknown; section 5 withholds a result missing a version stamp' FROM talk)
SELECT log, string_agg(warning, '|' ORDER BY line) AS warnings, count(*) AS n FROM w WHERE warning IS NOT NULL GROUP BY log"""
)
def frame_warnings(spark, d):
    talk = b.talk(spark, d)
    lines = frames.lines_of(talk).select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in (("interposer_version", "string"), ("started_at", "string"), ("server_cmd", "array<string>"))])
    return frames.warnings(frames.found_warnings(talk, lines)).select("log", F.array_join("warnings", "|").alias("warnings"), F.size("warnings").cast("long").alias("n"))


@query("SELECT user_id AS log, arg_min(epoch_us(ts), event_id) * 1000 AS first_ts_ns, arg_max(epoch_us(ts), event_id) * 1000 AS last_ts_ns, CAST(trunc((arg_max(epoch_us(ts), event_id) - arg_min(epoch_us(ts), event_id)) / CAST(1000 AS DOUBLE)) AS BIGINT) AS wall_ms FROM events GROUP BY user_id")
def wall_span(spark, d):
    return frames.wall(b.calls(spark, d))


LAST = f"{b.TRIALS}, last_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY suite_version, server, client, task, trial ORDER BY line_no DESC) AS k FROM trials) WHERE k = 1)"


def _last(spark, d):
    return trials.last_of_each(b.trials(spark, d))


@query(f"WITH {LAST} SELECT server, client, task, trial, line_no, success FROM last_rows")
def trial_dedupe_last(spark, d):
    return _last(spark, d).select("server", "client", "task", "trial", "line_no", "success")


CLASSED = f"""{b.TRIALS}, classed AS (SELECT *, CASE WHEN coalesce(success, false) AND calls > 0 THEN 'tool_use_success' WHEN coalesce(success, false) THEN 'answered_without_tools' WHEN client_error THEN 'client_error'
  WHEN calls > 0 THEN 'tool_use_failed' WHEN len(list_filter({b.sql_list(REFUSALS)}, lambda m: contains(lower(message), m))) > 0 THEN 'declined' ELSE 'failed_no_tool_use' END AS classification FROM trials)"""


def _classed(spark, d):
    refused = F.size(text.refusal_markers(F.col("message"))) > 0
    return b.trials(spark, d).withColumn("classification", figures.trial_class(F.coalesce("success", F.lit(False)), F.col("client_error"), F.col("calls"), refused))


@query(f"WITH {CLASSED} SELECT suite_version, server, client, task, classification, count(*) AS n FROM classed GROUP BY ALL")
def trial_classification(spark, d):
    return trials.class_counts(_classed(spark, d))


@query(
    f"WITH {LAST} SELECT suite_version, server, client, task, count(*) AS trials, count(*) FILTER (success) AS successes, count(*) FILTER (success IS DISTINCT FROM true) AS failures, count(chars) AS chars_n, median(chars) AS chars_median, min(chars) AS chars_min, max(chars) AS chars_max FROM last_rows GROUP BY ALL"
)
def cell_stats(spark, d):
    return trials.cells(_last(spark, d), ("chars",))


NOW = """now AS (SELECT *, coalesce(client_json_valid, false) IS NOT TRUE OR (client = 'gemini' AND client_error_text IS NOT NULL) AS client_reported_error FROM last_rows),
classed AS (SELECT *, CASE WHEN coalesce(success, false) AND calls > 0 THEN 'tool_use_success' WHEN coalesce(success, false) THEN 'answered_without_tools' WHEN client_reported_error THEN 'client_error'
  WHEN calls > 0 THEN 'tool_use_failed' WHEN refused THEN 'declined' ELSE 'failed_no_tool_use' END AS classification FROM now)"""


@query(
    f"""WITH {LAST}, {NOW}, kinds AS (SELECT suite_version, server, client, task, string_agg(classification || '=' || n, ',' ORDER BY classification) AS classifications
  FROM (SELECT suite_version, server, client, task, classification, count(*) AS n FROM classed GROUP BY ALL) GROUP BY ALL)
SELECT c.suite_version, c.server, c.client, c.task, arg_min(model, suite_seq * 100 + trial) AS model, arg_min(coalesce(server_image_digest, '-'), suite_seq * 100 + trial) AS digest, count(*) AS trials,
  count(*) FILTER (success) AS successes, count(*) FILTER (success IS DISTINCT FROM true) AS failures, count(*) FILTER (timed_out) AS timed_out_trials, count(*) FILTER (client_json_valid IS DISTINCT FROM true) AS client_json_invalid_trials,
  count(*) FILTER (client_reported_error) AS client_reported_error_trials, count(*) FILTER (permission_denials > 0) AS permission_denial_trials, count(extra_path) AS fixture_extra_path_trials, count(*) FILTER (harness_suspect) AS harness_suspect_trials,
  any_value(k.classifications) AS classifications, count(chars) AS chars_n, median(chars) AS chars_median, min(chars) AS chars_min, max(chars) AS chars_max,
  coalesce(string_agg(chars, ',' ORDER BY suite_seq, trial), '') AS chars_values, coalesce(string_agg(DISTINCT extra_path, ',' ORDER BY extra_path), '') AS extra_paths, string_agg(line_no, ',' ORDER BY suite_seq, trial) AS series
FROM classed c JOIN kinds k ON c.suite_version = k.suite_version AND c.server = k.server AND c.client = k.client AND c.task = k.task GROUP BY ALL"""
)
def cell_rollup(spark, d):
    rows = trials.reclassified(_last(spark, d)).withColumn("server_image_digest", F.coalesce("server_image_digest", F.lit("-")))
    out = trials.rollup(rows, ("chars",), series=("line_no",), unions_of=("fixture_extra_paths",))
    text_of = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("classifications")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    plain = ["suite_version", "server", "client", "task", "model", F.col("server_image_digest").alias("digest"), "trials", "successes", "failures", "timed_out_trials", "client_json_invalid_trials", "client_reported_error_trials"]
    more = ["permission_denial_trials", "fixture_extra_path_trials", "harness_suspect_trials", kinds.alias("classifications"), *[F.col(f"chars.{c}").alias(f"chars_{c}") for c in ("n", "median", "min", "max")]]
    return out.select(*plain, *more, text_of(F.col("chars.values")).alias("chars_values"), F.array_join("fixture_extra_paths", ",").alias("extra_paths"), text_of(F.col("per_trial.line_no")).alias("series"))


@query(
    f"""WITH {b.TRIALS} SELECT count(*) - count(DISTINCT (suite_version, server, client, task, trial)) AS superseded_trial_rows, string_agg(DISTINCT suite_version, ',') AS suite_versions, count(DISTINCT suite_version) > 1 AS mixed_suite_versions,
  (SELECT bool_or(o_orderstatus = 'P') FROM orders) AS version_drift, (SELECT count(*) FILTER (o_orderstatus = 'P') FROM orders) AS n_drifted FROM trials"""
)
def run_flags(spark, d):
    footers = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") == "P").alias("version_drift"))
    out = trials.flags(b.trials(spark, d), footers)
    return out.select("superseded_trial_rows", F.array_join("suite_versions", ",").alias("suite_versions"), "mixed_suite_versions", "version_drift", F.size("drifted_runs").cast("long").alias("n_drifted"))


@query(
    f"""WITH {LAST} SELECT CASE WHEN grouping(server) = 1 AND grouping(client) = 1 THEN 'all' WHEN grouping(client) = 1 THEN 'by_server' ELSE 'by_client' END AS level, server, client,
  count(*) AS trials, count(*) FILTER (success) AS successes FROM last_rows GROUP BY GROUPING SETS ((), (server), (client))"""
)
def totals_grouping_sets(spark, d):
    return trials.totals(_last(spark, d))


@query(f"WITH {b.TRIALS} SELECT server, client, count(*) AS trials, count(*) FILTER (success) AS successes, count(*) FILTER (success IS DISTINCT FROM true) AS failures, count(chars) AS chars_n, median(chars) AS chars_median, min(chars) AS chars_min, max(chars) AS chars_max FROM trials GROUP BY ALL")
def published_distribution(spark, d):
    return trials.cells(b.trials(spark, d), ("chars",), ("server", "client"))


@query(
    "SELECT h.o_orderkey AS run_id, o_orderpriority AS suite, l_linenumber AS footer_line, l_returnflag AS ended FROM orders h LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS k FROM lineitem WHERE l_returnflag = 'R') WHERE k = 1) f ON h.o_orderkey = f.l_orderkey"
)
def runs_left_last_footer(spark, d):
    headers = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("suite"))
    f = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line_no"), F.col("l_linenumber").alias("footer_line"), F.col("l_returnflag").alias("ended"))
    return trials.runs(headers, f)


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def resume_anti_join(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return trials.to_do(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ("o_orderkey",))


@query("SELECT source AS server, lang AS client, trial FROM (SELECT DISTINCT source, lang FROM documents), (SELECT CAST(unnest(range(1, 6)) AS INT) AS trial)")
def trial_matrix(spark, d):
    return trials.matrix(table(spark, d, "documents").select(F.col("source").alias("server"), F.col("lang").alias("client")).distinct(), 5)


def _moded(spark, d):
    return stack.by_mode(b.stack_rows(spark, d), b.RUN_DATE)


@query(f"WITH {b.MODED} SELECT stack, mode, kind, servers, excluded, total, low, high, {ROUND(f'total / {D(200000)} * {D(100)}', 6)} AS window_percent FROM sums")
def stack_totals(spark, d):
    return stack.totals(_moded(spark, d)).withColumn("window_percent", text.rounded(F.col("window_percent"), 6))


@query(
    f"""WITH {b.MODED} SELECT stack, mode, server, tokens, {ROUND(f"CASE WHEN sum(tokens) OVER w = 0 THEN 0 ELSE tokens / CAST(sum(tokens) OVER w AS DOUBLE) END", 6)} AS fraction,
  {ROUND(f"tokens / CAST(greatest(max(tokens) OVER w, 1) AS DOUBLE)", 6)} AS bar, row_number() OVER (PARTITION BY stack, mode ORDER BY tokens DESC, server) AS place FROM moded WHERE reason IS NULL WINDOW w AS (PARTITION BY stack, mode)"""
)
def stack_attribution(spark, d):
    return stack.attribution(_moded(spark, d)).withColumn("fraction", text.rounded(F.col("fraction"), 6)).withColumn("bar", text.rounded(F.col("bar"), 6))


PRICES = [("openai_o200k", 15.0, 1.25, 0.1, 1024), ("claude", 0.8, 1.0, 0.25, None)]


@query(
    f"""WITH {b.MODED}, models(model) AS (VALUES ('openai_o200k'), ('claude'), ('gemini')),
prices(model, price, write, read, least) AS (VALUES ('openai_o200k', {D(15)}, {D(1.25)}, {D(0.1)}, 1024), ('claude', {D(0.8)}, {D(1)}, {D(0.25)}, NULL))
SELECT stack, mode, m.model, total, {ROUND(f"total * (price / {D(1000000)}) * write", 8)} AS cold, {ROUND(f"total * (price / {D(1000000)}) * read", 8)} AS cached,
  CASE WHEN price IS NOT NULL THEN least IS NULL OR total >= least END AS achievable, price IS NULL AS pricing_unavailable FROM sums, models m LEFT JOIN prices p ON m.model = p.model"""
)
def stack_dollars(spark, d):
    prices = spark.createDataFrame(PRICES, "model string, price double, write double, read double, least long")
    out = stack.priced(stack.totals(_moded(spark, d)), prices)
    return out.withColumn("cold", text.rounded(F.col("cold"), 8)).withColumn("cached", text.rounded(F.col("cached"), 8))


@query(f"WITH {b.MODED} SELECT stack, mode, server, reason FROM moded WHERE reason IS NOT NULL")
def stack_excluded(spark, d):
    return _moded(spark, d).where("reason is not null").select("stack", "mode", "server", "reason")


@query(f"WITH {b.MODED} SELECT mode, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM moded GROUP BY mode")
def mode_union(spark, d):
    return _moded(spark, d).groupBy("mode").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query(
    f"""WITH used AS (SELECT l_suppkey AS k, CAST(sum(l_quantity) AS BIGINT) AS naive, count(DISTINCT l_partkey) AS tools FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1),
rows AS (SELECT s_suppkey AS server, naive IS NOT NULL AS data_ok, naive, CASE WHEN tools > 0 THEN CAST(floor(naive / CAST(tools AS DOUBLE) + {D(0.5)}) AS BIGINT) END AS per_tool FROM supplier LEFT JOIN used ON s_suppkey = k)
SELECT *, row_number() OVER (ORDER BY data_ok DESC, per_tool DESC NULLS LAST, server) AS place FROM rows"""
)
def leaderboard_sorted(spark, d):
    line = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45")
    used = line.groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("naive"), F.countDistinct("l_partkey").alias("tools"))
    rows = table(spark, d, "supplier").join(used, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    status = F.when(F.col("naive").isNotNull(), "ok").otherwise("unreachable")
    rows = rows.select(F.col("s_suppkey").alias("server"), status.alias("status"), F.lit(None).cast("boolean").alias("available"), F.col("naive").alias("total"), F.col("tools").alias("tool_count"))
    return stack.leaderboard(stack.leaderboard_columns(rows).select("server", "data_ok", "naive", "per_tool"), "per_tool")


ERRORS = ("ok", "dial tcp: connection refused", "context deadline exceeded", "HTTP 403 Forbidden", "unexpected end of JSON")


@query(
    f"""WITH e AS (SELECT event_id, CASE CAST(floor(value) AS BIGINT) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'dial tcp: connection refused' WHEN 2 THEN 'context deadline exceeded' WHEN 3 THEN 'HTTP 403 Forbidden' ELSE 'unexpected end of JSON' END AS error FROM events)
SELECT event_id, CASE WHEN error IS NULL THEN 'ok' WHEN len(list_filter({b.sql_list(UNREACHABLE)}, lambda p: contains(lower(error), p))) > 0 THEN 'unreachable'
  WHEN len(list_filter({b.sql_list(TIMEOUT)}, lambda p: contains(lower(error), p))) > 0 THEN 'timeout' WHEN len(list_filter({b.sql_list(AUTH)}, lambda p: contains(lower(error), p))) > 0 THEN 'auth' ELSE 'protocol_error' END AS status FROM e"""
)
def failure_classifier(spark, d):
    e = table(spark, d, "events")
    which = F.floor("value").cast("long") % 5
    error = F.when(which == 1, ERRORS[1]).when(which == 2, ERRORS[2]).when(which == 3, ERRORS[3]).when(which != 0, ERRORS[4])
    return e.select("event_id", figures.failure_class(error).alias("status"))


@query("SELECT CASE WHEN quality IS NULL THEN 'unreachable' WHEN quality = 0 THEN 'auth' ELSE 'ok' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1 HAVING status <> 'ok'")
def failures_by_class(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "unreachable").when(F.col("quality") == 0, "auth").otherwise("ok")
    return stack.failures(rows.select(status.alias("status")))


@query(
    """WITH served AS (SELECT DISTINCT source AS server, lang AS tool FROM documents), client AS (SELECT source AS server, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'mcp_' || source || '_' || lang END AS name, doc_id % 3 AS calls FROM documents),
wire AS (SELECT source AS server, lang AS tool, doc_id % 2 AS calls FROM documents),
c AS (SELECT server, name, sum(calls) AS n FROM client GROUP BY ALL), w AS (SELECT server, tool, sum(calls) AS n FROM wire GROUP BY ALL)
SELECT s.server, CAST(sum(greatest(coalesce(a.n, 0) + coalesce(p.n, 0) - coalesce(w.n, 0), 0)) AS BIGINT) AS gap FROM served s LEFT JOIN c a ON a.server = s.server AND a.name = s.tool
  LEFT JOIN c p ON p.server = s.server AND p.name = 'mcp_' || s.server || '_' || s.tool LEFT JOIN w ON w.server = s.server AND w.tool = s.tool GROUP BY s.server"""
)
def tool_call_gap(spark, d):
    docs = table(spark, d, "documents")
    server, even = F.col("source").alias("server"), F.col("doc_id") % 2 == 0
    name = F.when(even, F.col("lang")).otherwise(F.concat_ws("_", F.lit("mcp"), "source", "lang"))
    client = docs.select(server, name.alias("name"), (F.col("doc_id") % 3).alias("calls"))
    wire = docs.select(server, F.col("lang").alias("tool"), (F.col("doc_id") % 2).alias("calls"))
    return stack.tool_call_gap(docs.select(server, F.col("lang").alias("tool")).distinct(), client, wire)


@query(f"SELECT conv_id, turn, array_to_string(list_filter({b.sql_list(REFUSALS)}, lambda m: contains(lower(text), m)), '|') AS markers FROM conversations")
def refusal_markers(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.refusal_markers(F.col("text")), "|").alias("markers"))


@query("SELECT c_mktsegment AS path, CAST(c_nationkey AS BIGINT) AS n FROM customer EXCEPT ALL SELECT c_mktsegment, CAST(s_nationkey AS BIGINT) FROM supplier, (SELECT DISTINCT c_mktsegment FROM customer)")
def path_except(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("path"), F.col("c_nationkey").cast("long").alias("n"))
    paths = F.array_sort(F.collect_set("path")).alias("paths")  # five segments
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("n")).agg(F.count("*").alias("times"))
    allowed = s.crossJoin(F.broadcast(c.agg(paths))).select("n", "times", F.explode("paths").alias("path"))
    return acquisition.extra_paths(c, allowed.select("path", "n", "times"), ("path", "n"))


@query("SELECT p_partkey, regexp_replace(lower(trim(replace(p_name, ' ', '._'))), '[-_.]+', '-', 'g') AS package FROM part")
def deps_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", text.package_name(F.replace("p_name", F.lit(" "), F.lit("._"))).alias("package"))


@query("SELECT source || '/' || (doc_id // 100) AS server, sha256(string_agg(text, '' ORDER BY doc_id)) AS wire_sha256, count(*) AS pages FROM documents GROUP BY 1")
def wire_digest(spark, d):
    # a digest needs its pages in one place; a surface has at most 200 pages, here 100 documents
    server = F.concat_ws("/", F.col("source"), F.floor(F.col("doc_id") / 100).cast("string"))
    pages = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    whole = F.array_join(F.transform(pages, lambda p: p["text"]), "")
    return table(spark, d, "documents").groupBy(server.alias("server")).agg(F.sha2(whole, 256).alias("wire_sha256"), F.count("*").alias("pages"))


@query("SELECT s_suppkey, '?servers=' || replace(n_name, ' ', '+') || '%2C' || s_suppkey || '&mode=naive&model=claude' AS link FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def permalinks(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", figures.permalink(F.array("n_name", F.col("s_suppkey").cast("string")), F.lit("naive"), F.lit("claude")).alias("link"))


PARAMS_SQL = "SELECT event_id, '{' || chr(34) || 'event' || chr(34) || ':' || chr(34) || event_type || chr(34) || ',' || chr(34) || 'k' || chr(34) || ':' || json_extract_string(props, '$.k') || '}' AS params FROM events"


@query(PARAMS_SQL)
def params_canonical(spark, d):
    raw = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "event": "'), F.col("event_type"), F.lit('"}'))
    return table(spark, d, "events").select("event_id", ordered_json.params(raw).alias("params"))
