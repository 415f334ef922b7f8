"""How the star and text tables stand in for surfaces, frame logs, trials and stacks.

Each binding is a DataFrame and, for the oracles, the same as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import STOPWORDS
from ..operators import stack
from .registry import table


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_fragments(c: str, least: int = 2, digit_runs: bool = False) -> str:
    s = rf"regexp_replace(regexp_replace({c}, '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    if digit_runs:
        s = rf"regexp_replace(regexp_replace({s}, '(\p{{L}})(\p{{Nd}})', '\1 \2', 'g'), '(\p{{Nd}})(\p{{L}})', '\1 \2', 'g')"
    return rf"list_filter(string_split_regex({s}, '[^\p{{L}}\p{{Nd}}]+'), lambda x: length(x) >= {least})"


def sql_tokens(c: str) -> str:
    return f"list_transform({sql_fragments(c)}, lambda x: lower(x))"


def sql_content(c: str) -> str:
    return f"list_filter({sql_tokens(c)}, lambda x: NOT list_contains({sql_list(STOPWORDS)}, x))"


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: a source is a server, a document one of its tools."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return d.select(
        F.col("source").alias("server"), F.col("doc_id").alias("tool"), name.alias("name"), F.lit(None).cast("string").alias("title"), F.col("text").alias("description"),
        F.concat_ws(" ", name, F.col("text")).alias("descriptor"),
    )


TOOLS = "tools AS (SELECT source AS server, doc_id AS tool, 'doc_' || doc_id AS name, text AS description, 'doc_' || doc_id || ' ' || text AS descriptor FROM documents)"

INDEX = f"""{TOOLS},
words AS (SELECT server, tool, name, {sql_tokens('descriptor')} AS w FROM tools),
lens AS (SELECT server, tool, name, len(w) AS dl FROM words),
stats AS (SELECT server, count(*) AS n_docs, avg(dl) AS avgdl FROM lens GROUP BY server),
posts AS (SELECT server, tool, term, count(*) AS tf FROM (SELECT server, tool, unnest(w) AS term FROM words) GROUP BY ALL),
dfs AS (SELECT server, term, count(*) AS df FROM posts GROUP BY ALL),
idfs AS (SELECT d.server, term, df, ln(CAST(1 AS DOUBLE) + (n_docs - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) AS idf FROM dfs d JOIN stats s ON d.server = s.server)"""

SCORES = """parts AS (SELECT p.server, p.tool, l.name, p.term,
  i.idf * (p.tf * CAST(2.2 AS DOUBLE)) / (p.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * l.dl / s.avgdl)) AS part
  FROM posts p JOIN lens l ON p.server = l.server AND p.tool = l.tool JOIN stats s ON p.server = s.server JOIN idfs i ON p.server = i.server AND p.term = i.term),
asked AS (SELECT server, query, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM queries),
hits AS (SELECT a.server, a.query, p.tool, p.name, list_reduce(list(p.part ORDER BY a.pos), lambda x, y: x + y) AS score
  FROM asked a JOIN parts p ON a.server = p.server AND a.term = p.term GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY server, query ORDER BY score DESC, name, tool) AS rank FROM hits)"""


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3: a conversation is a log; a user turn a call, an assistant turn a response, a system turn a notification.

    A quarter of a text's characters stands in for its tokens; every fifth length has no full result,
    every seventh is a JSON-RPC error, every eleventh a result that calls itself an error.
    """
    c = table(spark, sf_dir, "conversations")
    role, size, quarter = F.col("role"), F.octet_length("text").cast("long"), F.expr("length(text) div 4")
    response = role == "assistant"
    return c.select(
        F.col("conv_id").alias("log"), F.col("turn").alias("line"), F.lit(0).alias("item"), F.when(response, "s2c").otherwise("c2s").alias("dir"), size.alias("bytes"), F.lit(False).alias("batch"), F.lit("").alias("ts"),
        F.when(role == "user", "request").when(response, "response").otherwise("notification").alias("kind"),
        F.when(role != "system", F.lit("1")).alias("id"), F.when(role == "user", "tools/call").when(role == "system", "notify").alias("method"),
        F.when(role == "user", F.col("text")).alias("params"), F.substring("text", 1, 3).alias("tool"), (F.col("turn") * 1_000_000_000).alias("ts_ns"), F.when(response, 0).otherwise(size).alias("arg_bytes"),
        F.when(response, 0).otherwise(quarter).alias("arg_tokens"), F.when(response, size).otherwise(0).alias("result_bytes"), F.when(response & (F.length("text") % 5 != 0), quarter).alias("result_tokens"),
        F.lit(None).cast("long").alias("content_blocks"), F.lit(None).cast("long").alias("text_len"), F.lit(None).cast("struct<code:int,message:string>").alias("rpc_error"),
        (response & (F.length("text") % 7 == 0)).alias("is_rpc_error"), (response & (F.length("text") % 11 == 0)).alias("is_tool_error"),
    )


TALK = """talk AS (SELECT conv_id AS log, turn AS line, CASE WHEN role = 'assistant' THEN 's2c' ELSE 'c2s' END AS dir,
  CASE role WHEN 'user' THEN 'request' WHEN 'assistant' THEN 'response' ELSE 'notification' END AS kind,
  CASE role WHEN 'user' THEN 'tools/call' WHEN 'system' THEN 'notify' END AS method, text AS params, octet_length(encode(text)) AS bytes, length(text) // 4 AS tokens,
  CASE WHEN length(text) % 5 <> 0 THEN length(text) // 4 END AS full_tokens, turn * 1000000000 AS ts_ns, role = 'assistant' AND length(text) % 7 = 0 AS is_rpc_error,
  role = 'assistant' AND length(text) % 11 = 0 AS is_tool_error, role <> 'system' AS keyed, left(text, 3) AS tool FROM conversations),
events AS (SELECT *, lag(kind) OVER o AS before, lag(line) OVER o AS before_line, lag(method) OVER o AS before_method, lag(ts_ns) OVER o AS before_ts, lead(kind) OVER o AS after,
  lead(bytes) OVER o AS after_bytes, lead(full_tokens) OVER o AS after_tokens, lead(ts_ns) OVER o AS after_ts, lead(is_tool_error) OVER o AS after_error
  FROM talk WHERE keyed WINDOW o AS (PARTITION BY log ORDER BY line))"""


def raw_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 as lines of a log file (file, line, text): headers, batches of three, unreadable and unknown lines, frames that can't be read, plain frames."""
    c = table(spark, sf_dir, "conversations")
    size, k = F.octet_length("text"), (F.col("conv_id") + 3 * F.col("turn")) % 11
    to = F.when(F.col("role") == "assistant", "s2c").otherwise("c2s")
    frame = '{"ts":"","dir":"%s","size_bytes":%d,'
    args = F.concat(F.lit('"'), F.repeat(F.lit("a"), size - 2), F.lit('"'))
    call = F.format_string('"method":"tools/call","id":%d,"params_full":%s}', "turn", F.when(size >= 2, args).otherwise(F.repeat(F.lit("1"), size)))
    answer = F.format_string('"id":%d,"is_response":true,"error":%s,"result_summary":{"is_error":%s,"bytes":3}}', "turn", F.when(size % 7 == 0, '{"code":1,"message":"x"}').otherwise("null"), (size % 11 == 0).cast("string"))
    plain = F.concat(F.format_string(frame, to, size), F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", answer).otherwise('"method":"notify"}'))
    batch = F.concat(F.format_string(frame, to, size), F.lit('"batch":true,"items":[{"method":"tools/call","id":"b","params_full":{}},{"method":"x"},{"neither":[1,2]}]}'))
    broken = F.concat(F.format_string(frame, to, size), F.lit('"unparseable":true}'))
    head = F.format_string('{"interposer_version":"v%d"}', F.col("turn") % 3)
    line = F.when(k == 0, head).when(k == 1, batch).when(k == 2, "{not json").when(k == 3, '{"some":"thing"}').when(k == 4, broken).otherwise(plain)
    return c.select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), line.alias("text"))


RAW_TALK = """raw_talk AS (SELECT *, what IN ('batch', 'broken', 'plain') AS frame FROM (SELECT conv_id AS log, turn AS line, role, octet_length(encode(text)) AS size,
  CASE (conv_id + 3 * turn) % 11 WHEN 0 THEN 'head' WHEN 1 THEN 'batch' WHEN 2 THEN 'bad' WHEN 3 THEN 'odd' WHEN 4 THEN 'broken' ELSE 'plain' END AS what FROM conversations))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: a user's events are a log of calls in the order of time."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("log"), F.col("event_id").alias("line"), F.lit(0).alias("item"), F.lit("c2s").alias("dir"), F.lit("request").alias("kind"),
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("method"), F.col("props").alias("params"), F.octet_length("props").cast("long").alias("bytes"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5: source and language make a cell, good quality is success, the number of characters a measure."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("doc_id")
    none = F.array().cast("array<string>")
    return d.select(
        F.lit("1.0").alias("suite_version"), F.col("source").alias("server"), F.col("lang").alias("client"), (n % 5).alias("task"), n.alias("line_no"),
        (n % 40).alias("trial"), (F.col("quality") == 1).alias("success"), F.when(F.col("toxic") == 1, None).otherwise(F.col("n_chars")).alias("chars"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("client_error"), (F.length("text") % 4).alias("calls"), F.col("text").alias("message"),
        ((n * 7) % 97).alias("suite_seq"), F.concat(F.lit("model"), n % 3).alias("model"), F.concat(F.lit("model"), n % 2).alias("resolved_model"), F.lit("state").alias("check_kind"),
        F.when(n % 4 == 0, F.lit("sha256:0")).alias("server_image_digest"), (n % 11 == 0).alias("timed_out"), F.when(n % 13 != 0, n % 7 != 0).alias("client_json_valid"),
        F.when(n % 17 == 0, "failed").alias("client_error_text"), F.when(n % 3 == 0, n % 2).alias("permission_denials"), F.when(n % 9 == 0, F.array(F.concat(F.lit("p"), n % 4))).otherwise(none).alias("fixture_extra_paths"),
        (n % 19 == 0).alias("harness_suspect"), F.when(n % 6 == 0, F.array(F.lit("no access to"))).alias("refusal_markers"), (F.length("text") % 4).alias("tool_calls"), F.lit("recorded").alias("classification"),
    )


TRIALS = """trials AS (SELECT '1.0' AS suite_version, source AS server, lang AS client, d.doc_id % 5 AS task, d.doc_id AS line_no, d.doc_id % 40 AS trial,
  quality = 1 AS success, CASE WHEN toxic = 1 THEN NULL ELSE n_chars END AS chars, coalesce(toxic = 1, false) AS client_error, length(text) % 4 AS calls, text AS message,
  (d.doc_id * 7) % 97 AS suite_seq, 'model' || d.doc_id % 3 AS model, CASE WHEN d.doc_id % 4 = 0 THEN 'sha256:0' END AS server_image_digest, d.doc_id % 11 = 0 AS timed_out,
  CASE WHEN d.doc_id % 13 <> 0 THEN d.doc_id % 7 <> 0 END AS client_json_valid, CASE WHEN d.doc_id % 17 = 0 THEN 'failed' END AS client_error_text,
  CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id % 2 END AS permission_denials, CASE WHEN d.doc_id % 9 = 0 THEN 'p' || d.doc_id % 4 END AS extra_path, d.doc_id % 19 = 0 AS harness_suspect, d.doc_id % 6 = 0 AS refused
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


RUN_DATE = "2026-01-01"


def stack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6: an order is a stack, a part a server; its size is its number of tools, line quantities its tokens."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    servers = parts.select(
        F.col("p_partkey").alias("server"), F.when(F.col("p_size") % 10 == 0, "auth").otherwise("ok").alias("status"),
        F.when(F.col("p_size") % 7 != 0, (F.col("p_retailprice") * 10).cast("long")).alias("total"), F.col("p_size").cast("long").alias("n_tools"),
    )
    return stack.chosen(lines.select(F.col("l_orderkey").alias("stack"), F.col("l_partkey").alias("server")).distinct(), servers)


MODED = """rows AS (SELECT DISTINCT l_orderkey AS stack, l_partkey AS server FROM lineitem),
servers AS (SELECT p_partkey AS server, CASE WHEN p_size % 10 = 0 THEN 'auth' ELSE 'ok' END AS status,
  CASE WHEN p_size % 7 <> 0 THEN CAST(trunc(p_retailprice * 10) AS BIGINT) END AS total, CAST(p_size AS BIGINT) AS n FROM part),
base AS (SELECT stack, r.server, status, total, CASE WHEN n > 0 THEN CAST(floor(total / CAST(n AS DOUBLE)) AS BIGINT) ELSE 0 END AS mean FROM rows r JOIN servers s ON r.server = s.server),
wide AS (
  SELECT stack, server, status, 'naive' AS mode, total AS tokens, total AS low, total AS high FROM base
  UNION ALL SELECT stack, server, status, 'tool_search', CASE WHEN total IS NOT NULL THEN 500 + 4 * mean END, CASE WHEN total IS NOT NULL THEN 500 + 3 * mean END, CASE WHEN total IS NOT NULL THEN 500 + 5 * mean END FROM base
  UNION ALL SELECT stack, server, status, 'code_mode', c, c, c FROM (SELECT *, CASE WHEN total IS NULL THEN NULL WHEN total > 0 AND total < 1000 THEN total ELSE 1000 END AS c FROM base)),
moded AS (SELECT *, CASE WHEN status <> 'ok' THEN 'no data (' || status || ' 2026-01-01)' WHEN tokens IS NOT NULL THEN NULL WHEN mode = 'naive' THEN 'no OpenAI o200k measurement (pending)'
  WHEN mode = 'tool_search' THEN 'no tool-search model (pending)' ELSE 'no code-mode model (pending)' END AS reason FROM wide),
sums AS (SELECT stack, mode, CASE mode WHEN 'naive' THEN 'measured' ELSE 'modeled' END AS kind, count(*) FILTER (reason IS NULL) AS servers, count(*) FILTER (reason IS NOT NULL) AS excluded,
  CAST(sum(tokens) FILTER (reason IS NULL) AS BIGINT) AS total, CAST(sum(low) FILTER (reason IS NULL) AS BIGINT) AS low, CAST(sum(high) FILTER (reason IS NULL) AS BIGINT) AS high FROM moded GROUP BY stack, mode)"""
