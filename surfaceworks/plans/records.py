"""Queries over recorded launches, answers, runs and trials, made of the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import figures, ordered_json, text
from ..operators import acquisition, stack, trials
from ..sources import readers, writers
from . import bindings as b
from .registry import query, table


def _suppliers(spark, d):
    """Suppliers as corpus entries of seven kinds."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    kind, which = k % 7, lambda *of: F.element_at(F.array(*[F.lit(x).cast("string") for x in of]), (k % 7 + 1).cast("int"))
    text_of = lambda name: F.concat(F.lit(name), k)
    package = F.struct(
        which("npm", "uvx", "docker", "binary", None, None, "npm").alias("type"), F.when(kind < 2, text_of("pkg")).alias("name"), F.when(k % 2 == 0, F.lit("1.2")).alias("version"),
        F.when(kind == 2, F.concat(text_of("img"), F.when(k % 2 == 0, F.lit("@sha256:0")).otherwise(F.lit(":tag")))).alias("image"), F.when(kind == 3, text_of("run")).alias("command"),
        F.when(k % 3 == 0, F.array(F.lit("--root={{SCRATCH}}/x"))).alias("args"), F.when(k % 5 == 0, F.array(F.lit("a<2"), F.lit("b"))).alias("with"),
    )
    transport = F.when(kind == 4, F.array(F.lit("remote"))).when(kind == 5, F.array(F.lit("sse"))).otherwise(F.array(F.lit("stdio")))
    auth = F.struct(F.when(k % 4 != 0, k % 4 == 1).alias("required"), F.when(k % 3 != 0, F.concat(F.lit("TOKEN_"), k % 5)).alias("token_env"))
    flags = F.array(F.create_map(F.lit("z"), k.cast("string"), F.lit("a"), F.lit("x")), F.create_map(F.lit("k"), F.lit("v")))
    return s.select(
        k.cast("string").alias("id"), "s_name", F.when(kind.isin(4, 5), text_of("https://h/")).alias("endpoint"), transport.alias("transport"), F.create_map(F.lit("stdio"), package).alias("package"), auth.alias("auth"),
        F.when(k % 3 == 0, "official").when(k % 3 == 1, "community").alias("maintainer_type"), flags.alias("flags"),
    )


_SPEC = lambda sep: f"'pkg' || k || CASE WHEN k % 2 = 0 THEN '{sep}1.2' ELSE '' END"
_OWN = "CASE WHEN k % 3 = 0 THEN ' --root=/w/x' ELSE '' END"


@query(
    f"""WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 7 < 4 THEN 'stdio' WHEN k % 7 = 4 THEN 'remote' END AS transport,
  CASE k % 7 WHEN 0 THEN 'npm:' || {_SPEC('@')} WHEN 1 THEN 'pypi:' || {_SPEC('==')} || CASE WHEN k % 5 = 0 THEN ' --with a<2 --with b' ELSE '' END WHEN 2 THEN 'docker:img' || k || CASE WHEN k % 2 = 0 THEN '@sha256:0' ELSE ':tag' END
    WHEN 3 THEN 'binary:run' || k WHEN 4 THEN 'endpoint:https://h/' || k END AS source,
  CASE k % 7 WHEN 0 THEN 'npx -y ' || {_SPEC('@')} || {_OWN} WHEN 1 THEN 'uvx ' || CASE WHEN k % 5 = 0 THEN '--with a<2 --with b ' ELSE '' END || {_SPEC('==')} || {_OWN}
    WHEN 2 THEN 'docker run --rm -i img' || k || CASE WHEN k % 2 = 0 THEN '@sha256:0' ELSE ':tag' END || {_OWN} WHEN 3 THEN 'run' || k || {_OWN} END AS command_line,
  CASE WHEN k % 7 < 4 THEN k % 2 = 0 END AS pinned, CASE k % 7 WHEN 0 THEN 'npx_node_modules_walk' WHEN 1 THEN 'uvx_importlib_metadata' WHEN 2 THEN 'container_image' WHEN 3 THEN 'not_applicable' WHEN 4 THEN 'not_applicable' END AS method,
  CASE k % 7 WHEN 5 THEN 'only the deprecated HTTP+SSE transport is declared, which the harness does not support' WHEN 6 THEN 'acquisition spec unresolved in the corpus' END AS error FROM s"""
)
def launch_plans(spark, d):
    out = acquisition.launches(_suppliers(spark, d), "/w")
    line = F.when(F.col("command").isNotNull(), F.concat_ws(" ", "command", F.array_join("args", " ")))
    line = F.when(F.col("command").isNotNull() & (F.size("args") == 0), F.col("command")).otherwise(line)
    return out.select("id", "transport", "source", line.alias("command_line"), "pinned", "deps.method", "error")


@query(
    """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 <> 0 THEN 'TOKEN_' || s_suppkey % 5 END AS name FROM supplier)
SELECT CAST(k AS VARCHAR) AS id, name AS token_env, coalesce(name IN ('TOKEN_1', 'TOKEN_2'), false) AS present,
  CASE WHEN k % 4 >= 2 THEN NULL WHEN name IS NULL THEN 'credential required but the corpus declares no env var convention'
    WHEN name NOT IN ('TOKEN_1', 'TOKEN_2') THEN 'credential required but ' || name || ' is not set' END AS error FROM s"""
)
def credential_outcomes(spark, d):
    return acquisition.credentials(_suppliers(spark, d), {"TOKEN_1": "x", "TOKEN_2": "y", "TOKEN_3": ""})


@query(
    "SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'official' ELSE 'community' END AS maintainer, s_suppkey % 4 < 2 AS auth_required, 'a: x|z: ' || s_suppkey || '|k: v' AS flags, s_suppkey % 7 = 4 AS remote FROM supplier WHERE s_suppkey NOT IN (3, 13, 23)"
)
def corpus_fields(spark, d):
    c = readers.chosen(_suppliers(spark, d), None, ["3", "13", "23"])
    maintainer = F.when(F.col("maintainer_type") == "official", "official").otherwise("community")
    return c.select("id", maintainer.alias("maintainer"), readers.auth_required(F.col("auth")).alias("auth_required"), F.array_join(readers.flag_lines(F.col("flags")), "|").alias("flags"), acquisition.declares("remote").alias("remote"))


def _bodies(spark, d):
    """Events as answers to posts: plain, streamed, streamed without an id, empty, refused."""
    e = table(spark, d, "events").select("event_id", "event_type")
    k = F.col("event_id")
    plain = F.format_string('{"id":%d,"result":{"type":"%s"}}', k, "event_type")
    stream = F.format_string('event: note\ndata: {"method":"x"}\n\nevent: message\ndata: {"id":%d,\ndata:"result":"%s"}\n\ndata: {"id":0}\n', k, "event_type")
    body = F.when(k % 5 == 1, stream).when(k % 5 == 2, F.lit("data: {\"method\":1}\n\n")).otherwise(plain)
    status = F.when(k % 5 == 3, 202).when(k % 35 == 4, 403).when(k % 5 == 4, 500).otherwise(200)
    return e.select("event_id", status.alias("status"), F.when((k % 5).isin(1, 2), "text/event-stream").otherwise("application/json").alias("kind"), body.alias("body"))


@query(
    """WITH e AS (SELECT event_id AS k, event_type AS t FROM events)
SELECT k AS event_id, CASE k % 5 WHEN 0 THEN 'response' WHEN 1 THEN 'response' WHEN 2 THEN 'error' WHEN 3 THEN 'empty' ELSE CASE WHEN k % 35 = 4 THEN 'auth' ELSE 'error' END END AS kind,
  CASE k % 5 WHEN 0 THEN replace('{%id%:' || k || ',%result%:{%type%:%' || t || '%}}', '%', chr(34)) WHEN 1 THEN replace('{%id%:' || k || ',' || chr(10) || '%result%:%' || t || '%}', '%', chr(34))
    WHEN 2 THEN 'no JSON-RPC response frame in event stream' WHEN 4 THEN CASE WHEN k % 35 <> 4 THEN 'HTTP 500' END END AS payload FROM e"""
)
def http_answers(spark, d):
    return _bodies(spark, d).select("event_id", readers.http_outcome(F.col("status"), F.col("kind"), F.col("body")).alias("o")).select("event_id", "o.*")


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'result' WHEN 1 THEN 'rpc_error' ELSE 'protocol_error' END AS kind,
  CASE event_id % 5 WHEN 1 THEN event_type WHEN 2 THEN 'response to m carries a null result, which is neither a result nor an error' WHEN 3 THEN 'response to m carries neither result nor error' WHEN 4 THEN 'malformed response to m' END AS detail FROM events"""
)
def response_outcomes(spark, d):
    k = F.col("event_id")
    raw = F.when(k % 5 == 0, F.lit('{"id":1,"result":{}}')).when(k % 5 == 1, F.format_string('{"id":1,"error":{"code":-1,"message":"%s"}}', "event_type")).when(k % 5 == 2, F.lit('{"id":1,"result": null }'))
    raw = raw.when(k % 5 == 3, F.lit('{"id":1,"error":null}')).otherwise(F.lit('{"id":1'))
    return table(spark, d, "events").select("event_id", readers.response_outcome(raw, F.lit("m")).alias("o")).select("event_id", "o.*")


@query(
    """WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT k AS id, CASE k % 6 WHEN 0 THEN 'discover' WHEN 1 THEN 'discover_retry' WHEN 4 THEN 'legacy' END AS branch, CASE k % 6 WHEN 0 THEN 'r3' WHEN 1 THEN 'r2' END AS revision,
  CASE k % 6 WHEN 2 THEN 'no mutually supported revision; server offers [r0 r9]' WHEN 3 THEN 'protocol_error' WHEN 5 THEN 'auth' END AS error FROM s"""
)
def negotiations(spark, d):
    k = F.col("s_suppkey")
    code = F.when((k % 6).isin(1, 2, 3), -32022).when(k % 6 == 4, -32601)
    supported = F.when(k % 6 == 2, F.array(F.lit("r0"), F.lit("r9"))).otherwise(F.array(F.lit("r1"), F.lit("r2")))
    ours = F.array(*map(F.lit, ("r3", "r2", "r1")))
    return table(spark, d, "supplier").select(k.alias("id"), readers.negotiated(ours, code, k % 6 == 5, supported, k % 6 == 1).alias("n")).select("id", "n.*")


@query(
    """WITH p AS (SELECT l_orderkey AS server, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS page_no, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
e AS (SELECT server, page_no, CASE WHEN page_no = 2 AND server % 4 = 0 THEN 'timeout' WHEN page_no = 1 AND server % 4 = 1 THEN 'malformed ListToolsResult' WHEN page_no = 3 AND n > 4 THEN 'pagination exceeded 4 pages' END AS why, page_no = n - 1 AS last FROM p WHERE page_no < 4),
f AS (SELECT server, min(page_no) AS pos FROM e WHERE why IS NOT NULL OR last GROUP BY server)
SELECT f.server, CAST(pos + CASE WHEN why IS NULL OR why LIKE 'pagination%' THEN 1 ELSE 0 END AS BIGINT) AS pages, why IS NOT NULL AND (pos > 0 OR why LIKE 'malformed%') AS partial, why AS error FROM f JOIN e ON f.server = e.server AND pos = page_no"""
)
def page_enumeration(spark, d):
    of = Window.partitionBy("l_orderkey")
    line = table(spark, d, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("server"), (F.row_number().over(of.orderBy("l_linenumber")) - 1).alias("page_no"), F.count("*").over(of).alias("n"))
    result = F.when(F.col("page_no") < F.col("n") - 1, F.lit('{"tools":[],"nextCursor":"c"}')).otherwise(F.lit('{"tools":[]}'))
    result = F.when((F.col("page_no") == 1) & (F.col("server") % 4 == 1), F.lit("[]")).otherwise(result)
    error = F.when((F.col("page_no") == 2) & (F.col("server") % 4 == 0), "timeout")
    return readers.enumerations(rows.select("server", "page_no", result.alias("result"), error.alias("error")), 4)




@query("SELECT conv_id, turn, octet_length(encode('{%content%:[{%text%:%' || regexp_replace(text, '[^a-z ]', '', 'g') || '%},{}],%isError%:' || (turn % 2 = 0) || '}')) AS bytes, 2 AS content_blocks, length(regexp_replace(text, '[^a-z ]', '', 'g')) AS text_len, turn % 2 = 0 AS is_error FROM conversations")
def result_summaries(spark, d):
    plain = F.regexp_replace("text", "[^a-z ]", "")
    raw = F.concat(F.lit('{"content":[{"text":"'), plain, F.lit('"},{}],"isError":'), (F.col("turn") % 2 == 0).cast("string"), F.lit("}"))
    return table(spark, d, "conversations").select("conv_id", "turn", readers.result_summary(raw).alias("s")).select("conv_id", "turn", "s.*")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN chr(34) || event_id || chr(34) WHEN 2 THEN 'null' END AS id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS tool FROM events")
def message_ids(spark, d):
    k = F.col("event_id").cast("string")
    raw = F.when(k % 4 == 0, k).when(k % 4 == 1, F.concat(F.lit('"'), k, F.lit('"'))).when(k % 4 == 2, F.lit("null"))
    frame = F.concat(F.lit('{"method": "m"'), F.when(raw.isNotNull(), F.concat(F.lit(', "id" : '), raw)).otherwise(F.lit("")), F.lit(', "params_full": '), F.when(k % 3 == 0, F.concat(F.lit('{"name": "'), "event_type", F.lit('"}'))).otherwise(F.lit("[1]")), F.lit("}"))
    m = table(spark, d, "events").select("event_id", ordered_json.slices_of(frame).alias("m"))
    return m.select("event_id", ordered_json.canonical(F.col("m")["id"]).alias("id"), F.coalesce(F.get_json_object(F.col("m")["params_full"], "$.name"), F.lit("")).alias("tool"))


TASKS = "filesystem:FS-01 FS-02 FS-03,playwright:PW-01 PW-05,github:GH-05"


@query(
    """WITH t AS (SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'filesystem' WHEN 1 THEN 'playwright' ELSE 'github' END AS server, CASE n_nationkey % 5 WHEN 0 THEN 'FS-01' WHEN 1 THEN 'PW-05' WHEN 2 THEN 'GH-05' WHEN 3 THEN 'FS-09' ELSE 'GH-01' END AS task FROM nation)
SELECT DISTINCT server, task, CASE WHEN task IN ('FS-01', 'GH-05', 'GH-01') THEN 'transcript' ELSE 'state' END AS kind,
  CASE WHEN CASE left(task, 2) WHEN 'FS' THEN 'filesystem' WHEN 'PW' THEN 'playwright' ELSE 'github' END <> server THEN 'task ' || task || ' does not belong to server ' || server WHEN task IN ('FS-09', 'GH-01') THEN 'unknown task: ' || task END AS error FROM t"""
)
def task_selection(spark, d):
    k = F.col("n_nationkey")
    server = F.element_at(F.array(*map(F.lit, ("filesystem", "playwright", "github"))), (k % 3 + 1).cast("int"))
    task = F.element_at(F.array(*map(F.lit, ("FS-01", "PW-05", "GH-05", "FS-09", "GH-01"))), (k % 5 + 1).cast("int"))
    suite = spark.createDataFrame([(s, t) for x in TASKS.split(",") for s, ts in [x.split(":")] for t in ts.split()], "server string, task string")
    wanted = table(spark, d, "nation").select(server.alias("server"), task.alias("task")).distinct()
    return trials.selected(wanted, suite).select("server", "task", trials.check_kind(F.col("task")).alias("kind"), "error")


@query(
    """WITH u AS (SELECT c_custkey AS k, CAST(c_custkey % 50 AS BIGINT) AS a, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 40 AS BIGINT) END AS b FROM customer)
SELECT k AS id, CASE WHEN k % 11 = 0 THEN 'pinned' WHEN coalesce(b, 0) >= a THEN 'side' ELSE 'main' END AS resolved_model,
  CASE WHEN k % 11 = 0 THEN '' ELSE 'main:' || a || ',side:' || coalesce(CAST(b AS VARCHAR), '-') END AS used, CASE WHEN k % 11 = 0 THEN 0 ELSE a + coalesce(b, 0) END AS candidates FROM u"""
)
def model_usage(spark, d):
    k = F.col("c_custkey")
    a, b_ = (k % 50).cast("long"), F.when(k % 3 != 0, (k % 40).cast("long"))
    none = F.lit(None).cast("long")
    entry = lambda n: F.struct(none.alias("input_tokens"), n.alias("output_tokens"), none.cast("double").alias("cost_usd"), n.alias("candidates"))
    usage = F.when(k % 11 != 0, F.create_map(F.lit("main"), entry(a), F.lit("side"), entry(b_)))
    rows = table(spark, d, "customer").select(k.alias("id"), usage.alias("u"))
    used = F.array_join(F.transform(trials.models_used(F.col("u")), lambda m: F.concat(m["model"], F.lit(":"), F.coalesce(m["output_tokens"].cast("string"), F.lit("-")))), ",")
    resolved = acquisition.resolved_model(F.transform_values("u", lambda _, v: v["output_tokens"]), F.lit("pinned"))
    return rows.select("id", resolved.alias("resolved_model"), used.alias("used"), trials.model_sums(F.col("u"), ("candidates",))["candidates"].alias("candidates"))


@query("SELECT o_orderkey AS run_id, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS drift FROM orders")
def run_drift(spark, d):
    k = F.col("o_orderkey")
    drift = trials.drifted(F.lit("2.1"), F.when(k % 5 == 0, "2.2").otherwise("2.1"), F.when(k % 2 == 0, "d"), F.when(k % 7 == 0, "e").when(k % 2 == 0, "d"))
    return table(spark, d, "orders").select(k.alias("run_id"), drift.alias("drift"))


@query(
    """SELECT c_custkey AS id, 'Open http://localhost:' || (8000 + c_custkey % 100) || ' and write t' || c_custkey || ' to /out.' AS prompt,
  CASE WHEN c_custkey % 4 = 0 THEN 'logs/access.log' WHEN c_custkey % 4 = 1 THEN 'c' || c_custkey || '.txt' WHEN c_custkey % 4 = 2 THEN 'docs/a.md' ELSE '''x''' END AS path, CAST(1370 + c_custkey AS VARCHAR) AS n, c_custkey % 4 = 0 AS passed, c_custkey % 2 = 0 AS said FROM customer"""
)
def trial_checks(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" '/abs/"), k, F.lit("/logs/access.log' "))).when(k % 4 == 1, F.concat(F.lit('"./c'), k, F.lit('.txt,"'))).when(k % 4 == 2, F.lit("./docs/a.md")).otherwise(F.lit("''x''"))
    path = acquisition.normal_path(raw, "logs/access.log")
    count = acquisition.normal_count(F.concat(F.lit("`"), F.regexp_replace((1370 + k).cast("string"), r"(\d)(\d{3})$", "$1,$2"), F.lit("`")))
    state = F.concat(F.when(k % 4 == 0, F.lit('"./logs/access.log"')).otherwise(F.lit("other")), F.lit("\n 1,370 \n"))
    check = lambda kind, *needles: F.struct(F.lit(kind).alias("kind"), F.array(*map(F.lit, needles)).alias("needles"))
    ident = F.concat(F.lit("t"), k)
    passed = acquisition.succeeded(F.lit(None).cast("string"), state, ident, check("path_count", "logs/access.log", "1370"))
    said = acquisition.succeeded(F.when(k % 2 == 0, F.concat(F.lit("it is "), ident, F.lit(" and b"))).otherwise("b"), F.lit(None).cast("string"), ident, check("contains", "{trial_id}", "b"))
    prompt = acquisition.rendered(F.lit("Open http://localhost:{port} and write {trial_id} to {output_dir}."), ident, 8000 + k % 100, F.lit("/out"))
    return table(spark, d, "customer").select(k.alias("id"), prompt.alias("prompt"), path.alias("path"), count.alias("n"), passed.alias("passed"), said.alias("said"))


@query("SELECT s_suppkey AS id, 'a,b' || s_suppkey AS servers, CASE s_suppkey % 3 WHEN 0 THEN 'code_mode' ELSE 'naive' END AS mode, CASE s_suppkey % 3 WHEN 1 THEN 'gemini' ELSE 'openai_o200k' END AS model FROM supplier")
def permalinks_read(spark, d):
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://h/?servers=a%2C%2Cb"), k, F.when(k % 3 == 0, "&mode=code_mode").when(k % 3 == 1, "&mode=none&model=gemini").otherwise(""))
    return table(spark, d, "supplier").select(k.alias("id"), figures.from_permalink(url).alias("p")).select("id", F.array_join("p.servers", ",").alias("servers"), "p.mode", "p.model")


@query(
    f"""WITH {b.MODED}, s AS (SELECT DISTINCT stack FROM rows), m AS (SELECT stack, mode, total FROM sums)
SELECT stack, mode, CASE mode WHEN 'naive' THEN 'Naive full load' WHEN 'tool_search' THEN 'Tool Search' ELSE 'Code Mode' END AS label, total IS NULL AS pending,
  CASE WHEN total IS NULL THEN 'n/a' ELSE format('{{:,}}', total) END AS tokens_text, CASE WHEN total IS NOT NULL THEN floor(least(total / CAST(200000 AS DOUBLE), 1) * 1000000 + 0.5) / 1000000 END AS filled, total > 200000 AS overloaded FROM m"""
)
def stack_labels(spark, d):
    out = stack.totals(stack.by_mode(b.stack_rows(spark, d), b.RUN_DATE))
    g = figures.gauge(F.col("total"))
    return out.select("stack", "mode", figures.labelled(F.col("mode"), figures.MODE_LABELS).alias("label"), F.col("total").isNull().alias("pending"), figures.tokens_text(F.col("total")).alias("tokens_text"), text.rounded(g["filled"], 6).alias("filled"), g["overloaded"].alias("overloaded"))


@query(
    """WITH chosen AS (SELECT DISTINCT l_orderkey AS stack, l_suppkey AS server FROM lineitem), traffic AS (SELECT s_suppkey AS server, s_nationkey AS calls FROM supplier WHERE s_nationkey % 3 = 0)
SELECT stack, c.server, calls, calls IS NOT NULL AS measured FROM chosen c LEFT JOIN traffic t ON c.server = t.server"""
)
def measured_traffic(spark, d):
    chosen = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stack"), F.col("l_suppkey").alias("server")).distinct()
    published = table(spark, d, "supplier").where("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("server"), F.col("s_nationkey").alias("calls"))
    there, missing = stack.measured(chosen, published)
    return there.withColumn("measured", F.lit(True)).select("stack", "server", "calls", "measured").unionByName(missing.select("stack", "server", F.lit(None).cast("int").alias("calls"), F.lit(False).alias("measured")))


@query("SELECT * FROM (VALUES ('openai_o200k', true)) UNION ALL SELECT 'claude', coalesce(bool_or(s_nationkey % 30 = 7), false) FROM supplier UNION ALL SELECT 'gemini', false".replace("SELECT * FROM (VALUES ('openai_o200k', true))", "SELECT 'openai_o200k' AS model, true AS available"))
def model_availability(spark, d):
    s = table(spark, d, "supplier").select(F.when(F.col("s_nationkey") % 30 == 7, 1).alias("claude"), F.lit(None).cast("int").alias("gemini"))
    return stack.availability(s)


@query(
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'no data (auth 2026-01-01)' END AS label, 'one | two' AS head, CASE WHEN s_suppkey % 2 = 0 THEN repeat('x', 160) || '...' ELSE 'a' || s_suppkey END AS line, 's' || s_suppkey || '  ok  -' AS console FROM supplier"
)
def status_texts(spark, d):
    k = F.col("s_suppkey")
    line = text.shortened(F.when(k % 2 == 0, F.repeat(F.lit("x"), 200)).otherwise(F.concat(F.lit("a"), k, F.lit("\nb"))))
    head = text.first_lines(F.lit("\none\ntwo\nthree\n"), 2)
    console = writers.console_line(F.concat(F.lit("s"), k), F.lit("ok"), F.lit(None).cast("string"))
    status = stack.status_label(F.when(k % 4 == 0, "auth").otherwise("ok"), F.lit(b.RUN_DATE))
    return table(spark, d, "supplier").select(k.alias("id"), status.alias("label"), head.alias("head"), line.alias("line"), console.alias("console"))


@query("SELECT c_custkey AS id, 'HOME=/h,LANG=' || c_custkey AS env FROM customer")
def inherited_environment(spark, d):
    env = F.create_map(F.lit("SECRET"), F.lit("x"), F.lit("HOME"), F.lit("/h"), F.lit("LANG"), F.col("c_custkey").cast("string"), F.lit("API_KEY"), F.lit("y"))
    kept = F.transform(F.array_sort(F.map_entries(acquisition.inherited(env))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(kept, ",").alias("env"))


@query(
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'auth' WHEN s_suppkey % 5 = 1 THEN 'schema_invalid' WHEN s_suppkey % 5 = 2 THEN 'partial_surface' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN '2026-01-01T00:00:00Z' END AS measured_at FROM supplier"
)
def row_statuses(spark, d):
    k = F.col("s_suppkey")
    status = acquisition.row_status(F.when(k % 5 == 0, "auth").otherwise("ok"), F.lit(3), F.when(k % 5 == 1, 3).otherwise(1), k % 5 == 2)
    rows = table(spark, d, "supplier").select(k.alias("id"), status.alias("status"), (k % 2 == 0).alias("available"))
    return acquisition.stamped(rows, "m", "e", "2026-01-01T00:00:00Z").select("id", "status", "measured_at")


@query(
    """WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT k AS id, CASE WHEN k % 4 = 0 THEN 'server changed' WHEN k % 4 = 1 AND k % 3 = 0 THEN 'tokenizer changed' WHEN k % 4 = 1 AND k % 3 = 1 THEN 'harness changed' WHEN k % 4 = 1 THEN 'unexplained' ELSE 'unchanged' END AS change FROM s"""
)
def run_changes(spark, d):
    k = F.col("s_suppkey")
    old = table(spark, d, "supplier").select(k.alias("id"), F.lit("h").alias("canonical_sorted_sha256"), F.lit("t").alias("tokenizer"), F.lit("1").alias("harness_version"), F.lit(5).alias("total"))
    new = table(spark, d, "supplier").select(
        k.alias("id"), F.when(k % 4 == 0, "g").otherwise("h").alias("canonical_sorted_sha256"), F.when(k % 3 == 0, "u").otherwise("t").alias("tokenizer"), F.when(k % 3 == 1, "2").otherwise("1").alias("harness_version"),
        F.when(k % 4 == 1, 6).otherwise(5).alias("total"),
    )
    return acquisition.changes(old, new)


@query(
    """WITH r AS (SELECT o_custkey AS id, o_orderdate AS run_date, o_orderkey % 3 <> 0 AS gone, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
c AS (SELECT c_custkey AS id, c_custkey % 9 = 0 AS old FROM customer)
SELECT id, 'unreachable in two runs' AS reason FROM r WHERE k <= 2 GROUP BY id HAVING count(*) FILTER (gone) = 2 UNION ALL SELECT id, 'abandoned' FROM c WHERE old"""
)
def removals(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("run_date"), F.when(F.col("o_orderkey") % 3 != 0, "unreachable").otherwise("ok").alias("status"))
    last = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 9 == 0, "2025-01-01").otherwise("2025-12-01").alias("changed_at"))
    return acquisition.removals(runs, last, b.RUN_DATE)
