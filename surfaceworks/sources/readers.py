"""Sources. All reading goes through Spark, so any store that Spark can open will do.

Order within a file matters to what is read here, so lines are numbered; files are split into blocks
like others, and may have any size.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import MOST_LINE_BYTES, MOST_PAGES, NEGOTIATE
from ..functions import ordered_json
from ..functions.figures import epoch_ns
from ..stash import held

CORPUS = """id string, name string, category string, maintainer_type string, repo string, endpoint string, transport array<string>,
auth struct<required:boolean,token_env:string>, package map<string,struct<type:string,name:string,version:string,image:string,command:string,args:array<string>,with:array<string>>>, flags array<map<string,string>>"""

TRIAL = """type string, schema string, suite_version string, run_id string, date string, server string, task string, client string, model string, resolved_model string, trial int, trial_ordinal int,
suite_seq int, trial_id string, started_at string, ended_at string, exit_code int, wall_ms long, timed_out boolean, client_json_valid boolean, success boolean, check_kind string, check_evidence string, classification string,
client_reported_error boolean, refusal_markers array<string>, tool_calls int, tool_call_gap int, harness_suspect boolean, permission_denials int, fixture_extra_paths array<string>, server_pkg string, server_image_digest string,
interposer_version string, analyzer_version string, client_versions map<string,string>, client_versions_at_start map<string,string>, client_versions_at_end map<string,string>,
server_image_digest_at_start string, server_image_digest_at_end string, version_drift boolean, trials_executed int, trials_skipped int, interrupted boolean, trials_per_task int, tasks array<string>, max_turns int,
trial_timeout_s int, full_results boolean, isolation string, models_used array<struct<model:string,input_tokens:long,output_tokens:long,cost_usd:double>>,
cache struct<basis:string,cache_creation_input_tokens:long,cache_read_input_tokens:long,input_tokens:long,output_tokens:long,cached:long,prompt:long,candidates:long,total:long>,
client_reported struct<total_cost_usd:double,num_turns:long,duration_ms:long,error:string>,
analyze struct<sessions:int,tool_calls:int,tool_call_arg_tokens:long,tool_call_result_tokens:long,tool_call_arg_bytes:long,tool_call_result_bytes:long,requests:int,responses:int,jsonrpc_errors:int,tool_errors:int,retries:int,bytes:long,wire_duration_ms:long,tools:array<string>,warnings:array<string>>"""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): numbered from 0; a newline at the end begins no line. Runs a job.

    Files are read in blocks, as many tasks as they have; lines end at newlines alone, so a carriage return
    stays. The blocks' lines are counted, and their prefix sums over the file number them: only a row for
    each block meets in one place. Texts are written once with their places in the blocks, so numbers
    don't depend on blocks being cut alike when something is read again. An empty file has no lines.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    raw = held(raw, "lines")
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    blocks = blocks.select(F.col("file").alias("of"), F.col("block").alias("b"), (before - F.col("first")).alias("shift"))
    return raw.join(blocks, (F.col("file") == F.col("of")) & (F.col("block") == F.col("b"))).select("file", (F.col("at") + F.col("shift")).alias("line"), "text")


def server_of(file: Column, suffix: str) -> Column:
    return F.regexp_extract(file, rf"([^/]+){suffix}$", 1)


def wire_pages(spark: SparkSession, path: str) -> DataFrame:
    """(server, page_no, raw) of files named <server>-wire.jsonl."""
    return lines(spark, path).select(server_of(F.col("file"), r"-wire\.jsonl").alias("server"), F.col("line").alias("page_no"), F.col("text").alias("raw"))


def tools(pages: DataFrame) -> DataFrame:
    """One row per tool of pages (server, page_no, raw): server, tool (its place on the surface), and what ``read_tool`` gives.

    A server with a tool that can't be read has no surface: its tools keep the error.
    """
    of_page = ordered_json.slices_of(ordered_json.slices_of(F.col("raw"))["result"])["tools"]
    split = pages.select("server", "page_no", F.posexplode(_elements(of_page)).alias("i", "raw_tool"))
    # pages of one server are few (200 at most), so its tools are numbered in one place
    numbered = split.withColumn("tool", (F.row_number().over(_by("server", "page_no", "i")) - 1).cast("long"))
    return numbered.select("server", "tool", "raw_tool", ordered_json.read_tool(F.col("raw_tool")).alias("t")).select("server", "tool", "raw_tool", "t.*")


def _by(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def _elements(c: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        decoder, gap = json.JSONDecoder(), re.compile(r"[\s,]*")

        def cut(x):
            if not isinstance(x, str) or not x.startswith("["):
                return []
            out, at = [], gap.match(x, 1).end()
            while x[at] != "]":
                _, end = decoder.raw_decode(x, at)
                out.append(x[at:end])
                at = gap.match(x, end).end()
            return out

        return column.map(cut)

    return run(c)


def surfaces(pages: DataFrame, read: DataFrame) -> DataFrame:
    """(server, tool_count, wire_sha256, canonical_sha256, canonical_sorted_sha256, by_name_sha256, canonical) of pages and their tools.

    canonical_sorted_sha256 is the published digest, by_name_sha256 that of the tools by name: the one
    that no order of a server's tools changes.
    """
    ordered = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), "" if c == "raw" else ",")
    wire = pages.groupBy("server").agg(F.sha2(ordered("raw", "page_no"), 256).alias("wire_sha256"))
    kept = read.where("error is null and not excluded").groupBy("server").agg(F.count("*").alias("tool_count"), F.concat(F.lit("["), ordered("canonical", "tool"), F.lit("]")).alias("canonical"))
    digest = lambda published: F.sha2(ordered_json.sorted_canonical(F.col("canonical"), published), 256)
    kept = kept.withColumn("canonical_sorted_sha256", digest(True)).withColumn("by_name_sha256", digest(False)).withColumn("canonical_sha256", F.sha2("canonical", 256))
    return wire.join(kept, "server", "left").select("server", "tool_count", "wire_sha256", "canonical_sha256", "canonical_sorted_sha256", "by_name_sha256", "canonical")


def _text(m: Column, k: str) -> Column:
    """The value of a key of exact slices, as text."""
    return F.get_json_object(F.concat(F.lit('{"v":'), m[k], F.lit("}")), "$.v")


def frame_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of frame logs that isn't blank, as ``operators.frames`` takes them, with the texts of a frame's messages.

    line counts from 0 and blank lines count. A line that is no JSON object, or longer than a log may
    hold, is unreadable.
    """
    return parsed_lines(lines(spark, path))


def parsed_lines(raw: DataFrame) -> DataFrame:
    """The same of lines (file, line, text) from anywhere."""
    raw = raw.where(F.trim("text") != "")
    top = raw.withColumn("m", F.when(F.octet_length("text") < MOST_LINE_BYTES, ordered_json.slices_of(F.col("text"))))
    text = lambda k: _text(F.col("m"), k)
    kind = F.when(F.col("m").isNull(), "unreadable").when(F.coalesce(text("interposer_version"), F.lit("")) != "", "header").when(F.coalesce(text("dir"), F.lit("")) != "", "frame").otherwise("unrecognised")
    top = top.withColumn("line_kind", kind).withColumn("batch", F.coalesce(text("batch") == "true", F.lit(False)))
    items = F.when(F.col("line_kind") == "frame", F.when(F.col("batch"), _elements(F.coalesce(F.col("m")["items"], F.lit("[]")))).otherwise(F.array("text")))
    out = top.select(
        F.col("file").alias("log"), "line", "line_kind", text("dir").alias("dir"), F.coalesce(text("size_bytes").cast("long"), F.lit(0)).alias("bytes"), F.coalesce(text("ts"), F.lit("")).alias("ts"), "batch",
        text("interposer_version").alias("interposer_version"), text("started_at").alias("started_at"), F.from_json(F.col("m")["server_cmd"], "array<string>").alias("server_cmd"), items.alias("texts"),
    )
    return out.withColumn("ts_ns", epoch_ns(F.col("ts"))).withColumn("items", F.coalesce(F.size("texts"), F.lit(0)).cast("long"))


def frame_messages(of_lines: DataFrame, encoder_factory=None) -> DataFrame:
    """Messages of the frames among ``frame_lines``, as ``operators.frames`` takes them.

    Batches become one message for each item. An id is its exact text, so 1 and "1" differ and a
    literal null is an id. Tokens are null without an encoder, and those of a result also without
    its full text.
    """
    each = of_lines.where("line_kind = 'frame'").select("log", "line", "dir", "bytes", "ts", "ts_ns", "batch", F.posexplode("texts").alias("item", "raw"))
    each = each.withColumn("m", ordered_json.slices_of(F.col("raw")))
    m, text = F.col("m"), lambda k: _text(F.col("m"), k)
    flag = lambda k: F.coalesce(text(k) == "true", F.lit(False))
    has_method = F.coalesce(text("method"), F.lit("")) != ""
    message = (
        F.when(flag("unparseable"), "unparseable").when(flag("is_response"), "response")
        .when(has_method & m["id"].isNotNull(), "request").when(has_method, "notification").otherwise("unrecognised")
    )
    each = each.withColumn("summary", F.from_json(m["result_summary"], "bytes long, content_blocks long, text_len long, is_error boolean"))
    tokens = (lambda c: ordered_json.token_count(c, encoder_factory)) if encoder_factory else lambda c: F.lit(None).cast("long")
    failed = m["error"].isNotNull() & (m["error"] != "null")
    return each.select(
        "log", "line", "item", "dir", "bytes", "batch", "ts", "ts_ns", message.alias("kind"), ordered_json.canonical(m["id"]).alias("id"), text("method").alias("method"),
        F.when(m["params_full"].isNotNull(), ordered_json.params(m["params_full"])).otherwise("").alias("params"), F.coalesce(F.get_json_object(m["params_full"], "$.name"), F.lit("")).alias("tool"),
        F.coalesce(F.octet_length(m["params_full"]), F.lit(0)).cast("long").alias("arg_bytes"), tokens(m["params_full"]).alias("arg_tokens"),
        F.coalesce("summary.bytes", F.lit(0)).alias("result_bytes"), "summary.content_blocks", "summary.text_len", tokens(m["result_full"]).alias("result_tokens"),
        F.when(failed, F.from_json(m["error"], "code int, message string")).alias("rpc_error"), F.coalesce(failed, F.lit(False)).alias("is_rpc_error"), F.coalesce("summary.is_error", F.lit(False)).alias("is_tool_error"),
    )


def result_summary(result: Column) -> Column:
    """struct<bytes, content_blocks, text_len, is_error> of a result's exact text; blocks and the bytes of their texts only if content is an array."""
    read = F.from_json(result, "content string, isError boolean")
    blocks = F.from_json(read["content"], "array<struct<text:string>>")
    listed = F.startswith(F.ltrim(read["content"]), F.lit("["))
    length = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.coalesce(F.octet_length(b["text"]), F.lit(0)).cast("long"))
    fields = F.octet_length(result).cast("long").alias("bytes"), F.when(listed, F.size(blocks)).cast("long").alias("content_blocks"), F.when(listed, length).alias("text_len"), read["isError"].alias("is_error")
    return F.when(result.isNotNull(), F.struct(*fields))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines with line_no, parsed by ``TRIAL``; select trials, headers and footers by type."""
    return lines(spark, path).where(F.trim("text") != "").select(F.col("line").alias("line_no"), F.from_json("text", TRIAL).alias("t")).select("line_no", "t.*")


def run_documents(spark: SparkSession, path: str) -> DataFrame:
    """Published rows: (date, id, name, status, tool_count, total, per_tool_n, ...); unmeasured figures are null, not 0."""
    schema = """run struct<date:string,methodology_version:string,harness_version:string>, servers array<struct<id:string,name:string,maintainer:string,status:string,tool_count:long,
    counts:struct<openai_o200k:struct<total_schema_tokens:long,per_tool:map<string,long>,available:boolean>,claude:struct<available:boolean,total_schema_tokens:long>,gemini:struct<available:boolean,total_schema_tokens:long>>,
    retrievability:struct<top3_fraction:double,mrr:double>,hygiene:struct<grade:string,score:double>,error:string>>"""
    docs = spark.read.schema(schema).json(path, multiLine=True)
    s = docs.select("run.date", F.explode("servers").alias("s"))
    counted = lambda c, default: F.when(F.coalesce(F.col(f"s.counts.{c}.available"), F.lit(default)) & (F.col("s.status") == "ok"), F.col(f"s.counts.{c}.total_schema_tokens"))
    return s.select(
        "date", "s.id", "s.name", F.when(F.col("s.maintainer") == "official", "official").otherwise("community").alias("maintainer"), "s.status", "s.tool_count", counted("openai_o200k", True).alias("total"),
        counted("claude", False).alias("claude"), counted("gemini", False).alias("gemini"), F.col("s.counts.openai_o200k.per_tool").alias("per_tool"), "s.retrievability", "s.hygiene", "s.error",
    )


def pricing(spark: SparkSession, path: str) -> DataFrame:
    """(model, price, write, read, least) of a price document; a model's own write multiplier wins."""
    schema = "cache_read_multiplier double, cache_write_multiplier double, models map<string,struct<label:string,input_price_per_mtok:double,min_cacheable_prefix_tokens:long,cache_write_multiplier:double>>"
    p = spark.read.schema(schema).json(path, multiLine=True)
    rows = p.select("*", F.explode("models").alias("model", "m"))
    return rows.select("model", F.col("m.input_price_per_mtok").alias("price"), F.coalesce("m.cache_write_multiplier", "cache_write_multiplier").alias("write"), F.col("cache_read_multiplier").alias("read"), F.col("m.min_cacheable_prefix_tokens").alias("least"))


def _yaml(spark: SparkSession, path: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a corpus file needs PyYAML") from e
    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])


def excluded(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, reason, rationale) of the entries that a corpus file leaves out."""
    fields = ("id", "name", "reason", "rationale")
    return spark.createDataFrame([tuple(e.get(f) for f in fields) for e in _yaml(spark, path).get("excluded") or []], ", ".join(f"{f} string" for f in fields))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus entries of a YAML file, a small dimension; every entry needs an id."""
    entries = _yaml(spark, path)["servers"]
    if not all(e.get("id") for e in entries):
        raise ValueError("every server must have an id")
    fields = [f.name for f in spark.createDataFrame([], CORPUS).schema]
    as_text = lambda v: None if v is None else str(v)
    rows = []
    for e in entries:
        row = {k: e.get(k) for k in fields}
        row["flags"] = [{k: as_text(v) for k, v in f.items()} for f in e.get("flags") or []]
        row["package"] = {k: {n: (p.get(n) if n in ("args", "with") else as_text(p.get(n))) for n in ("type", "name", "version", "image", "command", "args", "with")} for k, p in (e.get("package") or {}).items()}
        auth = e.get("auth") or {}
        row["auth"] = {"required": auth.get("required"), "token_env": auth.get("token_env")}
        rows.append(row)
    return spark.createDataFrame(rows, CORPUS)


def auth_required(auth: Column) -> Column:
    return F.coalesce(auth["required"], F.lit(True))


def flag_lines(flags: Column) -> Column:
    """"key: value" of every flag, keys in order within one flag."""
    return F.flatten(F.transform(flags, lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit(": "), m[k]))))


def chosen(rows: DataFrame, only: list[str] | None = None, skip: list[str] | None = None, column: str = "id") -> DataFrame:
    """Rows by id: all, or those of ``only``; never those of ``skip``."""
    out = rows.where(F.col(column).isin(only)) if only else rows
    return out.where(~F.col(column).isin(skip)) if skip else out


def highest_mutual(ours: Column, theirs: Column) -> Column:
    """The first of our revisions that they support, or null."""
    return F.get(F.array_intersect(ours, theirs), 0)


def negotiated(ours: Column, error_code: Column, auth_failed: Column, supported: Column, again_ok: Column) -> Column:
    """struct<branch, revision, error> of a recorded probe at our newest revision.

    No error is a server of that revision; the code for an unsupported version is tried again once at
    the highest mutual revision; a failed credential is final; anything else is a legacy server.
    """
    pick = highest_mutual(ours, F.coalesce(supported, F.array().cast("array<string>")))
    retry, out = error_code == NEGOTIATE, lambda b, r, e: F.struct(b.cast("string").alias("branch"), r.cast("string").alias("revision"), e.cast("string").alias("error"))
    none = F.lit(None)
    return (
        F.when(F.coalesce(auth_failed, F.lit(False)), out(none, none, F.lit("auth"))).when(error_code.isNull(), out(F.lit("discover"), F.get(ours, 0), none))
        .when(retry & pick.isNull(), out(none, none, F.concat(F.lit("no mutually supported revision; server offers ["), F.array_join(supported, " "), F.lit("]"))))
        .when(retry & F.coalesce(again_ok, F.lit(False)), out(F.lit("discover_retry"), pick, none)).when(retry, out(none, none, F.lit("protocol_error"))).otherwise(out(F.lit("legacy"), none, none))
    )


def response_outcome(raw: Column, method: Column) -> Column:
    """struct<kind, detail> of a response's exact text: result, rpc_error, or protocol_error with what is wrong.

    A literal null is no result.
    """
    m = ordered_json.slices_of(raw)
    out = lambda kind, detail=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))
    say = lambda text: F.concat(F.lit("response to "), method, F.lit(text))
    return (
        F.when(m.isNull(), out("protocol_error", F.concat(F.lit("malformed response to "), method))).when(m["error"].isNotNull() & (m["error"] != "null"), out("rpc_error", F.get_json_object(m["error"], "$.message")))
        .when(m["result"].isNull(), out("protocol_error", say(" carries neither result nor error")))
        .when(m["result"] == "null", out("protocol_error", say(" carries a null result, which is neither a result nor an error"))).otherwise(out("result"))
    )


def http_outcome(status: Column, content_type: Column, body: Column) -> Column:
    """struct<kind, payload> of a recorded POST: auth, empty, error, or the response that its body holds."""
    out = lambda kind, payload: F.struct(F.lit(kind).alias("kind"), payload.cast("string").alias("payload"))
    none, found = F.lit(None), event_response(body)
    streamed = F.startswith(F.coalesce(content_type, F.lit("")), F.lit("text/event-stream"))
    return (
        F.when(status.isin(401, 402, 403), out("auth", none)).when(status.isin(202, 204), out("empty", none)).when(status >= 400, out("error", F.concat(F.lit("HTTP "), status.cast("string"))))
        .when(streamed & found.isNull(), out("error", F.lit("no JSON-RPC response frame in event stream"))).when(streamed, out("response", found)).otherwise(out("response", body))
    )


def event_response(body: Column) -> Column:
    """The payload of the first event of a stream's text that is a JSON object with an id, or null.

    Events end at an empty line; their data lines are joined by newlines, each without one blank at
    its beginning.
    """
    lines_ = F.split(F.regexp_replace(body, "\r\n", "\n"), "\n", -1)
    mark = F.transform(lines_, lambda x: F.when(x == "", F.lit("\x00")).when(F.startswith(x, F.lit("data:")), F.regexp_replace(x, "^data: ?", "")))
    events = F.split(F.array_join(F.filter(mark, lambda x: x.isNotNull()), "\n"), "\x00", -1)
    told = F.transform(events, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", ""))
    return F.get(F.filter(told, lambda x: F.startswith(x, F.lit("{")) & F.from_json(x, "map<string,string>").getItem("id").isNotNull()), 0)


def enumerations(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """(server, pages, partial, error) of recorded answers (server, page_no, result, error): cursors are followed until none is left.

    ``result`` is the exact text of a page's result. What fails behind the first page leaves a partial
    surface, and so does a result that is no object or a cursor that never ends.
    """
    cursor = F.coalesce(F.get_json_object("result", "$.nextCursor"), F.lit(""))
    broken = F.col("error").isNull() & ordered_json.slices_of(F.col("result")).isNull()
    why = F.when(F.col("error").isNotNull(), F.col("error")).when(broken, "malformed ListToolsResult").when((F.col("page_no") == most - 1) & (cursor != ""), f"pagination exceeded {most} pages")
    ends = pages.where(F.col("page_no") < most).withColumn("why", why).withColumn("last", F.col("why").isNotNull() | (cursor == ""))
    first = ends.groupBy("server").agg(F.min(F.when(F.col("last"), F.struct("page_no", "why"))).alias("end"), F.count("*").alias("n"))
    partial = F.col("end.why").isNotNull() & ((F.col("end.page_no") > 0) | F.startswith(F.col("end.why"), F.lit("malformed")))
    read = F.col("end.page_no") + F.when(F.col("end.why").isNull() | F.startswith(F.col("end.why"), F.lit("pagination")), 1).otherwise(0)
    return first.select("server", F.coalesce(read, "n").cast("long").alias("pages"), F.coalesce(partial, F.lit(False)).alias("partial"), F.col("end.why").alias("error"))


def optional(read, spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``read`` gives, or an empty table of ``schema`` if there is no such file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return read(spark, path) if there else spark.createDataFrame([], schema)


PUBLISHED = "server string, client string, tokens_median double, tokens_min long, tokens_max long, calls_median double, calls_min long, calls_max long"


def published_traffic(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``PUBLISHED`` of a published document of call traffic; no file gives no rows."""
    spread = "struct<median:double,min:long,max:long>"
    schema = f"servers map<string,struct<clients:array<struct<client:string,call_tokens:{spread},tool_calls:{spread}>>>>"

    def read(spark, path):
        rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("servers").alias("server", "s")).select("server", F.explode("s.clients").alias("c"))
        return rows.select("server", "c.client", *[F.col(f"c.{f}.{x}").alias(f"{n}_{x}") for f, n in (("call_tokens", "tokens"), ("tool_calls", "calls")) for x in ("median", "min", "max")])

    return optional(read, spark, path, PUBLISHED)


def dry_run(corpus_: DataFrame, only: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """(id, name, transport, category) of the entries that a run would contact, which it doesn't."""
    return chosen(corpus_, only, skip).select("id", "name", F.array_join("transport", ",").alias("transport"), "category")
