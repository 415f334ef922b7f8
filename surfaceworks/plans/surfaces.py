"""Queries over tool surfaces made of parts: canonical JSON, references, schema walks, grades with schemas, token counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordered_json
from ..operators import acquisition, hygiene
from ..stash import held
from . import queries as q
from .registry import query, table


def quoted(sql: str) -> str:
    """SQL of a text in which % stands for a double quote."""
    return f"replace({sql}, '%', chr(34))"


#: Parts as tools. Every third has no description of its size; a kind has no enum, one that speaks for itself, one that is described, one that is neither.
TOOL = (
    '{"name":"part_%d","extra":{"x":1.50},"description":"%s","inputSchema":{"type":"object","properties":{"size":{"$ref":"#/$defs/size"},"brand":{"type":"string","description":"%s"},'
    '"shape":{"type":"object","properties":{"kind":%s}}},"$defs":{"size":{"type":"integer"%s}}}}'
)
KINDS = ('{"type":"string"}', '{"enum":["round","flat"]}', '{"enum":["a1","x"],"description":"Only a1 or x."}', '{"enum":["a1","x"],"description":"One of two."}')


def _tools(spark, d):
    # a file of skinny rows is one split; the JSON work on them is dealt to all cores
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_size") % 4 + 1).cast("int"))
    size = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(',"description":"Up to '), F.col("p_size"), F.lit('."')))
    tool = F.format_string(TOOL, F.col("p_partkey"), F.concat(F.lit("Looks up "), F.col("p_name"), F.lit(" by its name.")), F.col("p_brand"), kind, size)
    return p.select("p_partkey", "p_brand", "p_size", "p_name", tool.alias("tool"))


_KIND_SQL = "CASE p_size % 4 WHEN 0 THEN '{%type%:%string%}' WHEN 1 THEN '{%enum%:[%round%,%flat%]}' WHEN 2 THEN '{%enum%:[%a1%,%x%],%description%:%Only a1 or x.%}' ELSE '{%enum%:[%a1%,%x%],%description%:%One of two.%}' END"
_SIZE_SQL = "CASE WHEN p_size % 3 = 0 THEN '' ELSE ',%description%:%Up to ' || p_size || '.%' END"
_SCHEMA_SQL = f"'{{%type%:%object%,%properties%:{{%size%:{{%type%:%integer%' || {_SIZE_SQL} || '}},%brand%:{{%type%:%string%,%description%:%' || p_brand || '%}},%shape%:{{%type%:%object%,%properties%:{{%kind%:' || {_KIND_SQL} || '}}}}}}}}'"
CANONICAL_SQL = quoted(f"'{{%name%:%part_' || p_partkey || '%,%description%:%Looks up ' || p_name || ' by its name.%,%inputSchema%:' || {_SCHEMA_SQL} || '}}'")


@query(f"SELECT p_partkey, {CANONICAL_SQL} AS canonical, 0 AS n_flags FROM part")
def canonical_json(spark, d):
    t = _tools(spark, d).select("p_partkey", ordered_json.read_tool(F.col("tool")).alias("t"))
    return t.select("p_partkey", "t.canonical", F.size("t.flags").alias("n_flags"))


_SORTED_KIND = "CASE p_size % 4 WHEN 0 THEN '{%type%:%string%}' WHEN 1 THEN '{%enum%:[%round%,%flat%]}' WHEN 2 THEN '{%description%:%Only a1 or x.%,%enum%:[%a1%,%x%]}' ELSE '{%description%:%One of two.%,%enum%:[%a1%,%x%]}' END"
_SORTED_SIZE = "CASE WHEN p_size % 3 = 0 THEN '' ELSE '%description%:%Up to ' || p_size || '.%,' END"
SORTED_SQL = quoted(
    f"'{{%description%:%Looks up ' || p_name || ' by its name.%,%inputSchema%:{{%properties%:{{%brand%:{{%description%:%' || p_brand || '%,%type%:%string%}},%shape%:{{%properties%:{{%kind%:' || {_SORTED_KIND} "
    f"|| '}},%type%:%object%}},%size%:{{' || {_SORTED_SIZE} || '%type%:%integer%}}}},%type%:%object%}},%name%:%part_' || p_partkey || '%}}'"
)


@query(
    f"SELECT p_brand || '/' || p_size AS server, sha256('[' || string_agg({SORTED_SQL}, ',' ORDER BY 'part_' || p_partkey) || ']') AS by_name_sha256, sha256('[' || string_agg({CANONICAL_SQL}, ',' ORDER BY p_partkey) || ']') AS canonical_sha256, count(*) AS tools FROM part GROUP BY 1"
)
def canonical_sorted(spark, d):
    # a surface of some tens of tools, as servers have
    t = _tools(spark, d).select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("server"), "p_partkey", ordered_json.read_tool(F.col("tool"))["canonical"].alias("c"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "c"))), lambda x: x["c"]), ",")
    whole = t.groupBy("server").agg(F.concat(F.lit("["), listed, F.lit("]")).alias("surface"), F.count("*").alias("tools"))
    return whole.select("server", F.sha2(ordered_json.sorted_canonical(F.col("surface")), 256).alias("by_name_sha256"), F.sha2("surface", 256).alias("canonical_sha256"), "tools")


def _schema(spark, d):
    return _tools(spark, d).withColumn("schema", ordered_json.read_tool(F.col("tool"))["input_schema"])


_DESCRIBED = "CASE WHEN p_size % 3 = 0 THEN 1 ELSE 2 END + CASE WHEN p_size % 4 >= 2 THEN 1 ELSE 0 END"


@query(f"SELECT p_partkey, CAST(4 AS BIGINT) AS n, CAST({_DESCRIBED} AS BIGINT) AS described, CAST(CASE WHEN p_size % 4 > 0 THEN 1 ELSE 0 END AS BIGINT) AS enums, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'round,flat' ELSE 'a1,x' END AS vals FROM part")
def schema_walk(spark, d):
    p = _schema(spark, d).select("p_partkey", F.explode(ordered_json.schema_properties(F.col("schema"))).alias("p"))
    values = F.max(F.array_join("p.enum", ","))
    return p.groupBy("p_partkey").agg(F.count("*").alias("n"), F.count_if("p.described").alias("described"), F.count_if(F.size("p.enum") > 0).alias("enums"), values.alias("vals"))


PROPERTIES_SQL = f"""SELECT p_brand AS server, {q.PERCENT(f"sum({_DESCRIBED}) / CAST(4 * count(*) AS DOUBLE)")} AS parameter_descriptions,
  coalesce({q.PERCENT("count(*) FILTER (p_size % 4 IN (1, 2)) / CAST(nullif(count(*) FILTER (p_size % 4 > 0), 0) AS DOUBLE)")}, {q.D(100)}) AS enum_documentation FROM part GROUP BY 1"""


def _properties(spark, d):
    rows = _schema(spark, d).select(F.col("p_brand").alias("server"), F.explode(ordered_json.schema_properties(F.col("schema"))).alias("p"))
    return rows.select("server", "p.*")


@query(PROPERTIES_SQL)
def schema_documentation(spark, d):
    return hygiene.property_dims(_properties(spark, d), table(spark, d, "part").select(F.col("p_brand").alias("server")))


_PART_TOOLS = "tools AS (SELECT p_brand AS server, p_partkey AS tool, 'part_' || p_partkey AS name, 'Looks up ' || p_name || ' by its name.' AS description, 'part_' || p_partkey || ' Looks up ' || p_name || ' by its name.' AS descriptor FROM part)"


@query(
    f"""WITH {_PART_TOOLS}, {q.SIMILAR}, {q.DISAMBIGUATION}, named AS (SELECT server, name FROM tools), {q.NAMES}, props AS ({PROPERTIES_SQL}),
dims AS (SELECT server, {q.PERCENT(f"avg({q.ADEQUACY})")} AS description_adequacy, {q.PERCENT(f"avg({q.SAYS})")} AS when_to_use_signal FROM tools GROUP BY server),
scored AS (SELECT d.server, description_adequacy, when_to_use_signal, parameter_descriptions, enum_documentation, naming_clarity, disambiguation,
  {q.ROUND(f"(description_adequacy + when_to_use_signal + parameter_descriptions + enum_documentation + naming_clarity + disambiguation) / {q.D(6)}", 2)} AS score
  FROM dims d JOIN naming n ON d.server = n.server JOIN clear c ON d.server = c.server JOIN props p ON d.server = p.server)
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM scored"""
)
def surface_grade(spark, d):
    # several dimensions look at the tools, which are read once
    read = _tools(spark, d).select(F.col("p_brand").alias("server"), F.col("p_partkey").alias("tool"), ordered_json.read_tool(F.col("tool")).alias("t"))
    read = held(read.select("server", "tool", "t.*"), "tools")
    properties = read.select("server", F.explode(ordered_json.schema_properties(F.col("input_schema"))).alias("p")).select("server", "p.*")
    return hygiene.graded(acquisition.metric_inputs(read)[1], properties)


#: Schemas with a reference beside a sibling, a recursive one, an external one and a fragment that is no pointer.
REFS = (
    '{"properties":{"a":{"$ref":"#/$defs/x","description":"%s"},"b":{"$ref":"#/$defs/x"}},"$defs":{"x":{"type":"string","maxLength":%d}}}',
    '{"properties":{"n":{"$ref":"#/$defs/n","title":"%s"}},"$defs":{"n":{"items":{"$ref":"#/$defs/n"},"maxItems":%d}}}',
    '{"properties":{"e":{"$ref":"http://x/%s/%d"}},"$defs":{"x":{}}}',
    '{"properties":{"e":{"$ref":"#%s%d"}},"definitions":{"x":{}}}',
)
_REFS_SQL = """CASE p_partkey % 4 WHEN 0 THEN '{%properties%:{%a%:{%type%:%string%,%maxLength%:' || p_size || ',%description%:%' || p_brand || '%},%b%:{%type%:%string%,%maxLength%:' || p_size || '}}}'
  WHEN 1 THEN '{%properties%:{%n%:{%items%:{%$ref%:%#/$defs/n%},%maxItems%:' || p_size || ',%title%:%' || p_brand || '%}},%$defs%:{%n%:{%items%:{%items%:{%$ref%:%#/$defs/n%},%maxItems%:' || p_size || '},%maxItems%:' || p_size || '}}}'
  WHEN 2 THEN '{%properties%:{%e%:{%$ref%:%http://x/' || p_brand || '/' || p_size || '%}}}' ELSE '{%properties%:{%e%:{%$ref%:%#' || p_brand || p_size || '%}}}' END"""


@query(f"SELECT p_partkey, {quoted(_REFS_SQL)} AS schema, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'recursive_ref_unresolved' WHEN 2 THEN 'external_ref_unresolvable' ELSE 'internal_ref_unresolvable' END AS flags FROM part")
def ref_inline(spark, d):
    kinds = [F.format_string(r, F.col("p_brand"), F.col("p_size")) for r in REFS]
    raw = F.element_at(F.array(*kinds), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", ordered_json.inlined(raw).alias("r"))
    return rows.select("p_partkey", "r.schema", F.array_join("r.flags", ",").alias("flags"))


class Quarters:
    """A stand-in for an encoder: four characters are a token."""

    def encode_batch(self, texts):
        return [range(-(-len(t) // 4)) for t in texts]


@query("SELECT doc_id, CAST((length(text) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", ordered_json.token_count(F.col("text"), Quarters).alias("tokens"))


TOKENIZER = "word_bpe_49k.json"


@query()
def token_count_bpe(spark, d):
    """Tokens of every text by a real byte-pair encoder; SQL has none, so a test compares with the library."""
    return table(spark, d, "documents").select("doc_id", ordered_json.token_count(F.col("text"), ordered_json.encoder_of(TOKENIZER)).alias("tokens"))


_FAILED = "p_brand LIKE '%1' AND p_size = 7"


@query(
    f"""WITH counted AS (SELECT p_brand AS server, CASE WHEN {_FAILED} THEN NULL ELSE CAST((length({CANONICAL_SQL}) + 3) // 4 AS BIGINT) END AS tokens FROM part),
servers AS (SELECT server, count(*) AS n, count(*) FILTER (tokens IS NULL) AS failed, CAST(sum(tokens) AS BIGINT) AS whole FROM counted GROUP BY server)
SELECT server, failed = 0 AS available, CASE WHEN failed = 0 THEN whole END AS total, CASE WHEN failed = 0 THEN n END AS per_tool_n, CASE WHEN failed = 0 THEN 500 END AS stub,
  CASE WHEN failed = 0 THEN CAST(floor(whole / CAST(n AS DOUBLE)) AS BIGINT) END AS per_tool_avg, CASE WHEN failed = 0 THEN CASE WHEN whole > 0 AND whole < 1000 THEN whole ELSE 1000 END END AS code_mode, n AS scored FROM servers"""
)
def gated_rows(spark, d):
    t = _tools(spark, d).withColumn("c", ordered_json.read_tool(F.col("tool"))["canonical"])
    failed = F.expr(_FAILED)
    counts = t.select(F.col("p_brand").alias("server"), F.concat(F.lit("part_"), "p_partkey").alias("name"), ordered_json.token_count(F.when(~failed, F.col("c")), Quarters).alias("tokens"), F.when(failed, "no").alias("error"))
    whole = counts.groupBy("server").agg(F.lit("ok").alias("status"), F.count("*").alias("counted"), F.sum("tokens").alias("total"), F.lit(None).cast("string").alias("total_error"), F.count("*").alias("scores"))
    out = acquisition.gated(whole.join(acquisition.per_tool(counts), "server"))
    modes = {"stub": "modes.tool_search.stub_tokens", "per_tool_avg": "modes.tool_search.per_tool_avg", "code_mode": "modes.code_mode.tokens_estimate"}
    return out.select("server", "available", "total", F.size(F.map_keys("per_tool")).cast("long").alias("per_tool_n"), *[F.col(c).alias(n) for n, c in modes.items()], F.col("scores").alias("scored"))
