"""The registered queries of the training-data operators, one for each, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, embed_dedup, html_text, lines, mixing, ngram_join, packing, pii, quality, rules, token_files, toxicity, whitening
from .base import Stash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= CAST(0.9 AS DOUBLE)),
reach(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.root = l.a),
lowest AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN lowest ON e.vec_id = id LEFT JOIN counted ON e.vec_id = a
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(spark, token_files.write(_table(spark, sf_dir, "documents")))


def _remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), _remainder(4) == 2
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), usable=~held)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = rules.fit(docs, _table(spark, sf_dir, "labels"))
    return rules.apply(docs, learned).select("doc_id", *rules.STATS, "base_failed", "kept", "rule")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", lines.html_lines(F.col("html")).alias("text"))
    pages = Stash(spark, "page-lines").put(pages)  # the markup is taken off once, for counting and for cutting
    kept = lines.drop_boilerplate(pages, lines.host_of(F.col("url")))
    return kept.select("page_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH texts AS (
  SELECT page_id, ' ' || chr(9) || chr(13) || chr(11) || chr(12) AS blanks, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
    string_split(coalesce(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)</?(p|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|aside|main|table|br|tr|td|th|title|body|html|head)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), '[ \t]+', ' ', 'g'), ''), chr(10)) AS lines
  FROM pages),
seen AS (SELECT DISTINCT page_id, host, trim(unnest(lines), blanks) AS line FROM texts),
totals AS (SELECT host, count(*) AS total FROM texts GROUP BY host),
common AS (
  SELECT s.host, s.line FROM seen s JOIN totals t ON s.host = t.host WHERE s.line <> ''
  GROUP BY s.host, s.line, t.total HAVING count(*) >= 2 AND count(*) > CAST(0.1 AS DOUBLE) * t.total),
listed AS (SELECT host, list(line) AS common FROM common GROUP BY host),
cut AS (
  SELECT page_id, blanks, lines, list_filter(lines, lambda x: trim(x, blanks) = '' OR NOT list_contains(coalesce(common, []), trim(x, blanks))) AS kept
  FROM texts LEFT JOIN listed ON texts.host = listed.host)
SELECT page_id, CAST(len(list_filter(lines, lambda x: trim(x, blanks) <> '')) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM cut
"""


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), _remainder(5) == 0
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), usable=~held)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


QUERIES = {
    "op6_toxicity": op6_toxicity, "op8_line_dedup": op8_line_dedup, "op10_quality": op10_quality,
    "op9_ngram_join": op9_ngram_join,
    "op1_personal_data": op1_personal_data, "op2_embedding_dedup": op2_embedding_dedup, "op7_quality_rules": op7_quality_rules, "op3_mixing": op3_mixing, "op4_packing": op4_packing, "op5_token_files": op5_token_files,
    "op11_whitening": op11_whitening, "op12_html_text": op12_html_text, "op13_conversations": op13_conversations,
}
ORACLES: dict[str, str] = {"op2_embedding_dedup": OP2_SQL, "op8_line_dedup": OP8_SQL}
