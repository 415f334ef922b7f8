"""The corpus pipeline: from raw documents to packed sequences.

Each stage gets the documents that the one before it kept and gives back documents with the same
columns; the last gives the boundary records of packed sequences. ``run`` writes what a stage gives
to the shared folder and reads it again, so a lost executor never costs an earlier stage. An empty
table, or one of which nothing is kept, gives an empty result; null and empty texts pass the filters
as the classifier scores them and pack as an end id alone; ids may be null or repeat under
different texts, and rows that repeat id and text become one in the n-gram Jaccard join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfaceworks.llm import lines, mixing, ngram_join, packing, quality
from surfaceworks.llm.base import Stash


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled ones outside its held-out fifth, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return quality.keep_good(docs, quality.fit(docs, labels, usable=~held))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than a tenth of a source's documents hold go from every document; copies and near copies count as one document.

    Near copies are those of the next stage, so no text is lost to its own copies.
    """

    def near(holders: DataFrame) -> DataFrame:
        found = ngram_join.join(holders, "id", "text", words=5, num=80, den=100)
        return found.select(F.col("doc_id").alias("id"), F.col("component_id").alias("group"))

    kept = lines.drop_boilerplate(docs, F.col("source"), counts=None, near=near)
    return kept.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles reach a Jaccard similarity of 0.8, directly or by links, the one with the smallest id stays.

    Rows are told apart by id and text, so different texts that share an id are separate documents.
    """
    return ngram_join.one_of_each(docs, words=5, num=80, den=100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions of their targets: whole copies, then part of one more."""
    out = mixing.mix(docs)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: A learned classifier and token ids can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stash = Stash(spark, "pipeline")
    for _, stage in STAGES:
        docs = stash.put(stage(spark, docs, sf_dir))
    return docs
