"""Packing: concatenate all documents' token ids and cut the stream into sequences of equal length.

Two passes. The first encodes every text once and stashes, per document, its ids and where it
begins within its input partition. The totals of the partitions, one number each, are summed up in
order to give each partition its place in the global stream. The second pass cuts each document
where the stream crosses a multiple of the sequence length and needs no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Stash, bound_batches, encoder, only, slices

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048
END_ID = 1

#: Beyond so many partitions their places in the stream are joined by a shuffle, not broadcast (16 bytes each).
MOST_BROADCAST = 500_000


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, part, part_start, n_tokens, ids): ids as little-endian unsigned 32-bit numbers.

    part is the input partition, part_start counts the ids before the document in it.
    """

    def run(batches):
        only("encoder")
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for first, n in slices(texts):
                ids, counts = encoder(tokenizer).encode(texts.slice(first, n), end_id)
                ends = np.cumsum(counts)
                offsets = pa.array(np.concatenate(([0], ends)) * 4, pa.int64()).buffers()[1]
                blob = pa.Array.from_buffers(pa.large_binary(), n, [None, offsets, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(np.full(n, part)), pa.array(at + ends - counts), pa.array(counts), blob.cast(pa.binary())],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                at += int(ends[-1])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, part long, part_start long, n_tokens long, ids binary"
    )


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, length: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """The boundary records of the packed sequences, one per piece of a document. Runs a job.

    Columns: doc_id, start (ids of the document before the piece), length, ids (binary, if
    ``with_ids``), ids_crc32, doc_tokens (with the end id), sequence_id, offset. The offsets of a
    sequence run from 0 without gaps; only the last sequence can be shorter than ``length``, and is
    to be padded to it. A null or empty text is the end id alone, rows that repeat an id are packed
    each for itself, a null id stays null, an empty table gives no pieces. Other columns of ``docs``
    are not read. Documents follow each other as the input's partitions hold them.
    """
    spark = docs.sparkSession
    coded = Stash(spark, "pack").put(encoded(docs, id_col, text_col, tokenizer, end_id))
    totals = coded.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    places, base = [], 0
    for part, n in totals:
        places.append((part, base))
        base += n
    placed = spark.createDataFrame(places, "part long, base long")
    if len(places) <= MOST_BROADCAST:
        placed = F.broadcast(placed)
    begin = F.col("base") + F.col("part_start")
    cut = coded.join(placed, "part").withColumn("begin", begin)

    def piece(s):
        lo = F.greatest(s * length, F.col("begin")) - F.col("begin")
        hi = F.least((s + 1) * length, F.col("begin") + F.col("n_tokens")) - F.col("begin")
        own = F.substring(F.col("ids"), (lo * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int"))
        fields = [lo.alias("start"), (hi - lo).alias("length"), F.crc32(own).alias("ids_crc32"), s.alias("sequence_id"), (lo + F.col("begin") - s * length).alias("offset")]
        return F.struct(*fields, *([own.alias("ids")] if with_ids else []))

    windows = F.sequence(F.expr(f"begin div {length}"), F.expr(f"(begin + n_tokens - 1) div {length}"))
    out = cut.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    names = ["p.start", "p.length", *(["p.ids"] if with_ids else []), "p.ids_crc32"]
    return out.select("doc_id", *names, "doc_tokens", "p.sequence_id", "p.offset")
