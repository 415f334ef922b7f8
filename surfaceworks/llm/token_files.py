"""Token ids in Arrow stream files of equal-length sequences and masks.

A file holds record batches of ``ROWS`` rows (the last may have fewer), each row a fixed-size list
of ids and one of mask bits, so a reader that maps the file finds any sequence by arithmetic and
copies no ids. Documents follow each other without gaps in one file and may span rows; the mask
is false for padding, which only the end of a file has. Ids take 16 bits if the vocabulary allows
it, else 32. Beside each file lies an index, an Arrow stream file of (doc_id, start, n_tokens).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Stash, bound_batches, crc, encoder, only, slices
from .packing import END_ID, SEQUENCE, TOKENIZER

#: Sequences in a record batch.
ROWS = 64


def file_schema(length: int, vocabulary: int) -> pa.Schema:
    ids = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("input_ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """Cuts a stream of ids into rows and writes whole batches of them."""

    def __init__(self, sink, length: int, vocabulary: int):
        self.schema, self.length = file_schema(length, vocabulary), length
        self.kind = self.schema.field(0).type.value_type
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.held = self.rows = 0

    def add(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        full = ROWS * self.length
        if self.held >= full:
            ids, at = np.concatenate(self.ids), 0
            while at + full <= len(ids):
                self._batch(ids[at : at + full], full)
                at += full
            self.ids, self.held = [ids[at:].copy()], len(ids) - at

    def _batch(self, ids: np.ndarray, n: int) -> None:
        """n of the ids are no padding."""
        values = pa.array(ids.astype(self.kind.to_pandas_dtype(), copy=False), self.kind), pa.array(np.arange(len(ids)) < n)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in values]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.rows += len(ids) // self.length

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.ids)
            self._batch(np.concatenate((ids, np.zeros(-len(ids) % self.length, ids.dtype))), len(ids))
        self.out.close()


def write(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, length: int = SEQUENCE, end_id: int = END_ID, folder: str | None = None
) -> DataFrame:
    """Write the files in ascending doc_id order and return their manifest. Runs jobs.

    Manifest: file (its number, in order), path, index_path, n_docs, n_tokens, n_rows, n_before (ids
    in all files before it). The texts are dealt by ranges of (id, hash of the text), so a repeated
    id is split like any other, and each task writes one file; files of failed or repeated attempts
    have names of their own and no manifest line. A null text counts as empty, a null id comes
    first, an empty table gives no files. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or f"{Stash(spark, 'token-files').root}/files"

    def run(batches):
        only("encoder")
        batches = (b for b in batches if b.num_rows)
        first_batch = next(batches, None)
        if first_batch is None:
            return
        context = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        name = f"{context.partitionId():08d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs.create_dir(root, recursive=True)
        n_docs = n_tokens = 0
        with fs.open_output_stream(f"{root}/{name}.arrow") as sink, fs.open_output_stream(f"{root}/{name}.index.arrow") as index_sink:
            writer, index = _Writer(sink, length, encoder(tokenizer).size), pa.ipc.new_stream(index_sink, INDEX)
            batch = first_batch
            while batch is not None:
                texts = batch.column(1)
                for first, n in slices(texts):
                    ids, counts = encoder(tokenizer).encode(texts.slice(first, n), end_id)
                    ends = np.cumsum(counts)
                    writer.add(ids)
                    columns = [batch.column(0).slice(first, n), pa.array(n_tokens + ends - counts), pa.array(counts)]
                    index.write_batch(pa.RecordBatch.from_arrays(columns, schema=INDEX))
                    n_docs += n
                    n_tokens += int(ends[-1])
                batch = next(batches, None)
            writer.close()
            index.close()
        yield pa.RecordBatch.from_pydict(
            {"part": [context.partitionId()], "path": [f"{folder}/{name}.arrow"], "index_path": [f"{folder}/{name}.index.arrow"], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_rows": [writer.rows]}
        )

    placed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    written = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "part long, path string, index_path string, n_docs long, n_tokens long, n_rows long"
    )
    files = Stash(spark, "token-manifest").put(written)
    by_part = Window.orderBy("part")
    before = F.sum("n_tokens").over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    return files.select(
        (F.row_number().over(by_part) - 1).cast("long").alias("file"), "path", "index_path", "n_docs", "n_tokens", "n_rows", F.coalesce(before, F.lit(0)).cast("long").alias("n_before")
    )


def _source(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)


class SequenceFile:
    """Random access to the sequences of one file: row i's ids are a view of the mapped file."""

    def __init__(self, uri: str):
        self.batches = pa.ipc.open_stream(_source(uri)).read_all().to_batches()

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence i; the ids are a view of the file, the mask bits become booleans."""
        batch, row = self.batches[i // ROWS], i % ROWS
        return batch.column(0)[row].values.to_numpy(zero_copy_only=True), batch.column(1)[row].values.to_numpy(zero_copy_only=False)


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start (global), n_tokens, ids_crc32.

    The files are read batch by batch, one task for each; the mask's
    count must agree with the index. Runs a job to count the files.
    """

    def run(batches):
        only("encoder")
        for batch in batches:
            for row in batch.to_pylist():
                stream = pa.ipc.open_stream(_source(row["path"]))
                index = pa.ipc.open_stream(_source(row["index_path"]))
                ids, at, unmasked = None, 0, 0
                for part in index:
                    starts, counts = part.column(1).to_numpy(), part.column(2).to_numpy()
                    need = int(starts[-1] + counts[-1]) - at
                    more = [] if ids is None else [ids]
                    have = sum(map(len, more))
                    while have < need:
                        rows = stream.read_next_batch()
                        more.append(rows.column(0).flatten().to_numpy(zero_copy_only=True))
                        unmasked += rows.column(1).flatten().true_count
                        have += len(more[-1])
                    ids = np.concatenate(more)
                    sums = [crc(ids[s : s + n]) for s, n in zip((starts - at).tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(starts + row["n_before"]), part.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                    )
                    ids, at = ids[need:].copy(), at + need
                if unmasked != at:
                    raise ValueError(f"the mask and the index of {row['path']} differ")

    files = manifest.select("path", "index_path", "n_before")
    n = max(1, manifest.count())
    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
