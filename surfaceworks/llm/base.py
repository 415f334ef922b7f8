"""What several training-data operators share: components, word arrays, the chunk encoder; stashing is the library's.

Every function here is lazy unless its docstring says that it runs a job.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stash import Stash  # noqa: F401

#: One word: what ASCII white space separates. Java and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch on its way to a Python worker, at most: long texts would fill one of any size.
BATCH_BYTES = 2 << 20

#: Rows in a slice of Arrow text that is worked on at once are bounded by this many bytes.
SLICE_BYTES = 1 << 20


# --------------------------------------------------------------------------- connected components


def components(spark: SparkSession, links: DataFrame, stash: Stash, max_rounds: int = 60) -> DataFrame:
    """Label every end of ``links`` (a long, b long) with the smallest id reachable from it.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every round is two
    aggregations and two joins over the links, which never grow in number, and each round's links
    are stashed. Rounds end when all components are stars. Self links, repeated links and links with a null end are ignored; no links give an
    empty table. Returns (id, component). Runs jobs.
    """
    edges = stash.put(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )

    def both_ways(df: DataFrame) -> DataFrame:
        return df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def settled(df: DataFrame) -> bool:
        """Whether each end has only larger neighbours or one: then a component is a star around its smallest id."""
        ends = both_ways(df).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return not ends.agg(F.count(F.when((F.col("m") < F.col("u")) & (F.col("n") > 1), 1))).first()[0]

    for _ in range(max_rounds):
        if settled(edges):
            break
        both = both_ways(edges)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = stash.put(small)
        stash.drop(edges)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


# --------------------------------------------------------------------------- Arrow text


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold ``BATCH_BYTES`` at most, or less if it says so itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_remembered: dict[str, object] = {}


def remembers(operator: str, forget) -> None:
    """``forget()`` empties what an operator remembers in this worker."""
    _remembered[operator] = forget


def only(operator: str) -> None:
    """Called where an operator begins in a worker: what others remember there goes, as workers outlive their stages."""
    others = [forget for name, forget in _remembered.items() if name != operator]
    for forget in others:
        forget()
    if others:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, bound: int = SLICE_BYTES):
    """(first row, rows) of consecutive slices of about ``bound`` bytes; a longer text is alone."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + bound, "right")))
        yield at, to - at
        at = to
    give_back()  # workers live on, and share their executor's memory


def chunked_words(texts: pa.Array):
    """Words of each text: (distinct words, index of each word, first word of each text and the end).

    Words are separated by ASCII white space; a null text has none. Empty strings can occur among
    the distinct words (texts that begin or end with white space) and stand for no word.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else lists.values
    coded = flat.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive bounds; empty segments give 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


# --------------------------------------------------------------------------- labelled samples

#: Bytes of features that a learner takes to the driver, at most.
SAMPLE_BYTES = 96 << 20


def learning_rows(features: DataFrame, label: str, most_bytes: int = SAMPLE_BYTES) -> pa.Table:
    """(y, at, x) of features (id, y, at binary, x binary), one row for each id, for a learner on the driver. Runs jobs.

    Of rows that share an id the one with the smallest hash counts, once. Ids come in the order of their hash, as
    many as ``most_bytes`` hold: the sample has a bound in bytes, whatever the texts are. At most as many sizes as there are ids come first.
    """
    one = features.groupBy("id").agg(F.min(F.struct(F.xxhash64("at", "x").alias("h"), "y", "at", "x")).alias("r")).select("id", "r.y", "r.at", "r.x")
    rows = Stash(features.sparkSession, label).put(one)
    sizes = rows.select("id", F.crc32(F.reverse(F.col("id").cast("string"))).alias("h"), (F.octet_length("at") + F.octet_length("x")).cast("long").alias("n")).collect()
    taken, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.h, r.id)):
        total += r.n
        if total > most_bytes:
            break
        taken.append((r.id,))
    if len(taken) < len(sizes):
        rows = rows.join(F.broadcast(features.sparkSession.createDataFrame(taken, "id long")), "id")
    return rows.select("y", "at", "x").toArrow()


# --------------------------------------------------------------------------- token ids


#: Texts of these characters alone are lower-cased and cut into pieces here; other texts go to the
#: library chunk by chunk. Both as RE2 reads them.
PLAIN = r"\A[\x09-\x0d\x20-~À-ÖØ-öø-ÿ]*\z"
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
ONE_PIECE = re.compile(f"[{LETTERS}]+").fullmatch
NOT_LETTERS = r"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\x09-\x0d\x20a-z0-9ß-öø-ÿ]+)"


class ChunkEncoder:
    """Token ids of texts with a tokenizers file whose pieces never hold ASCII white space.

    Such a tokenizer gives a text the concatenation of what it gives the chunks between white
    space, so each distinct chunk of a slice is encoded once and remembered: at most ``most`` of
    them, of which those not used lately go. In texts of plain
    Latin-1 letters, digits and ASCII signs the chunks are first lower-cased and cut where the file
    cuts them, since those pieces repeat far more often. The ids come from the library for every
    piece or chunk. A text that could hold an added token, or any other character, isn't cut.

    A chunk of lower-case letters alone is one piece, so it goes straight to the library's model: what
    normalises and cuts texts costs several times as much. Whether the file treats letters so is tried first.
    """

    def __init__(self, path: str, most: int = 1 << 16):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what was known when ``known`` was last full
        self.most = most
        self.model, self.letters = self.tokenizer.model, self._letters()

    def _letters(self) -> dict[int, str] | None:
        """What the model gets for each of ``LETTERS`` (ASCII ones as they are), if the file makes one piece of a row of them; else None."""

        def pieces(text: str) -> list[str]:
            normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
            text = normalizer.normalize_str(text) if normalizer else text
            return [p for p, _ in cutter.pre_tokenize_str(text)] if cutter else [text]

        given = [pieces(c) for c in LETTERS]
        if any(len(x) != 1 or c.isascii() and x != [c] for c, x in zip(LETTERS, given, strict=True)):
            return None
        rows = [LETTERS, LETTERS[::-1]]
        if [pieces(r) for r in rows] != [["".join(given[LETTERS.index(c)][0] for c in r)] for r in rows]:
            return None
        return {ord(c): x for c, (x,) in zip(LETTERS, given, strict=True)}

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk from the library."""
        out: list[bytes] = [b""] * len(chunks)
        apart, tokenize, letters = [], self.model.tokenize, self.letters
        for i, chunk in enumerate(chunks):
            if letters and ONE_PIECE(chunk):
                ids = [t.id for t in tokenize(chunk if chunk.isascii() else chunk.translate(letters))]
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                apart.append(i)
        for at in range(0, len(apart), 4096):
            some = apart[at : at + 4096]
            for i, x in zip(some, self.tokenizer.encode_batch_fast([chunks[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = struct.pack(f"<{len(x.ids)}I", *x.ids)
        return out

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        out = [self.known.get(c) for c in chunks]
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            out[i] = self.before.get(chunks[i])
            if out[i] is None:
                new.append(i)
        for i, x in zip(new, self._encoded([chunks[i] for i in new]), strict=True):
            out[i] = x
        for i in missing:
            if 2 * len(self.known) >= self.most:
                self.before, self.known = self.known, {}
            self.known[chunks[i]] = out[i]
        return out

    @staticmethod
    def _cut(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.and_(pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring(texts, "<|")))
        if not pc.any(plain).as_py():
            return texts
        cut = pc.replace_substring_regex(pc.utf8_lower(texts), NOT_LETTERS, r" \1 ")
        return pc.if_else(plain, cut, texts)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has; ``end_id`` ends each text."""
        words, index, bounds = chunked_words(self._cut(texts))
        coded = self._look_up(words)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        table = np.frombuffer(b"".join(coded), "<u4")
        first = np.cumsum(sizes) - sizes
        n_of_word = sizes[index] if len(index) else np.zeros(0, np.int64)
        counts = segment_sums(n_of_word, bounds)
        at = np.cumsum(n_of_word) - n_of_word
        source = np.repeat((first[index] if len(index) else at) - at, n_of_word) + np.arange(int(n_of_word.sum()))
        ids = table[source]
        if end_id is None:
            return ids, counts
        ends = np.cumsum(counts + 1) - 1
        out = np.full(len(ids) + len(counts), end_id, "<u4")
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = ids
        return out, counts + 1


_encoders: dict[str, ChunkEncoder] = {}


remembers("encoder", _encoders.clear)


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a file; ``path`` without a slash names a file of public_tokenizers."""
    if path not in _encoders:
        file = path
        if "/" not in path:
            import public_tokenizers

            file = public_tokenizers.path(path)
        _encoders[path] = ChunkEncoder(file)
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
