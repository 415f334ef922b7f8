"""Quality classifier: logistic regression on hashed word n-grams, learned by FTRL-proximal.

A text's features are counts of hashed n-grams over its words, divided by the number of words:
single words and pairs of neighbours, each both as the word itself (lower case, without signs
around it) and as its shape (runs of capitals, small letters, digits and signs), and one for a word
that repeats the word before it. A score is the logistic of one sparse dot product.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SAMPLE_BYTES, bound_batches, chunked_words, give_back, learning_rows, only, remembers, segment_sums, slices

SIZE = 1 << 18
#: Labelled rows that the weights are learned from, at most: those with the smallest hash of the id.
MOST_ROWS = 4000
THRESHOLD = 0.3
SCALE = 8.0

_MULT = np.uint64(0x9E3779B97F4A7C15)
_RUNS = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"))
_CORE = re.compile(r"^[\W_]+|[\W_]+$")


def shape(word: str) -> str:
    """Runs of letters as A (capitals), a (small) or Aa, of digits as 0; other signs stay, runs of one as two."""

    def letters(m: re.Match) -> str:
        w = m[0]
        return "a" if w.islower() else "A" if w.isupper() and len(w) > 1 else "Aa"

    out = _RUNS[1].sub("0", _RUNS[0].sub(letters, word))
    return re.sub(r"([^\w])\1+", r"\1\1", out)


_known: dict[str, tuple[int, int]] = {"": (0, 0)}
MOST_KNOWN = 60_000


def _forget() -> None:
    _known.clear()
    _known[""] = (0, 0)


remembers("quality", _forget)


def _hash(word: str) -> tuple[int, int]:
    got = _known.get(word)
    if got is None:
        core = _CORE.sub("", word.lower())
        got = xxhash.xxh3_64_intdigest("w" + core), xxhash.xxh3_64_intdigest("s" + shape(word))
        if len(_known) < MOST_KNOWN:
            _known[word] = got
    return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MULT
    return x >> np.uint64(64 - 18)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each n-gram, n-gram bounds of each text, words of each text)."""
    distinct, index, bounds = chunked_words(texts)
    table = np.array([_hash(w) for w in distinct], np.uint64).reshape(-1, 2)
    keep = index != (distinct.index("") if "" in distinct else -1)
    bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
    word, form = table[index[keep], 0], table[index[keep], 1]
    n = len(word)
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[:-1] < n]] = True
    before_w, before_f = np.roll(word, 1), np.roll(form, 1)
    before_w[first] = before_f[first] = np.uint64(1)
    again = np.where((before_w == word) & ~first, np.uint64(7), np.uint64(11))
    grams = np.stack([_mix(word), _mix(form + np.uint64(3)), _mix(before_w * np.uint64(31) + word), _mix(before_f * np.uint64(37) + form), _mix(again)], axis=1)
    return grams.reshape(-1).astype(np.int64), bounds * 5, np.diff(bounds)


def sparse(grams: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """One text's distinct features and their values."""
    which, counts = np.unique(grams, return_counts=True)
    return which, counts * (SCALE / max(1, n_words))


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, seed: int = 5):
    """(weights, bias) by FTRL-proximal (McMahan et al., 2013) over (features, values, label)."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    rng = np.random.default_rng(seed)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, SIZE), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(SIZE + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _learned(table: pa.Table):
    """``learn`` on rows (y, at, x), whatever their order. The rows stay views of the table, so the driver holds them once."""
    rows = [(np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(x.as_buffer(), "<f4"), y) for y, a, x in zip(table["y"].to_pylist(), table["at"], table["x"], strict=True)]
    rows.sort(key=lambda r: (len(r[0]), r[2]))
    alike = itertools.groupby(rows, lambda r: (len(r[0]), r[2]))
    return learn([r for _, some in alike for r in sorted(some, key=lambda r: r[0].tobytes())])


def fit(docs: DataFrame, labels: DataFrame, usable=None, most_rows: int = MOST_ROWS, most_bytes: int = SAMPLE_BYTES):
    """Learn from at most ``most_rows`` labelled documents that ``usable`` (a condition on doc_id) admits, of ``most_bytes`` of features at most. Runs jobs.

    The chosen ids have a proven bound and are broadcast; texts become features where they are read,
    and only features reach the driver. Labels without an id or a quality are left out; of labels that
    repeat an id the smallest quality counts, once; of documents that repeat an id one counts. No labels
    give the weights 0.
    """
    ok = F.col("doc_id").isNotNull() & F.col("quality").isNotNull()
    chosen = labels.where(ok if usable is None else ok & usable).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("_y"))
    chosen = chosen.orderBy(F.crc32(F.reverse(F.col("_id").cast("string"))), "_id").limit(most_rows)

    def run(batches):
        only("quality")
        for batch in batches:
            for first, n in slices(batch.column(0)):
                grams, bounds, words = features(batch.column(0).slice(first, n))
                rows = [sparse(grams[a:b], w) for a, b, w in zip(bounds[:-1], bounds[1:], words, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, n), batch.column(2).slice(first, n), pa.array([r[0].astype("<u4").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary())],
                    ["id", "y", "at", "x"],
                )

    bound_batches(docs.sparkSession)
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    table = learning_rows(picked.select("text", F.col("_id").cast("long").alias("id"), "_y").mapInArrow(run, "id long, y int, at binary, x binary"), "quality", most_bytes)
    model = _learned(table)
    del table
    give_back()
    return model


def scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    grams, bounds, words = features(texts)
    sums = segment_sums(weights[grams].astype(np.float64), bounds)
    return 1 / (1 + np.exp(-(bias + SCALE * sums / np.maximum(1, words))))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): how likely each text is good, from 0 to 1. Nothing is shuffled.

    A null or empty text gets the logistic of the bias. Repeated rows are scored each, an empty table
    gives an empty one. Other columns are not read.
    """
    weights, bias = model

    def run(batches):
        only("quality")
        for batch in batches:
            for first, n in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(scores(batch.column(1).slice(first, n), weights, bias))], ["doc_id", "score"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores ``threshold`` or more."""
    weights, bias = model
    at = docs.columns.index(text_col)

    def run(batches):
        only("quality")
        for batch in batches:
            for first, n in slices(batch.column(at)):
                part = batch.slice(first, n)
                yield part.filter(pa.array(scores(part.column(at), weights, bias) >= threshold))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
