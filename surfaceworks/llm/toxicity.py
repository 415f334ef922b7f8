"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 6, with marks at both ends) and itself, all hashed
into one table of vectors; a word's vector is the mean of its bag, a text's the mean of its words
and some neutral ones.
Table and softmax are learned together, so a misspelling that was never seen shares most n-grams
with words that were. As the model is linear in the table, scoring folds table and softmax into one
number for each n-gram and sums these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SAMPLE_BYTES, bound_batches, chunked_words, learning_rows, only, segment_sums, slices

BUCKETS = 1 << 16
DIM = 4
GRAMS = (3, 4, 5, 6)
#: Labelled rows that the model is learned from, at most: those with the smallest hash of the id.
MOST_ROWS = 8000
STEPS = 24_000
THRESHOLD = 0.3
#: A text's mean vector is multiplied by this before the softmax: toxic words are few in a text.
SCALE = 40.0
#: A text's mean counts so many neutral words besides its own, so one odd word doesn't decide a short text.
NEUTRAL = 20

_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array):
    """chunked_words of the lower-cased texts without signs."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return chunked_words(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " "))


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, word after word; bounds of each word's): at least one for each word."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    ends = np.repeat(starts + lengths, lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes))
    rolled = np.zeros(len(codes), np.uint64)
    hashed, owners = [], []
    whole = np.zeros(len(words), np.uint64)
    np.add.at(whole, owner, codes * ((place - starts[owner]).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + _MULT))
    hashed.append(whole)
    owners.append(np.arange(len(words)))
    for n in range(1, max(GRAMS) + 1):
        if n > len(codes):
            break
        rolled = (rolled[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint64(0x100000001B3)
        rolled ^= rolled >> np.uint64(31)
        if n in GRAMS:
            inside = place[: len(rolled)] + n <= ends[: len(rolled)]
            hashed.append(rolled[inside] + np.uint64(n))
            owners.append(owner[: len(rolled)][inside])
    h, o = np.concatenate(hashed), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    buckets = ((h * _MULT) >> np.uint64(48)).astype(np.int64)[order]
    counts = np.bincount(o, minlength=len(words))
    return buckets, np.concatenate(([0], np.cumsum(counts)))


def text_bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their weights (none for a text without words)."""
    words, index, bounds = words_of(texts)
    buckets, at = bags(words)
    blank = words.index("") if "" in words else -1
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        which, n = np.unique(index[a:b], return_counts=True)
        n, which = n[which != blank], which[which != blank]
        if not len(which):
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        each = (n / (n.sum() + NEUTRAL)) / (at[which + 1] - at[which])
        all_buckets = np.concatenate([buckets[at[w] : at[w + 1]] for w in which])
        sums = np.bincount(all_buckets, np.repeat(each, at[which + 1] - at[which]), BUCKETS)
        found = np.flatnonzero(sums)
        out.append((found, sums[found]))
    return out


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int | None = None, rate: float = 0.5, decay: float = 2e-5, seed: int = 3) -> tuple[np.ndarray, float]:
    """(one number for each bucket, bias) after training table and softmax by AdaGrad, text by text.

    At least 4 epochs, and about ``STEPS`` steps if the rows are few.
    """
    if not rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    epochs = epochs or max(4, -(-STEPS // len(rows)))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.03, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    seen_t, seen_s, seen_b = np.full((BUCKETS, DIM), 1e-3), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i][0].astype(np.int64), rows[i][1].astype(np.float64), rows[i][2]
            own = table[at]
            mean = SCALE * (x @ own)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g_soft, g_mean = np.outer(mean, p), soft @ p
            g = SCALE * np.outer(x, g_mean) + decay * own
            seen = seen_t[at] + g * g
            seen_t[at] = seen
            table[at] = own - rate * g / np.sqrt(seen)
            seen_s += g_soft * g_soft
            seen_b += p * p
            soft -= rate * g_soft / np.sqrt(seen_s)
            bias -= rate * p / np.sqrt(seen_b)
    return (SCALE * (table @ (soft[:, 1] - soft[:, 0]))).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, usable=None, most_rows: int = MOST_ROWS, most_bytes: int = SAMPLE_BYTES):
    """Learn from at most ``most_rows`` labelled documents that ``usable`` (a condition on doc_id) admits, of ``most_bytes`` of bags at most. Runs jobs.

    The chosen ids have a proven bound and are broadcast; texts become bags where they are read, and
    only bags reach the driver. Labels without an id or a value are left out; of labels that repeat an
    id the largest counts, once; of documents that repeat an id one counts. No labels give scores of 0.5.
    """
    ok = F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()
    chosen = labels.where(ok if usable is None else ok & usable).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_y"))
    chosen = chosen.orderBy(F.crc32(F.reverse(F.col("_id").cast("string"))), "_id").limit(most_rows)

    def run(batches):
        only("toxicity")
        for batch in batches:
            for first, n in slices(batch.column(0)):
                rows = text_bags(batch.column(0).slice(first, n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, n), batch.column(2).slice(first, n), pa.array([r[0].astype("<u2").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary())],
                    ["id", "y", "at", "x"],
                )

    bound_batches(docs.sparkSession)
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    table = learning_rows(picked.select("text", F.col("_id").cast("long").alias("id"), "_y").mapInArrow(run, "id long, y int, at binary, x binary"), "toxicity", most_bytes)
    raw = sorted(zip(table["y"].to_pylist(), table["at"].to_pylist(), table["x"].to_pylist(), strict=True))
    del table
    return learn([(np.frombuffer(a, "<u2"), np.frombuffer(x, "<f4"), y) for y, a, x in raw])


def scores(texts: pa.Array, model) -> np.ndarray:
    """How likely each text is toxic, from 0 to 1; a text without words gets the logistic of the bias."""
    per_bucket, bias = model
    words, index, bounds = words_of(texts)
    if not words:
        return np.full(len(texts), 1 / (1 + np.exp(-bias)))
    buckets, at = bags(words)
    of_word = segment_sums(per_bucket[buckets].astype(np.float64), at) / np.diff(at)
    real = np.array([w != "" for w in words])
    of_word[~real] = 0.0
    n = segment_sums(real[index].astype(np.int64), bounds)
    return 1 / (1 + np.exp(-np.clip(bias + segment_sums(of_word[index], bounds) / (n + NEUTRAL), -60, 60)))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of docs. Nothing is shuffled.

    A null or empty text gets the logistic of the bias. Repeated rows are scored each, an empty table
    gives an empty one. Other columns are not read.
    """

    def run(batches):
        only("toxicity")
        for batch in batches:
            for first, n in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(scores(batch.column(1).slice(first, n), model))], ["doc_id", "score"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")
