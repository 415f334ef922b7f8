"""Quality rules: a learned decision list over a text's statistics, with built-in functions only.

Statistics are expressions over the text. From labelled statistics, sequential covering learns
conjunctions of thresholds for the bad class: a rule is grown on one part of the rows by the
condition that gains most, pruned on the other part, kept while it is precise there, and the rows it
covers are removed. The list becomes one conditional expression, first rule first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import GAP

#: Labelled rows that the rules are learned from, at most: those with the smallest hash of the id.
MOST_ROWS = 20_000
MIN_WORDS, MOST_REPEATED = 50, 50

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test: shares and means, so that they hold for texts of any length.
FEATURES = ("symbol_share", "capital_share", "repeat_share", "dup_line_share", "mean_word", "digit_share", "end_share")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: Column) -> DataFrame:
    """Per row of docs: doc_id, ``STATS`` (long), ``FEATURES`` (double), then ``keep``. Nothing is shuffled.

    A null or empty text has no words and 0 in every column. Repeated rows are counted each.

    Repeated words: the words in windows of three that occur twice or more. Windows are compared by
    64-bit hashes: the sorted hashes show which occur twice, and a window covers its three words or
    those up to the next such window.
    """
    t = F.col("_t")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *keep)
    kept = [c for c in rows.columns if c not in ("doc_id", "_t")]
    rows = rows.withColumn("_w", F.array_remove(F.split(t, GAP, -1), ""))
    rows = rows.withColumn("n_words", F.size("_w").cast("long")).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    at = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_win", F.transform(at, lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2))))
    rows = rows.withColumn("_sorted", F.sort_array("_win"))
    rows = rows.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, i: (i > 0) & (x == F.get("_sorted", i - 1)))))
    few = F.filter(F.transform("_win", lambda x, i: F.when(F.array_contains("_twice", x), i)), lambda i: i.isNotNull())
    # many repeated windows: by sorting windows with their places, not by a look-up of each in a list
    pairs = F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("_pairs", F.when(F.size("_twice") > 32, pairs))
    many = F.sort_array(
        F.transform(
            F.filter(
                F.transform("_pairs", lambda p, i: F.struct(p["i"].alias("i"), (((i > 0) & p["x"].eqNullSafe(F.get("_pairs", F.greatest(i - 1, F.lit(0)))["x"])) | p["x"].eqNullSafe(F.get("_pairs", i + 1)["x"])).alias("twice"))),
                lambda p: p["twice"],
            ),
            lambda p: p["i"],
        )
    )
    rows = rows.withColumn("_at", F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.size("_twice") > 32, many).otherwise(few))
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(3), F.get("_at", i + 1) - p)), F.lit(0), lambda a, x: a + x)
    letters, n = F.length(F.regexp_replace(t, r"\P{L}+", "")), F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rows = rows.select(
        "doc_id", "n_words", F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"), letters.alias("_letters"), F.length(F.regexp_replace(t, r"\P{Lu}+", "")).alias("_capitals"), F.regexp_count(t, F.lit("[0-9]")).alias("_digits"),
        F.regexp_count(t, F.lit(r"[.!?]")).alias("_ends"), *kept,
    )
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return rows.select(
        "doc_id", *STATS, (F.col("n_symbols") / chars).alias("symbol_share"), (F.col("_capitals") / F.greatest(F.col("_letters"), F.lit(1)).cast("double")).alias("capital_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"), (F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)).cast("double")).alias("dup_line_share"),
        (F.col("word_chars") / n).alias("mean_word"), (F.col("_digits") / chars).alias("digit_share"), (F.col("_ends") / chars).alias("end_share"), *kept,
    )


# --------------------------------------------------------------------------- learning


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int = 4) -> Rule:
    """Add the condition of largest FOIL gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gained = None, 1e-9
        for f, name in enumerate(FEATURES):
            order = np.argsort(x[inside, f], kind="stable")
            v, y = x[inside, f][order], bad[inside][order]
            cuts = np.flatnonzero(np.diff(v)) + 1
            if not len(cuts):
                continue
            below = np.concatenate(([0], np.cumsum(y)))[cuts]
            for above, p, total in ((False, below, cuts), (True, p0 - below, len(v) - cuts)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / total) - math.log2(p0 / (p0 + n0))), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > gained:
                    gained, best = float(gain[k]), Condition(name, above, float((v[cuts[k] - 1] + v[cuts[k]]) / 2))
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    inside = covers(rule, x)
    p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
    return (p - n) / max(1, p + n)


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 7, most_rules: int = 16, precision: float = 0.9) -> list[Rule]:
    """Rules for the bad class, by sequential covering; no bad rows or no good ones give none."""
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (left & bad).sum() >= 5:
        rows = rng.permutation(np.flatnonzero(left))
        part = np.zeros(len(x), bool)
        for group in (rows[bad[rows]], rows[~bad[rows]]):  # both parts hold both classes
            part[group[: max(1, len(group) * 2 // 3)]] = True
        grow, prune = left & part, left & ~part
        rule = _grow(x[grow], bad[grow])
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: (_worth(r, x[prune], bad[prune]), -len(r)))
        inside = covers(rule, x) & left
        if not (inside & bad).any() or (inside & bad).sum() < precision * inside.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, usable=None) -> list[Rule]:
    """Rules learned from at most ``most_rows`` labelled documents (quality 0 is bad) that ``usable`` (a condition on doc_id) admits. Runs a job.

    Labels without an id or a quality are left out; of labels that repeat an id the smallest quality
    counts, once; of documents that repeat an id the one with the smallest statistics. Null, empty and repeated texts
    are rows like others. No labels give no rules. The sample has a proven bound and is broadcast.
    """
    ok = F.col("doc_id").isNotNull() & F.col("quality").isNotNull()
    chosen = labels.where(ok if usable is None else ok & usable).groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.crc32(F.col("of").cast("string").cast("binary")), "of").limit(most_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    each = statistics(texts, "doc_id", "text", F.col("quality")).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("s"), F.first("quality").alias("quality"))
    rows = each.select("s.*", "quality").collect()
    table = np.array(rows, float).reshape(-1, len(FEATURES) + 1)
    return learn(table[:, :-1], table[:, -1] == 0)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def apply(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the statistics, base_failed, rule (the first that holds, or null), kept.

    A null or empty text has no words and fails the base; repeated rows are judged each; an empty table gives an empty one.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))
    out = statistics(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
