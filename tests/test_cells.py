import random

from pyspark.sql import functions as F

from surfaceworks.operators import cells, hygiene
from tests.test_surfaces import surface


def test_blocks_of_a_large_server_meet(spark, monkeypatch):
    monkeypatch.setattr(cells, "ROWS", 8)
    rng = random.Random(1)
    vocabulary = [f"word{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    texts = [" ".join(rng.sample(vocabulary, rng.choice((4, 9, 20)))) for _ in range(30)]
    near = [" ".join(x.split()[:-1] + ["other"]) for x in texts[:12]]
    large = " ".join(f"big{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefg")
    rows = [("s" if i % 7 else "r", i, f"n{i}", None, x) for i, x in enumerate([*texts, *near, *texts[:5], large, large + " more", "", None])]
    t = surface(spark, rows)
    sets = {(r.server, r.tool): set(r.set) for r in hygiene.token_sets(t).collect()}
    want = {(s, a, b) for s, a in sets for r, b in sets if s == r and a < b and len(sets[s, a] & sets[s, b]) >= 0.6 * len(sets[s, a] | sets[s, b])}
    assert {(r.server, r.ta, r.tb) for r in hygiene.similar(t).collect()} == want and len(want) > 10
    ends = {(s, f"n{x}") for s, a, b in want for x in (a, b)}
    assert {(r.server, r.name) for r in hygiene.flagged(t).collect()} == ends


def test_flagged_without_listing_pairs(spark):
    """3,000 tools alike in all but one word: 4.5 million pairs, which aren't needed to flag them."""
    t = spark.range(3000).select(F.lit("s").alias("server"), F.col("id").alias("tool"), F.concat(F.lit("t_"), F.col("id")).alias("name"), F.concat(F.lit("reads files of one folder number"), F.col("id")).alias("descriptor"))
    shown = []
    counted = hygiene.cells.links
    hygiene.cells.links = lambda *a: shown.append(a) or counted(*a)
    try:
        assert hygiene.disambiguation(t).first().disambiguation == 0.0 and not shown
    finally:
        hygiene.cells.links = counted


def test_one_id_under_two_texts_is_no_pair(spark):
    t = surface(spark, [("s", 1, "a", None, "reads files of a folder today"), ("s", 1, "a", None, "reads files of a folder soon"), ("s", 2, "b", None, "else entirely")])
    assert not hygiene.flagged(t).count() and not hygiene.similar(t).count()


def test_sets_that_differ_in_their_own_words_are_compared_once(spark, monkeypatch):
    """600 tools of two texts and a number: the cells get a set for each text, not for each tool."""
    met = []
    monkeypatch.setattr(cells, "of_pairs", lambda rows, key, f=cells.of_pairs: met.append(rows.count()) or f(rows, key))
    text = F.when(F.col("id") % 3 == 0, "reads files of one folder").otherwise("copies long lists between remote stores")
    t = spark.range(600).select(F.lit("s").alias("server"), F.col("id").alias("tool"), F.concat(F.lit("t_"), F.col("id")).alias("name"), F.concat(text, F.lit(" x"), 100 + F.col("id")).alias("descriptor"))
    assert hygiene.flagged(t).count() == 600 and met == [2]


def test_flags_of_own_words_and_repeated_tools(spark):
    """Few common words and some of their own, ids under several texts, equal sets: as all pairs tell."""
    rng = random.Random(5)
    rows = []
    for i in range(160):
        words = rng.sample(["alpha", "beta", "gamma", "delta", "kappa", "sigma"], rng.choice((3, 4, 5))) + [f"own{i}x{k}" for k in range(rng.choice((0, 0, 1, 2)))]
        rows.append((rng.choice("pq"), i if rng.random() < 0.7 else rng.randrange(6), f"n{i}", None, " ".join(words)))
    rows += [("w", 1, "a", None, "alpha beta gamma first"), ("w", 1, "b", None, "alpha beta gamma second"), ("w", 2, "c", None, "alpha beta gamma other words too here")]
    t = surface(spark, rows)
    sets = [(r.server, r.tool, r.name, set(r.set)) for r in hygiene.token_sets(t).collect()]
    want = {(s, n) for s, a, n, x in sets for r, b, _, y in sets if s == r and a != b and len(x & y) >= 0.6 * len(x | y)}
    assert {(r.server, r.name) for r in hygiene.flagged(t).collect()} == want and 20 < len(want) < len(sets) - 20
