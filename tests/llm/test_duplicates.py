import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from surfaceworks.llm import embed_dedup, ngram_join
from surfaceworks.llm.base import Stash, components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def f(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = f(a), f(b)
        up[max(a, b)] = min(a, b)
    return {n: f(n) for n in nodes}


def test_components_of_random_links(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components(spark, df, Stash(spark, "t")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == roots({x for p in real for x in p}, real)
    assert components(spark, df.limit(0), Stash(spark, "t")).count() == 0


def sets(rows, w):
    out = {}
    for i, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        out[i] = {tuple(ws[k : k + w]) for k in range(len(ws) - w + 1)} if len(ws) >= w else {tuple(ws)} if ws else set()
    return out


def near_copies(n=150):
    rng, rows = random.Random(4), []
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=30)
    for g in range(12):
        size = rng.choice([2, 5, 12, 40, 120])
        text = rng.choices(words, k=size) + (passage if g % 3 == 0 else [])
        for _ in range(n // 12):
            t = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, size // 25])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows) * 3, (" ".join(t)).upper() if rng.random() < 0.2 else " \n".join(t)))
    return rows


@pytest.mark.parametrize("w, num, den, crowded", [(3, 90, 100, 512), (5, 80, 100, 512), (2, 60, 100, 2)])
def test_join_against_all_pairs(spark, w, num, den, crowded):
    rows = near_copies()
    s = sets(rows, w)
    links = [(a, b) for a, b in itertools.combinations(s, 2) if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, words=w, num=num, den=den, crowded=crowded).collect()}
    top = roots(s, links)
    assert got == {i: (len(s[i]), top[i]) for i in s} and len(links) > 50


def test_join_of_odd_rows(odd, empty):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(odd).collect())
    assert got[0, 0, 0] == got[1, 0, 1] == got[2, 0, 2] == 1 and got[5, 6, 5] == 2 and got[6, 6, 5] == 1
    assert got[None, 2, None] == 1 and sum(got.values()) == odd.count()
    assert ngram_join.join(empty).count() == 0


@pytest.mark.parametrize("num", [50, 60, 65, 80, 90])
def test_equal_parts_are_found_for_every_similar_pair(num):
    rng, found = np.random.default_rng(num), 0
    for n in (4, 10, 25, 60, 300):
        for k in range(60):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = len(a) * (100 - num) // (100 + num)
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[: len(a) - rng.integers(0, most + 1)]], rng.integers(0, 2**63, rng.integers(0, most + 1)).astype(np.uint64))))
            if k % 3 == 0:  # a subset as small as can be, up to several bands below
                b = a[np.sort(rng.permutation(len(a))[: -(-len(a) * num // 100)])]
            both = len(np.intersect1d(a, b))
            if 100 * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                found += 1
                assert len(np.intersect1d(ngram_join.tile_keys(a, num, 100), ngram_join.tile_keys(b, num, 100)))
    assert found > 50


def test_ids_that_repeat_under_different_texts(spark):
    rng, words = random.Random(9), [f"w{i}" for i in range(300)]
    one, five = " ".join(rng.choices(words, k=40)), " ".join(rng.choices(words, k=80))
    rows = [(1, one), (3, one), (3, five + " end"), (5, five), (7, "some words that no other text has"), (7, None), (5, five), (9, one + " more")]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=90, den=100)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (3, 1), (5, 1), (7, 7), (9, 1)} and got.count() == len(rows)


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a", 1), (2, text + " end", "b", 2), (2, "a text of its own that shares the id", "c", 3), (3, text, "d", 4), (4, "twice the same", "f", 6), (4, "twice the same", "e", 5), (None, text + " end", "g", 7), (5, None, "h", 8), (6, "", "i", 9), (5, None, "h", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, bit int")
    got = sorted((r.doc_id, r.text, r.id, r.bit) for r in ngram_join.one_of_each(df).collect())
    assert got == [(1, text, "a", 1), (2, rows[2][1], "c", 3), (4, "twice the same", "e", 5), (5, None, "h", 8), (6, "", "i", 9)]
    assert ngram_join.one_of_each(df.limit(0)).count() == 0 and ngram_join.one_of_each(df.where("id = 'c'")).count() == 1


def test_sets_with_a_partner_are_never_taken_out(spark):
    """Prints of several slices and buckets: what one set alone holds is counted, copies or not."""
    rng, words = random.Random(2), [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(300):
        t = rng.choices(words, k=60)
        rows.append((len(rows), " ".join(t)))
        if i % 3 == 0:
            t[rng.randrange(60)] = "other"
            rows.append((len(rows), " ".join(t)))
        if i % 5 == 0:
            rows.append((len(rows), rows[-1][1]))
    s = sets(rows, 3)
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    seen = ngram_join._prints(df, 3, True, 7, 9).groupBy("bucket").applyInArrow(ngram_join._alone, "id long, n long, f1 long, f2 long, alone long").collect()
    of = {r.id: r.f1 for r in seen if r.n is not None}
    alone = collections.Counter()
    for r in seen:
        if r.n is None:
            alone[r.f1] += r.alone
    held = collections.Counter(x for t in {frozenset(x) for x in s.values()} for x in t)
    assert set(of) == set(s) and max(alone.values()) > 20
    for i in s:
        assert alone[of[i]] <= sum(held[x] == 1 for x in s[i])



def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    vectors = [(i, (base[i % 40] + rng.normal(size=16) * (0.25 if i % 3 else 0.0)).tolist(), 1) for i in range(300)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, [float("inf")] * 16, 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.dedup(df).collect()}
    m = np.array([v for _, v, _ in vectors])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    top = roots(range(300), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    for i in range(300):
        assert got[i] == (int(near[i].sum()) - 1, top[i], top[i] == i)
    assert all(got[i] == (0, i, True) for i in range(1000, 1005)) and got[1005] == (1, 1005, True) and got[1006] == (1, 1005, False) and got[None] == (0, None, False)
    assert embed_dedup.dedup(df.limit(0)).count() == 0


def test_embeddings_of_one_hot_topic_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    m = unit(np.sqrt(0.8) * unit(rng.normal(size=64)) + np.sqrt(0.2) * unit(rng.normal(size=(5000, 64))))
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame(list(enumerate(m.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.dedup(df).collect()}
    top = roots(range(5000), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    assert near.sum() > 200 and got == {i: (int(near[i].sum()), top[i]) for i in range(5000)}


def test_equal_documents_go_to_all_buckets():
    f1 = np.ones(10_000, np.uint64)
    for ids in (pa.nulls(10_000, pa.int64()), pa.array(np.arange(10_000))):
        counts = np.bincount(ngram_join._homes(f1, ids, 12), minlength=12)
        assert counts.min() > 600 and counts.max() < 1100
    assert len(ngram_join._homes(f1[:0], pa.array([], pa.int64()), 12)) == 0


def test_crowded_tiles_are_dealt_again(spark):
    """Texts that share long passages in turn fill tiles with pairs that don't link; dealt again or not, the links are the same."""
    r = random.Random(6)
    passage = [f"p{i}" for i in range(400)]
    texts = [" ".join([*passage, *(f"w{r.random()}" for _ in range(30 + i % 40))]) for i in range(120)] + [" ".join(passage), " ".join(passage + ["x"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [{r.doc_id: r.component_id for r in ngram_join.join(docs, crowded=c).collect()} for c in (0, 10**9)]
    assert got[0] == got[1] and got[0][121] == got[0][120]


def test_a_pair_that_shares_many_tiles_is_made_once(spark):
    """Each pair of four sets shares all of 40 tiles, and a fifth set one tile with each of them."""
    left = spark.createDataFrame([(k, i, i) for k in range(40) for i in range(4)] + [(100 + i, x, x) for i in range(4) for x in (i, 9)], "key long, id long, component long")
    bits = [0] * (ngram_join.BITS // 64)
    maps = spark.createDataFrame([(i, 10, 0, *bits) for i in (0, 1, 2, 3, 9)], f"id long, n long, ones long, {', '.join(f'b{i} long' for i in range(len(bits)))}")
    tiles = ngram_join._tiles(left).select("key", "members", "main")
    got = [tuple(sorted((r.a, r.b))) for r in ngram_join._pairs(left, tiles, maps, 80, 100).collect()]
    assert sorted(got) == [(a, b) for a in range(4) for b in (*range(a + 1, 4), 9)]


def test_texts_with_a_passage_in_common_link_as_all_pairs_do(spark):
    rng, passage = random.Random(8), [f"p{i}" for i in range(300)]
    rows = [(i, " ".join([*passage[i % 7 :], *(f"w{rng.randrange(40)}" for _ in range(20 + i * 2 % 90))])) for i in range(120)]
    s = sets(rows, 5)
    linked = [(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join(docs, words=5, num=80, den=100).collect()} == roots(s, linked)


def test_stars_are_components_without_a_round(spark):
    stash = Stash(spark, "t")
    got = components(spark, spark.createDataFrame([(1, i) for i in range(2, 40)] + [(70, 60)], "a long, b long"), stash)
    assert stash.n == 1 and {(r.id, r.component) for r in got.collect()} == {(i, 1) for i in range(1, 40)} | {(60, 60), (70, 60)}


def test_near_copies_of_one_text_are_not_linked_by_all_pairs(spark, monkeypatch):
    """The smallest ids have many changes and link with none; all others link with each other, by a few comparisons for each."""
    rng, base, rows = random.Random(12), [f"w{i}" for i in range(204)], []
    for i in range(260):
        t = list(base)
        for at in rng.sample(range(5, 199, 9), 4 if i < 60 else 1):
            t[at] = f"x{i}.{at}"
        rows.append((i, " ".join(t)))
    s = sets(rows, 5)
    linked = [(a, b) for a, b in itertools.combinations(s, 2) if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    seen = []
    monkeypatch.setattr(ngram_join, "components", lambda session, links, stash: seen.append(links.count()) or components(session, links, stash))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), words=5, num=80, den=100)
    assert {r.doc_id: r.component_id for r in got.collect()} == roots(s, linked)
    assert len(linked) > 19_000 and max(seen) < 12 * len(rows)


def test_parts_of_a_tile_s_band_find_a_similar_pair_again():
    rng, found, band = np.random.default_rng(3), 0, np.uint64(ngram_join.BAND_BITS)
    for n in (12, 40, 90, 300):
        for k in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.sort(rng.permutation(a)[: -(-len(a) * (80 + k % 20) // 100)])
            shared = np.intersect1d(ngram_join.tile_keys(a, 80, 100), ngram_join.tile_keys(b, 80, 100))
            again = np.intersect1d(*(ngram_join.tile_keys(x, 80, 100, (ngram_join.SEEDS,)) for x in (a, b)))
            found += len(shared) > 0
            assert set(shared & band) <= set(again & band)
    assert found == 160
