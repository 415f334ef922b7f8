import math

import numpy as np
import pytest

from surfaceworks.llm import whitening
from surfaceworks.llm.queries import op11_whitening

VECTORS = "vec_id long, embedding array<float>, n string"


def plain(rows):
    """The fit by numpy's own eigensolver in one place."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    centred = np.array([[(n * v[j] - sums[j]) / n for j in range(d)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviation = {i: sum((n * v[j] - sums[j]) ** 2 for j in range(d)) for i, v in x.items()}
    whole = {i: np.array([(n * v[j] - sums[j]) / n for j in range(d)]) for i, v in x.items()}
    return n, deviation, whole, values[::-1], vectors[:, ::-1]


def check(got, rows, components=16, gap=1e-6):
    n, deviation, whole, values, vectors = plain(rows)
    k = min(components, int((values > 1e-11 * values[0]).sum()))
    assert len(got) == k * len(rows)
    by = {}
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-6
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-8)
        by.setdefault(r.component, {})[r.vec_id] = r.whitened
    assert set(by) == set(range(1, k + 1))
    for c, w in by.items():
        near = np.abs(values - values[c - 1])
        if (np.sort(near)[1:2] < gap * values[0]).any():
            continue  # equal eigenvalues
        want = {i: float(v @ vectors[:, c - 1]) / math.sqrt(values[c - 1]) for i, v in whole.items()}
        most = max(want, key=lambda i: abs(want[i]))
        sign = math.copysign(1, want[most]) * math.copysign(1, w[most])
        assert all(w[i] == pytest.approx(sign * want[i], abs=1e-7) for i in w)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    check(op11_whitening(spark, d).collect(), rows)


@pytest.mark.parametrize("n, d, rank", [(400, 24, 24), (300, 40, 5), (3, 20, 20), (2, 6, 6), (50, 1, 1), (200, 3, 3)])
def test_against_numpy(spark, n, d, rank):
    r = np.random.default_rng(n)
    base = (r.normal(size=(n, rank)) * np.geomspace(40, 1, rank)) @ np.linalg.qr(r.normal(size=(max(d, rank), max(d, rank))))[0][:rank, :d]
    base = np.round(base) if rank < d else base
    if rank < d:  # whole multiples of few directions, so that the rank stays
        base = np.round(r.normal(size=(n, rank)) * 10) @ np.round(r.normal(size=(rank, d)) * 3)
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # copies count once
    check(whitening.whiten(spark.createDataFrame([(*x, "n") for x in rows], VECTORS).repartition(7)).collect(), rows)


def test_many_partitions_are_added_in_groups(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(r.normal(size=(500, 12)) * 9)]
    df = spark.createDataFrame(rows, "vec_id long, x array<float>")
    distinct = whitening._usable(df, "vec_id", "x").repartition(150)
    assert distinct.rdd.getNumPartitions() > whitening.GROUPS
    model = whitening.fit(distinct, 12, 5)
    _, _, _, values, _ = plain(rows)
    assert model.values == pytest.approx(values[:5], rel=1e-10) and model.trace == pytest.approx(values.sum(), rel=1e-12)


def test_lanczos_restarts_and_stops_early():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(60, 60)))[0]
    low = q[:, :10] * np.arange(10, 0, -1) @ q[:, :10].T  # the ninth and tenth direction come with the second block, then nothing
    values, vectors, passes, restarts = whitening.lanczos(lambda b: low @ b, 60, 16, 8)
    assert values[:10] == pytest.approx(np.arange(10, 0, -1), rel=1e-12) and np.abs(values[10:]).max() < 1e-12 and restarts > 0
    assert np.abs(low @ vectors - vectors * values).max() < 1e-12 and np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12
    steep = q * np.geomspace(1, 1e-30, 60) @ q.T
    assert whitening.lanczos(lambda b: steep @ b, 60, 4, 4)[2] < 15


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (2, None, "a"), (3, [nan, 1.0], "a"), (4, [inf, 1.0], "a"), (5, [None, 1.0], "a"), (6, [], "a"), (7, [1.0], "a"), (8, [0.5, -3.0], "a"), (None, [0.25, 9.0], "a"), (8, [0.5, -3.0], "a"), (9, [1e30, 1.0], "a")]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (8, 1), (8, 1), (8, 2), (8, 2)] and {r.n for r in got} == {3}
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], VECTORS)).count() == 0
    big = [(i, [float(i * 2**40), float(i * i)], "") for i in range(5)]
    assert [r.deviation for r in whitening.whiten(spark.createDataFrame(big, VECTORS)).where("component = 1").collect()].count(None) > 0
