import itertools
import random
import statistics

import pytest

from surfaceworks.operators import trials
from surfaceworks.operators.medians import medians


def groups(seed):
    r = random.Random(seed)
    big = {
        "even": [r.gauss(0, 1) for _ in range(400)], "steep": [2.0**-i for i in range(60)], "same": [7.0] * 501, "two": [1.0] * 300 + [2.0] * 300, "huge": [1.7e308, -1.7e308] * 200 + [0.0], "ties": [float(i % 5) for i in range(903)],
        "one": [3.0], "pair": [1.0, 4.0], None: [float(i) for i in range(350)], "tiny": [5e-324 * i for i in range(400)],
    }
    rows = [(k, x) for k, xs in big.items() for x in xs] + [("none", None), ("none", float("nan")), ("even", None)]
    r.shuffle(rows)
    return big, rows


@pytest.mark.parametrize("most_values, bins", [(0, 256), (60, 64)])
def test_medians_by_ranges(spark, most_values, bins):
    big, rows = groups(most_values)
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: (r.n, r.median) for r in medians(df, ["k"], "v", most_rows=0, most_values=most_values, bins=bins).collect()}
    assert got == {**{k: (len(x), statistics.median(x) if k != "huge" else 0.0) for k, x in big.items()}, "none": (0, None)}


def test_cells_alike_on_both_paths(spark):
    r = random.Random(1)
    rows = [("1", f"s{i % 2}", "c", i % 3, r.random() < 0.5, r.choice([None, r.randint(0, 10**6)])) for i in range(900)]
    df = spark.createDataFrame(rows, "suite_version string, server string, client string, task int, success boolean, chars long")
    one, two = (sorted(map(str, trials.cells(df, ("chars",), most_rows=k).collect())) for k in (10**9, 10))
    assert one == two and len(one) == 6
    assert medians(df.limit(0), ["server"], "chars", most_rows=-1).count() == 0


def test_rollups_kept_up_to_date_equal_one_batch(spark):
    """Three batches in any order, one of them twice, with trials that supersede others."""
    r = random.Random(8)
    rows = [("1", r.choice(["a", "b", None]), "c", r.randint(0, 2), r.randint(0, 4), line, r.choice([True, False, None]), r.choice([None, r.randint(0, 99)])) for line in range(60)]
    schema = "suite_version string, server string, client string, task int, trial int, line_no long, success boolean, chars long"
    roll = lambda t: trials.cells(t, ("chars",))
    frame = lambda some: spark.createDataFrame(some, schema).coalesce(1)
    want = sorted(map(str, roll(trials.last_of_each(frame(rows))).collect()))
    parts = [rows[:20], rows[20:40], rows[40:]]
    for order in list(itertools.permutations(parts))[::2]:
        state = cells = None
        for batch in [*order, order[0]]:
            state = spark.createDataFrame(trials.merged(state, frame(batch)).collect(), schema).coalesce(1)
            out = trials.refreshed(cells, state, frame(batch), roll)
            cells = spark.createDataFrame(out.collect(), out.schema).coalesce(1)
        assert sorted(map(str, cells.collect())) == want
