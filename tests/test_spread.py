import os

import pytest

from surfaceworks.plans import surfaces

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_json_work_is_dealt_to_tasks(spark):
    """One small file is one split: all JSON work on it would be one task."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert surfaces._tools(spark, DATA).rdd.getNumPartitions() == int(before) > 1
    assert surfaces._tools(spark, DATA).columns == ["p_partkey", "p_brand", "p_size", "p_name", "tool"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stacks_are_dealt_to_tasks(spark):
    """Rows of few bytes each would be put together into one task."""
    from surfaceworks.operators import stack
    from surfaceworks.plans import bindings

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = bindings.stack_rows(spark, DATA)
    assert rows.rdd.getNumPartitions() == n > 1
    # sums by stack and mode need no second deal
    assert stack.totals(stack.by_mode(rows, "2026-01-01")).rdd.getNumPartitions() == n
