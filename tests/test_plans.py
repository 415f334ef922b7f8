import math
import os

import duckdb
import pandas as pd
import pytest

from surfaceworks import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.8g}" if not isinstance(v, str) and hasattr(v, "__float__") else str(v)


def rows(df):
    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_agrees_with_its_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, DATA).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_token_counts_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.tokens for r in plans.QUERIES["token_count_bpe"](spark, d).collect()}
    assert got == {i: None if t is None else len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
