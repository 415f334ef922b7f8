import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, component string"

ODD = [None, "", " \n\t ", "a", "x y", "the same words again and again " * 3, "the same words again and again " * 3, "Ünï ß 日本 <|endoftext|> q\x1fz don't", "1 " * 3000, "word " * 9000]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", len(t or ""), "size", None) for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "no id at all", "en", "s0", 12, "x", "y"), (3, "another text of the same id", None, "s1", 27, "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
