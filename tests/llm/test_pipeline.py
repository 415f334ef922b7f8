import corpus_pipeline

from surfaceworks.llm.base import Stash

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, tmp_path):
    good = lambda i: " ".join(f"word{(i * 7 + k) % 50} number{k}x{i}" for k in range(40))
    rows = [(i, good(i) + ("\nread our terms" if i % 2 else ""), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, good(i) + " tail", "en", "s1", 0) for i in range(10)]  # near copies
    rows += [(200 + i, " ".join(f"JUNK{k}!! X{i}!!" for k in range(30)), "en", "s0", 0) for i in range(40)]
    rows += [(300, None, None, None, None), (301, "", "en", None, 0)]
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    d = corpus(spark, tmp_path)
    docs, stash, seen = spark.read.parquet(f"{d}/documents.parquet"), Stash(spark, "t"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stash.put(stage(spark, docs, d))
        if name != "packing":
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        seen.append((name, out))
        docs = out
    by = dict(seen)
    ids = lambda n: {r.doc_id for r in by[n].collect()}
    assert {i for i in ids("quality classifier") if i >= 200} <= {300, 301} and set(range(60)) <= ids("quality classifier")
    assert not any("read our terms" in (r.text or "") for r in by["line dedup"].collect())
    assert not ids("n-gram Jaccard join") & set(range(100, 110)) and set(range(60)) <= ids("n-gram Jaccard join")
    words = sum(len((r.text or "").split()) for r in by["n-gram Jaccard join"].collect())
    mixed = sum(len((r.text or "").split()) for r in by["mixing"].collect())
    assert abs(mixed - 1.5 * words) <= 4
    assert sum(r.length for r in by["packing"].collect()) >= mixed
    assert corpus_pipeline.run(spark, d).count() == by["packing"].count()


def test_boilerplate_goes_from_documents_that_are_mostly_boilerplate(spark):
    common = "a long line that every page of this source repeats again and again"
    rows = [(i, f"{common}\nown {i}", "en", "s", 0) for i in range(30)] + [(100 + i, "one text\nof which\nthere are copies", "en", "s", 0) for i in range(20)]
    got = {r.doc_id: r.text for r in corpus_pipeline.without_boilerplate(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {i: f"own {i}" if i < 100 else t for i, t, *_ in rows}


def test_near_copies_dont_empty_each_other(spark):
    """Two near copies in a source of 12: the lines they share stay, and the join keeps one of them whole."""
    lines = [f"line {k} says what no other says, {k * k} and {k + 7}" for k in range(20)]
    rows = [(i, "\n".join(f"text {i} line {k} alone {i * k}" for k in range(5)), "en", "s", 0) for i in range(10)]
    rows += [(20, "\n".join(lines), "en", "s", 0), (21, "\n".join([*lines, "one more line"]), "en", "s", 0)]
    kept = corpus_pipeline.without_boilerplate(spark, spark.createDataFrame(rows, DOCS), "")
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t, *_ in rows}
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, kept, "").collect()} == {*range(10), 20}
    banner = [(i, f"{t}\na line on every page of this source\r", *rest) for i, t, *rest in rows]
    kept = corpus_pipeline.without_boilerplate(spark, spark.createDataFrame(banner, DOCS), "")
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t, *_ in rows}
