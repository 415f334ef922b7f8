import json

import pytest
from pyspark.sql import functions as F

from surfaceworks.functions import ordered_json as J
from surfaceworks.operators import hygiene, retrieval
from surfaceworks.sources import readers, writers

TOOLS = "server string, tool long, name string, title string, description string"


def surface(spark, rows):
    df = spark.createDataFrame(rows, TOOLS)
    return df.withColumn("descriptor", F.concat_ws(" ", "name", "title", "description"))


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("s", 0, "alpha", "read file"), ("s", 1, "beta", "write file"), ("s", 2, "gamma", "read file contents disk quickly")], "server string, tool long, name string, descriptor string")
    asked = spark.createDataFrame([("s", "q", ["read", "disk"])], "server string, query string, terms array<string>")
    got = {r.name: r.score for r in retrieval.scores(asked, docs).collect()}
    # fixed figures, computed by hand
    assert got == pytest.approx({"alpha": 0.5442147286003255, "gamma": 1.1399401217737202}, abs=1e-12)


def test_derived_queries(spark):
    t = surface(spark, [("s", 0, "build", None, "Compile the project sources into a signed release bundle."), ("s", 1, "other", None, "Compile the project sources into a bundle")])
    got = {r.form: r.text for r in retrieval.derived(t).where("tool = 0").collect()}
    assert got == {"leading": "compile project sources", "bigram": "signed release", "content": "compile project sources signed release bundle"}


def test_undescribed_tools_count_among_the_tools(spark):
    t = surface(spark, [("s", 0, "alpha", None, "Reads every file of a directory."), ("s", 1, "beta", None, None)])
    r = retrieval.retrievability(t).first()
    assert (r.n_tools, r.top3_fraction, r.mrr) == (2, 0.5, 1.0)


def test_similar_pairs_against_all_pairs(spark):
    texts = ["reads files quickly today", "reads files quickly", "writes files quickly today", "something else entirely", "", None, "reads files quickly today"]
    t = surface(spark, [("s", i, f"n{'abcdefg'[i]}x", None, x) for i, x in enumerate(texts)])
    sets = {r.tool: set(r.set) for r in hygiene.token_sets(t).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {(r.ta, r.tb) for r in hygiene.similar(t).collect()} == want and want


def test_one_tool_alone_is_clear(spark):
    assert hygiene.disambiguation(surface(spark, [("s", 0, "a_b", None, "x y z")])).first().disambiguation == 100.0


def test_order_and_numbers_survive():
    assert J.dump(J.parse('{"b": 1.50, "a": [1e5, "x<\\u2028"], "b": null}')) == '{"b":null,"a":[1e5,"x<\\u2028"]}'
    assert J.dump_sorted(J.parse('[{"name":"z","b":1,"a":2},{"name":"a"}]')) == '[{"name":"a"},{"a":2,"b":1,"name":"z"}]'
    assert J.dump_sorted(J.parse('[{"name":"z"},{"x":1}]')) == '[{"name":"z"},{"x":1}]'
    with pytest.raises(ValueError):
        J.parse('{"a":1} x')


def inline(text):
    out, flags = J.inline(J.parse(text))
    return J.dump(out), flags


def test_references():
    assert inline('{"properties":{"a":{"$ref":"#/$defs/x","description":"own"}},"$defs":{"x":{"type":"string","description":"theirs"}}}') == ('{"properties":{"a":{"type":"string","description":"own"}}}', [])
    out, flags = inline('{"$ref":"#/$defs/n","$defs":{"n":{"properties":{"next":{"$ref":"#/$defs/n"}}}}}')
    assert flags == ["recursive_ref_unresolved"] and '"$defs"' in out
    assert inline('{"a":{"$ref":"http://x/y"}}')[1] == ["external_ref_unresolvable"]
    for pointer in ("#/no", "#anchor", "#/list/0"):
        assert inline('{"a":{"$ref":"%s"},"list":[1]}' % pointer)[1] == ["internal_ref_unresolvable"]
    # a sibling may refer to what its neighbour refers to
    assert inline('{"p":{"$ref":"#/$defs/a","not":{"$ref":"#/$defs/a"}},"$defs":{"a":{"type":"string"}}}') == ('{"p":{"type":"string","not":{"type":"string"}}}', [])
    # a target that is an array is walked and takes the place of the reference and its siblings
    assert inline('{"p":{"$ref":"#/$defs/l","x":1},"$defs":{"l":[{"$ref":"#/$defs/s"}],"s":{"type":"null"}}}') == ('{"p":[{"type":"null"}]}', [])
    assert J.inline(J.parse('{"a":{}}'), seconds=-1.0)[1] == ["ref_resolution_bound_exceeded"]


def test_published_order():
    assert J._published_order(list("abc")) == [0, 1, 2] and J._published_order(["b", "a"]) == [1, 0]
    # names stay where they are while elements move, so what follows a moved element is compared with the wrong name
    assert J._published_order(list("cab")) == [1, 0, 2]
    names = [f"{(i * 7) % 50:02}" for i in range(50)]
    order = J._published_order(names)
    assert sorted(order) == list(range(50)) and J._published_order(sorted(names)) == list(range(50))
    assert J.dump_published(J.parse('[{"name":"b"},{"name":"a","z":1,"b":2}]')) == '[{"b":2,"name":"a","z":1},{"name":"b"}]'


def test_schema_walk():
    got = J.properties(J.parse('{"properties":{"b":{"description":"x"},"a":null,"t":true},"items":[{"properties":{"c":{"enum":[1,"q"]}}}],"definitions":{"d":{"properties":{"e":{}}}}}'))
    assert got == [(False, [], ""), (True, [], "x"), (False, ["1", "q"], "")]


def test_params_and_slices():
    assert J.canonical_params('{"b":1.0,"a":2}') == '{"a":2,"b":1.0}' and J.canonical_params("{") == "{" and J.canonical_params(None) == ""
    assert J.raw_slices('{"id": "1", "p" : {"x": 1.50 } }') == {"id": '"1"', "p": '{"x": 1.50 }'}
    for broken in ('{"a":1}trailing', '{"a":1 "b":2}', "[1]", "{"):
        with pytest.raises(ValueError):
            J.raw_slices(broken)


def test_pages_to_graded_surface_and_back(spark, tmp_path):
    tools = [{"name": f"read_{n}", "description": "Reads the contents of one thing.", "execution": 1, "inputSchema": {"properties": {"path": {"type": "string", "description": "Where."}}}} for n in ("file", "page")]
    page = json.dumps({"jsonrpc": "2.0", "id": 1, "result": {"tools": tools}})
    (tmp_path / "demo-wire.jsonl").write_text(page + "\n")
    pages = readers.wire_pages(spark, f"file://{tmp_path}/demo-wire.jsonl")
    read = readers.tools(pages)
    assert [(r.server, r.tool, r.name) for r in read.orderBy("tool").collect()] == [("demo", 0, "read_file"), ("demo", 1, "read_page")]
    s = readers.surfaces(pages, read).first()
    assert s.tool_count == 2 and "execution" not in s.canonical and len(s.canonical_sorted_sha256) == 64
    writers.wire_pages(pages, f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").first().value == page


def test_manifest_and_documents(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"type":"trial","server":"a","trial":1,"success":true}\n\n{"type":"run_header","run_id":"r"}\n')
    rows = readers.manifest(spark, f"file://{tmp_path}/m.jsonl").orderBy("line_no").collect()
    assert [(r.line_no, r.type) for r in rows] == [(0, "trial"), (2, "run_header")]
    doc = {"run": {"date": "2026-01-01"}, "servers": [{"id": "x", "status": "ok", "counts": {"openai_o200k": {"total_schema_tokens": 5}, "claude": {"available": False, "total_schema_tokens": 0}}}, {"id": "y", "status": "auth"}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=2))
    got = {r.id: (r.total, r.claude) for r in readers.run_documents(spark, f"file://{tmp_path}/d.json").collect()}
    assert got == {"x": (5, None), "y": (None, None)}
