from pyspark.sql import functions as F

from surfaceworks.operators import acquisition as A
from surfaceworks.sources import readers

YAML = """servers:
  - {id: a, transport: [stdio], package: {stdio: {type: npm, name: pkg, version: 1.2, args: ["{{SCRATCH}}"]}}, auth: {required: false}}
  - {id: b, transport: [remote], endpoint: "https://b.example", auth: {token_env: B_TOKEN}}
  - {id: c, transport: [stdio], package: {stdio: {type: docker, image: "x@sha256:00"}}}
  - {id: d, transport: [sse], endpoint: "https://d.example", auth: {token_env: D_TOKEN}, flags: [{z: 1, a: x}]}
  - {id: e, auth: {required: true}}
  - {id: f, package: {stdio: {type: uvx, name: tool, version: "2", with: ["x<1", "y"]}}, auth: {required: false}}
excluded:
  - {id: z, name: Z, reason: paid, rationale: "no free tier"}
"""


def test_launches_and_credentials(spark, tmp_path):
    (tmp_path / "s.yaml").write_text(YAML)
    corpus = readers.corpus(spark, f"file://{tmp_path}/s.yaml")
    got = {r.id: r for r in A.launches(corpus, "/w").collect()}
    assert (got["a"].source, got["a"].command, got["a"].args, got["a"].pinned) == ("npm:pkg@1.2", "npx", ["-y", "pkg@1.2", "/w"], True)
    assert (got["b"].transport, got["b"].source) == ("remote", "endpoint:https://b.example") and got["c"].pinned
    assert got["d"].error == "only the deprecated HTTP+SSE transport is declared, which the harness does not support" and got["e"].error == "acquisition spec unresolved in the corpus"
    assert got["a"].recorded == ["-y", "pkg@1.2", "{{SCRATCH}}"] and (got["a"].deps.method, got["c"].deps.method, got["b"].deps.method) == ("npx_node_modules_walk", "container_image", "not_applicable")
    assert (got["f"].source, got["f"].args) == ("pypi:tool==2 --with x<1 --with y", ["--with", "x<1", "--with", "y", "tool==2"]) and got["b"].deps.note.startswith("remote transport")
    c = {r.id: (r.present, r.error is None) for r in A.credentials(corpus, {"B_TOKEN": "x"}).collect()}
    assert c == {"a": (False, True), "b": (True, True), "c": (False, False), "d": (False, False), "e": (False, False), "f": (False, True)}
    assert [(r.id, r.reason) for r in readers.excluded(spark, f"file://{tmp_path}/s.yaml").collect()] == [("z", "paid")]
    listed = spark.createDataFrame([("a", '{"prefix":"/x","packages":[["@modelcontextprotocol/sdk","1.0"]]}'), ("f", "boom")], "id string, out string").select("id", A.dependency_listing(F.col("out")).alias("listed"))
    record = {r.id: r.acquisition for r in A.acquisitions(A.launches(corpus, "/w"), A.credentials(corpus, {"B_TOKEN": "x"}), listed, "2026-01-01T00:00:00Z").collect()}
    assert record["a"].resolved_deps.sdk.version == "1.0" and record["a"].args[-1] == "{{SCRATCH}}" and record["b"].env_passed == ["B_TOKEN"] and set(record) == {"a", "b", "c", "f"}
    assert record["f"].resolved_deps.error == "no dependency listing found in 1 lines of output" and record["f"].resolved_deps.packages is None
    assert corpus.where("id = 'd'").select(readers.flag_lines(F.col("flags"))).first()[0] == ["a: x", "z: 1"]
    assert [r.id for r in readers.chosen(corpus, ["a", "b"], ["b"]).collect()] == ["a"]


def test_listing(spark):
    out = ['{"prefix":"old","packages":[]}\nnotice\n{"prefix":"p","packages":[["My_Pkg","1"],["b","2"]]}\nbye', "{}\nnothing", '{"packages":[["x"]]}', None]
    rows = spark.createDataFrame([(o,) for o in out], "o string").select(A.dependency_listing(F.col("o")).alias("d")).select("d.*").collect()
    assert (rows[0].prefix, len(rows[0].packages), rows[0].error) == ("p", 2, None)
    assert [r.error for r in rows[1:]] == ["no dependency listing found in 2 lines of output", "dependency listing carried a malformed entry: [x]", "no dependency listing found in 1 lines of output"]
    hit = spark.createDataFrame([(out[0],)], "o string").select(A.find_package(A.dependency_listing(F.col("o"))["packages"], F.lit("my.pkg")).alias("p")).first().p
    assert hit.version == "1"


def test_models_checks_and_prompts(spark):
    df = spark.createDataFrame([({"x": 5, "y": 9}, "pin", "it is 4.2.1, see docs/a.md", '"./logs/access.log",\n 1,37 \n\n')], "u map<string,long>, p string, t string, s string")
    check = lambda kind, *needles: F.struct(F.lit(kind).alias("kind"), F.array(*map(F.lit, needles)).alias("needles"))
    ask = lambda c: A.succeeded(F.col("t"), F.col("s"), F.lit("t1"), c)
    r = df.select(
        A.resolved_model(F.col("u"), F.col("p")).alias("m"), A.resolved_model(F.lit(None).cast("map<string,long>"), F.col("p")).alias("none"), ask(check("contains", "4.2.1", "docs/a.md")).alias("yes"),
        ask(check("contains", "{trial_id}")).alias("no"), A.rendered(F.lit("{trial_id} {port} {output_dir}"), F.lit("t"), F.lit(8), F.lit("/o")).alias("r"), A.normal_count(F.lit("`1,370`")).alias("n"),
        A.normal_path(F.lit(" '/abs/logs/access.log'. "), "logs/access.log").alias("p"),
    ).first()
    assert (r.m, r.none, r.yes, r.no, r.r, r.n) == ("y", "pin", True, False, "t 8 /o", "1370")


class Flaky:
    """Fails on every first try, and always on one text."""

    def __init__(self):
        self.seen = set()

    def count(self, text):
        if text == "never" or text not in self.seen:
            self.seen.add(text)
            raise OSError("busy")
        return len(text)


def test_hosted_counts_are_tried_again_and_never_estimated(spark):
    from surfaceworks.functions import ordered_json as J

    df = spark.createDataFrame([("four",), ("never",), (None,)], "t string").coalesce(1)
    got = [tuple(r.c) for r in df.select(J.hosted_count(F.col("t"), Flaky, wait=0.0).alias("c")).collect()]
    assert got == [(4, True, None), (None, False, "OSError: busy"), (None, False, "no text")]
    assert [r.c.error for r in df.select(J.hosted_count(F.col("t"), lambda: None).alias("c")).collect()] == ["no client", "no client", "no text"]


def test_a_failure_is_a_row(spark):
    def measure(row):
        if row["id"] == 1:
            raise ConnectionError("connection refused")
        if row["id"] == 2:
            raise ValueError("odd")
        return row["name"].upper()

    got = {r.id: (r.status, r.payload) for r in A.swept(spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "id long, name string"), measure).collect()}
    assert got == {0: ("ok", "A"), 1: ("unreachable", None), 2: ("protocol_error", None), 3: ("ok", "D")}


def test_slots_and_stamps(spark):
    rows = [(f"{c}{i}", c, i == 0, 10 - i, 0, 0) for c in "abcd" for i in range(7)]
    got = [r.id for r in A.slots(spark.createDataFrame(rows, "id string, category string, official boolean, installs int, overlap int, stars int")).collect()]
    assert got[:4] == ["a0", "b0", "c0", "d0"] and len(got) == 15 and not any(x.endswith(("5", "6")) for x in got)
    cells = spark.createDataFrame([tuple(A.STAMPS), (*A.STAMPS[:-1], None), (*A.STAMPS[:-1], "")], ", ".join(f"{s} string" for s in A.STAMPS))
    assert A.releasable(cells).count() == 1
    kept, aborted = A.published(spark.createDataFrame([("a", "ok"), ("b", "aborted")], "id string, status string"), True)
    assert [r.id for r in kept.collect()] == ["a"] and aborted


def test_retrieval_cost(spark):
    from surfaceworks.operators import retrieval

    docs = spark.createDataFrame([("s", 0, "alpha", "read file"), ("s", 1, "beta", "write file"), ("s", 2, "gamma", "other")], "server string, tool long, name string, descriptor string")
    asked = spark.createDataFrame([("s", "q", ["file", "read"]), ("s", "none", ["zzz"]), ("s", "u", ["other"])], "server string, query string, terms array<string>")
    costs = spark.createDataFrame([("s", 0, 10), ("s", 1, 20), ("s", 2, None)], "server string, tool long, tokens long")
    assert {r.query: r.tokens for r in retrieval.search_cost(asked, retrieval.index(docs), costs, 2).collect()} == {"q": 530, "none": 500, "u": None}


def test_optional_documents(spark, tmp_path):
    assert readers.published_traffic(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "t.json").write_text('{"servers":{"a":{"clients":[{"client":"c","call_tokens":{"median":1.5,"min":1,"max":2},"tool_calls":{"median":3,"min":3,"max":3}}]}}}')
    r = readers.published_traffic(spark, f"file://{tmp_path}/t.json").first()
    assert (r.server, r.client, r.tokens_median, r.calls_max) == ("a", "c", 1.5, 3)
