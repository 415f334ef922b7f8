import pytest
from pyspark.sql import functions as F

from surfaceworks.functions import figures, text


def one(spark, column, *values):
    """The column over a row with the values as a, b, ..."""
    names = "abcdefgh"[: len(values)]
    kinds = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for n, v in zip(names, values, strict=True))
    return spark.createDataFrame([values], kinds).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "given, wanted",
    [("HTTPServerLog", ["http", "server", "log"]), ("Read a file.", ["read", "file"]), ("getURLs", ["get", "ur", "ls"]), ("JSONToXMLv2", ["json", "to", "xm", "lv2"]), ("", []), (None, None)],
)
def test_tokens(spark, given, wanted):
    assert one(spark, text.tokens(F.col("a")), given) == wanted


def test_digit_runs_and_short_parts(spark):
    got = one(spark, text.fragments(F.col("a"), digit_runs=True, keep_short=True), "http2_connect")
    assert got == ["http", "2", "connect"]


@pytest.mark.parametrize("given, wanted", [("", 0.0), ("read", 33.33), ("Read a file now", 66.67), ("Read the contents of a file.", 100.0), (None, 0.0)])
def test_adequacy(spark, given, wanted):
    assert one(spark, text.percent(text.adequacy(F.col("a"))), given) == wanted


@pytest.mark.parametrize("name, weak", [("tool_2", True), ("browser1", True), ("http2_connect", True), ("read_file", False), ("___", True)])
def test_weak_names(spark, name, weak):
    assert one(spark, text.weak(F.col("a")), name) is weak


def test_conforming_and_casing(spark):
    assert one(spark, text.conforming(F.col("a")), "jira.search") is False
    assert [one(spark, text.casing(F.col("a")), n) for n in ("a_b", "a-b", "a.b", "aB", "ab", "a_b-C")] == ["snake", "kebab", "dotted", "camel", "flat", "snake"]


@pytest.mark.parametrize("score, letter", [(100.0, "A"), (89.99, "B"), (74.9, "C"), (59.9, "D"), (39.9, "F"), (90.0, "A")])
def test_grades(spark, score, letter):
    assert one(spark, text.grade(F.col("a")), score) == letter


def test_enums(spark):
    assert one(spark, text.enum_documented(F.col("a"), F.col("b")), ["ro", "rw"], "Use zero-copy transfer") is False
    assert one(spark, text.enum_documented(F.col("a"), F.col("b")), ["ro", "rw"], "Pass ro to read or rw to write") is True
    assert one(spark, text.self_evident(F.col("a")), ["round", "flat"]) is True
    assert one(spark, text.self_evident(F.col("a")), []) is False


def test_refusals_and_says_when(spark):
    assert one(spark, text.refusal_markers(F.col("a")), "I'm sorry, I CANNOT do that") == ["cannot", "i'm sorry"]
    assert one(spark, text.says_when(F.col("a")), "Use this when you must.") is True
    assert one(spark, text.says_when(F.col("a")), None) is False


@pytest.mark.parametrize("total, n, mean, code", [(12000, 30, 400, 1000), (250, 1, 250, 250), (0, 0, 0, 1000)])
def test_modes(spark, total, n, mean, code):
    m = one(spark, figures.modes(F.col("a"), F.col("b")), total, n)
    assert (m.naive.tokens, m.tool_search.per_tool_avg, m.code_mode.tokens_estimate) == (total, mean, code)
    assert one(spark, figures.modes(F.col("a").cast("long"), F.col("b")), None, n) is None


def test_rounding_is_half_up_on_the_scaled_double(spark):
    assert one(spark, text.rounded(F.col("a"), 2), 1.005) == 1.0
    assert one(spark, text.rounded(F.col("a"), 4), 0.00005) == 0.0001


@pytest.mark.parametrize(
    "error, kind, wanted",
    [
        (None, None, "ok"), ("anything", "auth", "auth"), ("x", "deadline", "timeout"), ("x", "cancel", "aborted"), ("forbidden", "protocol", "protocol_error"), ("Unauthorized", "rpc", "auth"),
        ("bad", "rpc", "protocol_error"), ("exec: executable file not found in $PATH", None, "unreachable"), ("dial: connection refused, timeout", None, "unreachable"),
        ("i/o timeout", None, "timeout"), ("403 Forbidden", None, "auth"), ("weird", None, "protocol_error"),
    ],
)
def test_failure_class(spark, error, kind, wanted):
    assert one(spark, figures.failure_class(F.col("a"), F.col("b")), error, kind) == wanted


def test_trial_class(spark):
    rows = [(True, True, 1, False), (True, False, 0, True), (False, True, 3, False), (False, False, 2, True), (False, False, 0, True), (False, False, 0, False)]
    df = spark.createDataFrame(rows, "s boolean, e boolean, c int, r boolean")
    got = [r[0] for r in df.select(figures.trial_class(F.col("s"), F.col("e"), F.col("c"), F.col("r"))).collect()]
    assert got == ["tool_use_success", "answered_without_tools", "client_error", "tool_use_failed", "declined", "failed_no_tool_use"]


def test_permalink_round_trip(spark):
    link = one(spark, figures.permalink(F.array("a", "b"), F.lit("code_mode"), F.lit("gemini")), "x y", "z")
    got = one(spark, figures.from_permalink(F.concat(F.lit("https://h.example/"), F.col("a"))), link)
    assert (got.servers, got.mode, got.model) == (["x y", "z"], "code_mode", "gemini")
    odd = one(spark, figures.from_permalink(F.col("a")), "https://h.example/?servers=&mode=no&model=none")
    assert (odd.servers, odd.mode, odd.model) == ([], "naive", "openai_o200k")


def test_formats(spark):
    assert one(spark, figures.tokens_text(F.col("a")), 1234567) == "1,234,567"
    assert [one(spark, figures.dollars_text(F.col("a")), v) for v in (0.00125, 0.25, 12.5)] == ["$0.0013", "$0.250", "$12.50"]
    assert one(spark, text.package_name(F.col("a")), " My__Pkg.-x ") == "my-pkg-x"
