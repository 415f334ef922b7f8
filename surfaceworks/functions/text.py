"""Column expressions over names, descriptions and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DESCRIPTION_LENGTH, GRADES, LAST_GRADE, REFUSALS, SENTENCE_WORDS, STOPWORDS, WHEN_TO_USE


#: Where a name is cut besides at signs: before a capital behind a small letter or digit, and before the last capital of a run.
_CASE = r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
_DIGITS = r"|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})"
_SIGNS = r"[^\p{L}\p{Nd}]+"


def lowered(c: Column) -> Column:
    """Lower case character by character: no final sigma, no dot above a dotted capital i."""
    return F.lower(F.translate(c, "\u03a3\u0130", "\u03c3i"))


def fragments(c: Column, digit_runs: bool = False, keep_short: bool = False) -> Column:
    """Parts of an identifier or text: cut at what is no letter or digit, and where case changes.

    ``digit_runs`` also cuts between letters and digits; without ``keep_short`` single characters go.
    """
    parts = F.split(c, f"{_SIGNS}|{_CASE}{_DIGITS if digit_runs else ''}")
    least = 1 if keep_short else 2
    return F.filter(parts, lambda x: F.length(x) >= least)


def tokens(c: Column, keep_short: bool = False) -> Column:
    """Fragments in lower case."""
    # the text is marked where case cuts it and lowered once, not part by part
    marked = F.when(c.rlike(r"\p{Lu}"), lowered(F.regexp_replace(c, _CASE, " "))).otherwise(c)
    least = 1 if keep_short else 2
    return F.filter(F.split(marked, _SIGNS), lambda x: F.length(x) >= least)


def content_words(c: Column) -> Column:
    """Tokens without stopwords, in order and with repetition."""
    return content(tokens(c))


def content(words: Column) -> Column:
    """Of tokens those that are no stopwords."""
    return F.filter(words, lambda x: ~x.isin(*STOPWORDS))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def without(words: Column, others: Column) -> Column:
    return F.filter(words, lambda x: ~F.array_contains(others, x))


def stripped(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def descriptor(name: Column, title: Column, description: Column) -> Column:
    return F.array_join(F.filter(F.array(name, title, description), lambda x: x.isNotNull() & (x != "")), " ")


def source_text(description: Column, title: Column) -> Column:
    """The text that queries come from: the description, else the title, else null."""
    d, t = stripped(F.coalesce(description, F.lit(""))), stripped(F.coalesce(title, F.lit("")))
    return F.when(d != "", d).when(t != "", t)


def adequacy(description: Column) -> Column:
    """Share of three checks that a description passes: there, of fair length, a sentence."""
    d = stripped(F.coalesce(description, F.lit("")))
    low, high = DESCRIPTION_LENGTH
    fields = F.size(F.filter(F.split(d, r"(?U)\s+"), lambda x: x != ""))
    sentence = (fields >= SENTENCE_WORDS) & d.rlike(r"^\p{L}")
    checks = [d != "", F.length(d).between(low, high), sentence]
    return sum((c.cast("int") for c in checks), F.lit(0)).cast("double") / F.lit(3.0)


def says_when(description: Column) -> Column:
    low = F.lower(F.coalesce(description, F.lit("")))
    return _any(F.contains(low, F.lit(k)) for k in WHEN_TO_USE)


def conforming(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9_-]{1,128}$")


def weak(name: Column) -> Column:
    """Whether a name has a part of one character or of digits alone, or no part."""
    parts = fragments(name, digit_runs=True, keep_short=True)
    return (F.size(parts) == 0) | F.exists(parts, lambda x: (F.length(x) < 2) | x.rlike(r"^\p{Nd}+$"))


def casing(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("_")), "snake").when(F.contains(name, F.lit("-")), "kebab").when(F.contains(name, F.lit(".")), "dotted").when(
        F.lower(name) != name, "camel"
    ).otherwise("flat")


def enum_documented(values: Column, description: Column) -> Column:
    """Whether a description names a value, or every value speaks for itself."""
    said = tokens(description, keep_short=True)
    named = F.exists(values, lambda v: (F.size(tokens(v, keep_short=True)) > 0) & (F.size(F.array_except(tokens(v, keep_short=True), said)) == 0))
    return named | self_evident(values)


def self_evident(values: Column) -> Column:
    return (F.size(values) > 0) & F.forall(values, lambda v: v.rlike(r"^\p{L}[\p{L}\p{Nd}_.-]{2,}$"))


def grade(score: Column) -> Column:
    out = F.lit(LAST_GRADE)
    for least, letter in reversed(GRADES):
        out = F.when(score >= F.lit(least), F.lit(letter)).otherwise(out)
    return F.when(score.isNotNull(), out)


def rounded(c: Column, places: int) -> Column:
    """Half up on the scaled double, as the published figures are rounded."""
    scale = F.lit(float(10**places))
    return F.floor(c * scale + F.lit(0.5)) / scale


def percent(share: Column) -> Column:
    return rounded(share * F.lit(100.0), 2)


def refusal_markers(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.filter(F.array(*map(F.lit, REFUSALS)), lambda m: F.contains(low, m))


def package_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[-_.]+", "-")


def first_lines(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(stripped(c), "\n"), F.lit(1), F.lit(n)), " | ")


def shortened(c: Column, most: int = 160) -> Column:
    """The first line of several; of one line that is too long its first ``most`` characters and three dots."""
    one = F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
    return F.when(F.contains(c, F.lit("\n")), F.split_part(c, F.lit("\n"), F.lit(1))).otherwise(one)
