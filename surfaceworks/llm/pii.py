"""Personal data in texts, with built-in functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for IBANs, value
ranges for addresses and numbers, a mix of signs for secrets), and words near a span raise its score
or lower it. A span counts when its score reaches ``THRESHOLD``. The kinds of ``BASE`` are confirmed
by their validators alone and stay whatever their score; the others need a checksum, a form of their
own or words that speak for them.

Matches are found by cutting a text at a pattern: the lengths of what lies between the matches and
of the matches themselves give every match's place in code points. They are summed in chunks, so the
work grows with the text and not with the square of its matches. The words near a span are those up
to the next match of its kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: Code points before and behind a span in which words count, and what they add.
REACH, CONTEXT = 48, 0.35
#: Matches whose places are summed at once.
CHUNK = 128

_PLACE = "struct<start:int,end:int,found:string,before:string,after:string>"
_PLACES = f"struct<pos:int,out:array<{_PLACE}>>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Whether the digits of c pass the Luhn check."""
    each = F.transform(F.split(F.reverse(digits(c)), ""), lambda x: x.cast("int"))
    doubled = F.transform(each, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, x * 2 - 9).otherwise(x * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(c: Column) -> Column:
    """Whether c, without blanks, is an IBAN whose check digits are right."""
    bare = F.upper(F.regexp_replace(c, " ", ""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda x: x != ""),
        F.lit(0),
        lambda a, x: F.when(x.between("0", "9"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97),
    )
    return rest == 1


def parts_to_255(c: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return c.rlike(rf"^{part}(?:\.{part}){{3}}$")


def count_digits(low: int, high: int):
    return lambda c: F.length(digits(c)).between(low, high)


def mixed_signs(c: Column) -> Column:
    """Whether a secret looks made, not written: letters and digits, of more than a few kinds."""
    value = F.regexp_extract(c, r"([A-Za-z0-9+/_.~-]{12,}=*)[\"']?$", 1)
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


@dataclass(frozen=True)
class Kind:
    """``gate``: what a text must hold to be searched; ``score``: of a confirmed span without context; ``near`` raises it, ``far`` lowers it."""

    name: str
    pattern: str
    gate: str
    confirm: object
    score: float
    near: str
    far: str = ""
    stays: bool = False


#: The patterns match what the plain ones match, but only try where a match can begin and never
#: step back within a run: local parts begin at the run's start or where a match has just ended.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda c: F.lit(True), 0.6, "mail|contact|write|reach|schreib|correo|courriel", "", True),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}", r"\.", parts_to_255, 0.6, r"\bip\b|address|host|server|login|adresse", r"version|release|section|chapter", True),
    Kind("card", r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])", "[0-9]", luhn, 0.6, "card|visa|master|amex|credit|debit|karte|tarjeta|carte|pay", "isbn|order|tracking|serial", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+", count_digits(10, 15), 0.6, "phone|tel|call|mobile|cell|fax|whatsapp|anruf|llam|appel", "", True),
)

MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[0-9]", mod97, 0.6, "iban|bank|account|konto|cuenta|compte", "part no|serial|order"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", lambda c: F.lit(True), 0.3, r"ssn|social|security|\btax", "part no|serial|order"),
    Kind("national_phone", r"(?<![0-9+.(-])(?<!\+[0-9]{1,3}[ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", "[0-9]", lambda c: F.lit(True), 0.3, r"phone|\btel|call|mobile|\bcell|\bfax|whatsapp|anruf|llam|appel", "isbn|part no|serial|order"),
    Kind("short_card", r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?+[0-9]){11,12}+(?![ -]?[0-9])", "[0-9]", luhn, 0.3, "card|visa|master|amex|maestro|credit|debit", "isbn|ean|order|tracking|serial"),
    Kind("spelled_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]{1,63}+){1,4}+", r"[\[(] ?at ?[\])]", lambda c: F.lit(True), 0.5, "mail|contact"),
    Kind(
        "secret", r"(?i)(?<![a-z0-9])(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth)[\"']?[ \t]{0,3}(?:[:=]|=>)[ \t]{0,3}[\"']?[a-z0-9+/_.~-]{12,}+=*[\"']?",
        "(?i)token|secret|passw|key|auth", mixed_signs, 0.6, "login|credential|config|env|curl|header", "example|placeholder|dummy|changeme|your[_-]",
    ),
    Kind("known_key", r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])", "AKIA|gh[pousr]_|xox|sk-|eyJ", lambda c: F.lit(True), 0.8, "key|token|secret", "example|placeholder"),
    Kind("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "PRIVATE KEY", lambda c: F.lit(True), 0.9, "key"),
)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once: inside a lambda an expression is evaluated for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found, before, after>> of a pattern's leftmost non-overlapping matches, in code points."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    length = lambda s: F.length(s["g"]) + F.length(s["m"])

    def place(a, s):
        at, end = a["pos"] + F.length(s["g"]), a["pos"] + length(s)
        one = F.struct(at.alias("start"), end.alias("end"), s["m"].alias("found"), F.right(s["g"], F.lit(REACH)).alias("before"), F.left(s["z"], F.lit(REACH)).alias("after")).cast(_PLACE)
        return F.struct(end.alias("pos"), F.array_append(a["out"], one).alias("out")).cast(_PLACES)

    def chunked(steps):
        firsts = F.sequence(F.lit(0), F.greatest((F.size(steps) - 1).cast("int"), F.lit(0)), F.lit(CHUNK))
        return F.transform(firsts, lambda i: F.slice(steps, i + 1, F.lit(CHUNK)))

    def bases(chunks):
        """Where each chunk begins."""
        start = F.struct(F.lit(0).alias("pos"), none("int").alias("out"))
        return F.aggregate(chunks, start, lambda a, c: F.struct((a["pos"] + F.aggregate(c, F.lit(0), lambda n, s: n + length(s))).alias("pos"), F.array_append(a["out"], a["pos"]).alias("out")).cast("struct<pos:int,out:array<int>>"))["out"]

    whole = lambda chunks: F.flatten(F.zip_with(chunks, bases(chunks), lambda c, b: F.aggregate(c, F.struct(b.alias("pos"), none(_PLACE).alias("out")).cast(_PLACES), place)["out"]))
    steps = lambda f: F.slice(F.arrays_zip(f["m"].alias("m"), f["g"].alias("g"), F.slice(f["g"], F.lit(2), F.size(f["m"])).alias("z")), F.lit(1), F.size(f["m"]))
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return _let(found, lambda f: _let(steps(f), lambda st: _let(chunked(st), whole)))


def _scored(k: int, kind: Kind, threshold: float) -> Column:
    """The confirmed spans of a kind whose score, with the words around them, reaches the threshold, or which stay anyway."""

    def span(s):
        around = F.lower(F.concat_ws(" ", s["before"], s["after"]))
        score = F.lit(kind.score) + F.when(around.rlike(kind.near), F.lit(CONTEXT)).otherwise(F.lit(0.0))
        if kind.far:
            score = score - F.when(around.rlike(kind.far), F.lit(CONTEXT)).otherwise(F.lit(0.0))
        return F.struct(
            s["start"].alias("start"), F.lit(k).alias("kind_no"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"), s["found"].alias("found")
        )

    confirmed = F.transform(F.filter(F.col(f"found_{k}"), lambda s: kind.confirm(s["found"])), span)
    return confirmed if kind.stays else F.filter(confirmed, lambda s: s["score"] >= threshold)


def _of_kind(name: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == name)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = BASE + MORE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, spans): spans array<struct<start, kind_no, end, kind, score, found>> in order of start and kind.

    kind_no is the kind's place in ``kinds``. Nothing is shuffled. A null text counts as empty and
    has no spans, a repeated row is searched each time, an empty table gives an empty one. Spans of
    different kinds may overlap; those of one kind don't. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast(f"array<{_PLACE}>")
    for k, kind in enumerate(kinds):
        rows = rows.withColumn(f"found_{k}", F.when(F.col("text").rlike(kind.gate), places(F.col("text"), kind.pattern)).otherwise(none))
    scored = [_scored(k, kind, threshold) for k, kind in enumerate(kinds)]
    return rows.select("doc_id", "text", F.array_sort(F.concat(*scored)).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): each found span replaced by its kind in angle brackets; of overlapping spans the first.

    A null or empty text becomes empty, a repeated row is redacted each time, an empty table gives an
    empty one. Long texts are cut at their spans, each copied once.
    """
    found = find(docs, id_col, text_col)
    first = "struct<pos:int,out:array<struct<start:int,end:int,kind:string>>>"
    walk = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("pos"), F.array().alias("out")).cast(first),
        lambda a, s: F.when(s["start"] < a["pos"], a).otherwise(F.struct(s["end"].alias("pos"), F.array_append(a["out"], F.struct(s["start"], s["end"], s["kind"])).alias("out")).cast(first)),
    )
    text, spans = F.col("text"), F.col("spans")
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
    pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.lit("<"), s["kind"], F.lit(">")))
    last = F.when(F.size(spans) > 0, F.get(spans, F.size(spans) - 1)["end"]).otherwise(0)
    return found.select("doc_id", "text", walk["out"].alias("spans")).select("doc_id", F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text))).alias("text"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the base kinds, how many spans there are of any kind, and all spans as a string."""
    base = [k.name for k in BASE]
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
