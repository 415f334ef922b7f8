"""JSON that keeps what Spark's own types lose: the order of keys and the text of numbers.

The functions on Python values are pure; the Arrow-batched UDFs at the end apply them to columns.
"""

from __future__ import annotations

import json
import re
import time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BAD_POINTER, EXTERNAL_REF, RECURSIVE_REF, REF_BOUND, REF_DEPTH, REF_FLAGS, REF_NODES, REF_SECONDS, SCHEMA_DEPTH, TOOL_FIELDS


class Number(str):
    """A number as it was written."""


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(text: str):
    """A value whose objects keep the first place and the last value of a repeated key; trailing content is an error."""
    return json.loads(text, parse_float=Number, parse_int=Number, parse_constant=_no_constant)


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_ESCAPED = re.compile("[\"\\\\\x00-\x1f\u2028\u2029\ud800-\udfff]")


def _escape(m: re.Match) -> str:
    c = m[0]
    return "\ufffd" if "\ud800" <= c <= "\udfff" else _ESCAPES.get(c) or f"\\u{ord(c):04x}"


def dump(value, key=None) -> str:
    """Compact text, objects in their own order or in that of ``key``."""
    if isinstance(value, dict):
        items = value.items() if key is None else sorted(value.items(), key=lambda kv: key(kv[0]))
        return "{" + ",".join(f"{dump(k)}:{dump(v, key)}" for k, v in items) + "}"
    if isinstance(value, list):
        return "[" + ",".join(dump(v, key) for v in value) + "]"
    if isinstance(value, Number):
        return str.__str__(value)
    if isinstance(value, str):
        return '"' + _ESCAPED.sub(_escape, value) + '"'
    return {None: "null", True: "true", False: "false"}[value]


def _named(value) -> bool:
    return isinstance(value, list) and all(isinstance(v, dict) and type(v.get("name")) is str for v in value)


def dump_sorted(value) -> str:
    """Keys in code point order at every depth; a top-level array by name, if all its elements have one."""
    if _named(value):
        value = sorted(value, key=lambda v: v["name"])
    return dump(value, key=lambda k: k)


def dump_published(value) -> str:
    """As ``dump_sorted``, but a top-level array in the order that published digests have.

    Published digests come from a stable sort in place that compares the names by position while only
    the elements move: runs of 20 by insertion, then merges in place that double. Arrays that are
    sorted already, or short and nearly so, keep the order by name.
    """
    if _named(value):
        value = [value[i] for i in _published_order([v["name"] for v in value])]
    return dump(value, key=lambda k: k)


def _published_order(names: list[str], run: int = 20) -> list[int]:
    """Places of the elements after the sort of ``dump_published``; names never move."""
    order, n = list(range(len(names))), len(names)
    less = lambda i, j: names[i] < names[j]

    def shift(source: int, to: int) -> None:
        order.insert(to, order.pop(source))

    def first(low: int, high: int, holds) -> int:
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if holds(middle) else (middle + 1, high)
        return low

    def merge(a: int, m: int, b: int) -> None:
        if m - a == 1:
            shift(a, first(m, b, lambda h: not less(h, a)) - 1)
        elif b - m == 1:
            shift(m, first(a, m, lambda h: less(m, h)))
        else:
            middle = (a + b) // 2
            n = middle + m
            start = first(*((n - b, middle) if m > middle else (a, m)), lambda c: less(n - 1 - c, c))
            end = n - start
            if start < m < end:
                order[start:end] = order[m:end] + order[start:m]
            if a < start < middle:
                merge(a, start, middle)
            if middle < end < b:
                merge(middle, end, b)

    for a in range(0, n, run):
        for i in range(a + 1, min(a + run, n)):
            j = i
            while j > a and less(j, j - 1):
                j -= 1
            shift(i, j)
    while run < n:
        for a in range(0, n - run, 2 * run):
            merge(a, a + run, min(a + 2 * run, n))
        run *= 2
    return order


class _Inliner:
    """Replaces local references in place, in the order in which the document holds them.

    What is inlined already is what later references copy. ``open`` holds the references being
    followed; the siblings of a reference are read with those that were open before it.
    """

    def __init__(self, root, seconds: float = REF_SECONDS):
        self.root, self.flags, self.nodes, self.until = root, set(), 0, time.monotonic() + seconds

    def target(self, ref: str):
        """A copy of what a local reference points to; KeyError if there is none."""
        node = self.root
        if ref != "#":
            start, *parts = ref[1:].split("/")
            if start or not parts:
                raise KeyError(ref)
            for part in parts:
                if not isinstance(node, dict):
                    raise KeyError(part)
                node = node[part.replace("~1", "/").replace("~0", "~")]
        return _copy(node)

    def walk(self, node, open_refs: frozenset[str] = frozenset(), depth: int = 0):
        self.nodes += 1
        if depth > REF_DEPTH or self.nodes > REF_NODES or time.monotonic() > self.until:
            self.flags.add(REF_BOUND)
        elif isinstance(node, list):
            node[:] = [self.walk(v, open_refs, depth + 1) for v in node]
        elif isinstance(node, dict) and type(node.get("$ref")) is str:
            return self.follow(node, open_refs, depth)
        elif isinstance(node, dict):
            for k, v in node.items():
                node[k] = self.walk(v, open_refs, depth + 1)
        return node

    def follow(self, node: dict, open_refs: frozenset[str], depth: int):
        ref = node["$ref"]
        flag = EXTERNAL_REF if not ref.startswith("#") else RECURSIVE_REF if ref in open_refs else None
        if not flag:
            try:
                found = self.target(ref)
            except KeyError:
                flag = BAD_POINTER
        if flag:
            self.flags.add(flag)
            return node
        found = self.walk(found, open_refs | {ref}, depth + 1)
        if isinstance(found, dict):
            found = dict(found)
            for k, v in node.items():
                if k != "$ref":
                    found[k] = self.walk(v, open_refs, depth + 1)
        return found


def _copy(value):
    if isinstance(value, dict):
        return {k: _copy(v) for k, v in value.items()}
    return [_copy(v) for v in value] if isinstance(value, list) else value


def inline(schema, seconds: float = REF_SECONDS) -> tuple[object, list[str]]:
    """The schema with local references replaced, and the flags of what could not be.

    Siblings of a reference win, a target that is no object takes the place of both. A recursive one
    stays, an external one or a bad pointer too; the definitions at the root go unless something
    still needs them.
    """
    work = _Inliner(schema, seconds)
    out = work.walk(schema)
    if isinstance(out, dict) and not work.flags & {RECURSIVE_REF, REF_BOUND}:
        out = {k: v for k, v in out.items() if k not in ("$defs", "definitions")}
    return out, [f for f in REF_FLAGS if f in work.flags]


def properties(schema) -> list[tuple[bool, list[str], str]]:
    """(described, enum values, enum description) of every schema property, ``SCHEMA_DEPTH`` levels deep."""
    out: list[tuple[bool, list[str], str]] = []

    def read(p) -> None:
        if p is None:
            out.append((False, [], ""))
        elif isinstance(p, dict):
            said = p.get("description") if type(p.get("description")) is str else ""
            values = p.get("enum") if isinstance(p.get("enum"), list) else []
            out.append((said.strip() != "", [v if type(v) is str else dump(v) for v in values], said))

    def walk(node, depth: int) -> None:
        if depth > SCHEMA_DEPTH or not isinstance(node, dict):
            return
        owned = node.get("properties")
        if isinstance(owned, dict):
            for k in sorted(owned):
                read(owned[k])
                walk(owned[k], depth + 1)
        for k in ("items", "additionalProperties", "not"):
            sub = node.get(k)
            for s in sub if isinstance(sub, list) else [sub]:
                walk(s, depth + 1)
        for k in ("oneOf", "anyOf", "allOf", "prefixItems"):
            for s in node.get(k) if isinstance(node.get(k), list) else []:
                walk(s, depth + 1)
        defs = node.get("$defs")
        for k in sorted(defs) if isinstance(defs, dict) else []:
            walk(defs[k], depth + 1)

    walk(schema, 0)
    return out


def canonical_tool(raw: dict) -> tuple[dict, list[str]]:
    """The tool's allowed fields in their order, schemas with references inlined, and flags."""
    tool, flags = {}, set()
    for k, v in raw.items():
        if k in TOOL_FIELDS:
            if k in ("inputSchema", "outputSchema"):
                v, found = inline(v)
                flags |= set(found)
            tool[k] = v
    return tool, [f for f in REF_FLAGS if f in flags]


def raw_slices(text: str) -> dict[str, str]:
    """The exact source text of each value of a JSON object, by key; ValueError if the text is anything else."""
    parse(text)
    decoder, out = json.JSONDecoder(), {}
    at = re.compile(r"\s*").match(text, 0).end()
    if text[at : at + 1] != "{":
        raise ValueError("no object")
    at += 1
    gap = re.compile(r"[\s,:]*")
    while True:
        at = gap.match(text, at).end()
        if text[at : at + 1] == "}":
            return out
        key, at = decoder.raw_decode(text, at)
        at = gap.match(text, at).end()
        _, end = decoder.raw_decode(text, at)
        out[key], at = text[at:end], end


def canonical_params(text: str | None) -> str:
    """Parameters with sorted keys; what doesn't parse stays as it is, none is empty."""
    if text is None:
        return ""
    try:
        return dump(parse(text), key=lambda k: k)
    except ValueError:
        return text


# --------------------------------------------------------------------------- columns

_TOOL = T.StructType(
    [
        T.StructField("name", T.StringType()), T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("canonical", T.StringType()),
        T.StructField("input_schema", T.StringType()), T.StructField("flags", T.ArrayType(T.StringType())), T.StructField("excluded", T.BooleanType()), T.StructField("error", T.StringType()),
    ]
)


def _read_tool(text: str | None) -> dict:
    empty = dict.fromkeys(_TOOL.names)
    try:
        raw = parse(text or "")
        if not isinstance(raw, dict) or type(raw.get("name")) is not str:
            raise ValueError("a tool without a name")
        tool, flags = canonical_tool(raw)
    except (ValueError, RecursionError) as e:
        return empty | {"error": str(e)[:200]}
    word = lambda k: tool[k] if type(tool.get(k)) is str else None
    return {
        "name": word("name"), "title": word("title"), "description": word("description"), "canonical": dump(tool), "input_schema": dump(tool["inputSchema"]) if "inputSchema" in tool else None,
        "flags": flags, "excluded": bool({EXTERNAL_REF, BAD_POINTER} & set(flags)), "error": None,
    }


def _batched(f, returns):
    @F.pandas_udf(returns)
    def run(column: pd.Series) -> pd.Series:
        return column.map(f)

    return run


def read_tool(c: Column) -> Column:
    """struct<name, title, description, canonical, input_schema, flags, excluded, error> of a tool's JSON text."""

    @F.pandas_udf(_TOOL)
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read_tool(x) for x in column], columns=_TOOL.names)

    return run(c)


def _try(f):
    def run(x):
        try:
            return None if x is None else f(x)
        except (ValueError, RecursionError):
            return None

    return run


def canonical(c: Column) -> Column:
    """Compact text in the order of the source; null of what doesn't parse."""
    return _batched(_try(lambda x: dump(parse(x))), T.StringType())(c)


def sorted_canonical(c: Column, published: bool = False) -> Column:
    """Compact text with sorted keys, tools by name or in the order of published digests."""
    dumped = dump_published if published else dump_sorted
    return _batched(_try(lambda x: dumped(parse(x))), T.StringType())(c)


def params(c: Column) -> Column:
    return _batched(canonical_params, T.StringType())(c)


def slices_of(c: Column) -> Column:
    """map of a JSON object's keys to the exact text of their values; null of what is no object."""
    return _batched(_try(raw_slices), T.MapType(T.StringType(), T.StringType()))(c)


PROPERTY = "array<struct<described:boolean,enum:array<string>,enum_desc:string>>"


def schema_properties(c: Column) -> Column:
    def read(x):
        try:
            return [] if x is None else [{"described": d, "enum": e, "enum_desc": s} for d, e, s in properties(parse(x))]
        except (ValueError, RecursionError):
            return []

    return _batched(read, PROPERTY)(c)


def inlined(c: Column) -> Column:
    """struct<schema, flags> of a schema's text."""

    @F.pandas_udf("schema string, flags array<string>")
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for x in column:
            try:
                out, flags = inline(parse(x))
                rows.append((dump(out), flags))
            except (TypeError, ValueError, RecursionError):
                rows.append((None, []))
        return pd.DataFrame(rows, columns=["schema", "flags"])

    return run(c)


def encoder_of(path: str):
    """A factory for ``token_count`` of the encoder in a tokenizers file; a path without a slash names one of public_tokenizers."""

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        file = path
        if "/" not in path:
            import public_tokenizers

            file = public_tokenizers.path(path)
        return _Library(Tokenizer.from_file(file))

    return make


class _Library:
    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode_batch(self, texts: list[str]) -> list:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


#: Characters of texts that an encoder gets at once, unless one text has more: what it gives back takes many times their memory.
COUNT_CHARS = 1 << 18


def counted(texts: list[str], encode) -> list[int]:
    """How many tokens each text has, by ``encode(texts) -> lists`` of few texts at a time."""
    out, start, chars = [], 0, 0
    for i, x in enumerate(texts):
        if i > start and chars + len(x) > COUNT_CHARS:
            out += map(len, encode(texts[start:i]))
            start, chars = i, 0
        chars += len(x)
    return out + (list(map(len, encode(texts[start:]))) if start < len(texts) else [])


def token_count(c: Column, encoder_factory) -> Column:
    """Tokens of a text by the encoder that ``encoder_factory()`` makes once in each worker (it has ``encode_batch(texts) -> lists``)."""
    cache: list = []

    @F.pandas_udf("long")
    def run(column: pd.Series) -> pd.Series:
        if not cache:
            cache.append(encoder_factory())
        texts = [x if isinstance(x, str) else "" for x in column]
        counts = counted(texts, cache[0].encode_batch)
        return pd.Series([None if not isinstance(x, str) else n for x, n in zip(column, counts, strict=True)], dtype="Int64")

    return run(c)


def hosted_count(c: Column, client_factory, tries: int = 3, wait: float = 0.5) -> Column:
    """struct<tokens, available, error> of a text by a hosted counter, whose client ``client_factory()`` makes once in each worker.

    The client has ``count(text) -> int``. What fails is tried again, after twice the wait each time;
    then tokens are null and the error says why, and never is anything estimated. A factory that
    gives None, as where no key is set, leaves every count unavailable.
    """
    cache: list = []

    def one(x):
        if x is None:
            return None, False, "no text"
        if cache[0] is None:
            return None, False, "no client"
        error = ""
        for k in range(tries):
            try:
                return int(cache[0].count(x)), True, None
            except Exception as e:  # a failure is a value here, never a stop
                error = f"{type(e).__name__}: {e}"[:200]
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return None, False, error

    @F.pandas_udf("tokens long, available boolean, error string")
    def run(column: pd.Series) -> pd.DataFrame:
        if not cache:
            cache.append(client_factory())
        rows = pd.DataFrame([one(x) for x in column], columns=["tokens", "available", "error"])
        return rows.astype({"tokens": "Int64"})

    return run(c)
