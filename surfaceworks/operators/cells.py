"""All pairs of a server's sets: blocks of them meet in cells, one task each, and only what is similar leaves a cell.

A set is an array of distinct 64-bit hashes. Its bitmap has a length by its size, a power of two; pairs that can reach the
threshold are of the same length or of neighbouring ones, and a longer bitmap is folded to the shorter. A bit that
only one of two sets has stands for a word that only this set has, which bounds the words that both have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A block holds so many sets, or in large servers up to the second number, so that a set goes to few cells.
ROWS, MOST_ROWS, BLOCKS = 8192, 32768, 8
#: The exponent of the shortest bitmap.
LEAST_LEVEL = 8
#: Sets that are compared with one other at a time.
CHUNK = 512


def level_of(n: int) -> int:
    """The exponent of the length of a bitmap: at least twice as many bits as words."""
    return max(LEAST_LEVEL, int(2 * n - 1).bit_length())


def with_bitmaps(sets: DataFrame) -> DataFrame:
    """(server, tool, name, n, print, bits, set) of rows (server, tool, name, set of words); rows without server, tool or words go."""
    return mapped(sets.where(USABLE).select("server", "tool", "name", hashes(F.col("set")).alias("set")))


#: Rows whose set can be compared.
USABLE = "server is not null and tool is not null and n > 0"


def hashes(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def mapped(rows: DataFrame) -> DataFrame:
    """Rows, whose last column is a set of hashes, with n, print, bits and the set in its place.

    set holds the sorted hashes as bytes, print 128 bits of their hash.
    """
    kept = len(rows.columns) - 1
    schema = T.StructType([*rows.schema.fields[:kept], *(T.StructField(*x) for x in (("n", T.LongType()), ("print", T.BinaryType()), ("bits", T.BinaryType()), ("set", T.BinaryType())))])

    def run(batches):
        for batch in batches:
            lists = batch.column(kept)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            of = [np.unique(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            raw = [x.tobytes() for x in of]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array([len(x) for x in of], pa.int64()), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array([bitmap(x) for x in of], pa.binary()), pa.array(raw, pa.binary())], schema.names
            )

    return rows.mapInArrow(run, schema)


def bitmap(words: np.ndarray) -> bytes:
    bits = np.zeros(1 << level_of(len(words)), bool)
    bits[(words & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def of_pairs(rows: DataFrame, key: Column) -> DataFrame:
    """Rows in each cell (server, i, j) in which a row of their server can meet them; own is their block. A row for each large server is broadcast."""
    n = F.col("rows")
    blocks = F.ceil(F.least(n / ROWS, F.greatest(n / MOST_ROWS, F.lit(BLOCKS)))).cast("int")
    large = rows.groupBy("server").agg(F.count("*").alias("rows")).where(n > ROWS).select("server", blocks.alias("blocks"))
    dealt = rows.join(F.broadcast(large), "server", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


class _Side:
    """Rows of one block by size: bitmaps by level, words in rows and sets in columns, as they are and folded once."""

    def __init__(self, table: pa.Table, rows: np.ndarray):
        n = table.column("n").to_numpy()[rows]
        order = np.argsort(n, kind="stable")
        self.rows, self.n = rows[order], n[order]
        self.levels = np.array([level_of(x) for x in self.n.tolist()], np.int64)
        self.skipped = np.zeros(len(rows), bool)
        self.starts, self.maps = {}, {}
        bits = table.column("bits").take(pa.array(self.rows)).to_pylist()
        for level in np.unique(self.levels).tolist():
            a, b = np.searchsorted(self.levels, (level, level + 1)).tolist()
            whole = np.frombuffer(b"".join(bits[a:b]), np.uint64).reshape(b - a, -1)
            self.starts[level] = a, b
            self._keep(level, level, whole)
            if level > LEAST_LEVEL:
                half = whole.shape[1] // 2
                self._keep(level, level - 1, whole[:, :half] | whole[:, half:])

    def _keep(self, level: int, at: int, maps: np.ndarray) -> None:
        a, b = self.starts[level]
        self.maps[level, at] = np.ascontiguousarray(maps.T), self.n[a:b] - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)

    def reach(self, other: _Side, k: int, first: int, least: float) -> np.ndarray:
        """Places in this side, from ``first`` on or skipped before, of what the set k of the other can be similar to by size and bits."""
        n, level = int(other.n[k]), int(other.levels[k])
        low, high = np.searchsorted(self.n, (least * n * (1 - 1e-9), n / least * (1 + 1e-9) + 1e-9), "left")
        high = max(high, np.searchsorted(self.n, n / least * (1 + 1e-9), "right"))
        before = low + np.flatnonzero(self.skipped[low : max(low, min(first, high))])
        found = []
        for with_level in (level - 1, level, level + 1):
            if with_level not in self.starts:
                continue
            a, b = self.starts[with_level]
            at = min(level, with_level)
            mine, spare = other.maps[level, at]
            own, own_spare = mine[:, k - other.starts[level][0]], spare[k - other.starts[level][0]]
            maps, spares = self.maps[with_level, at]
            old = before[(before >= a) & (before < b)]
            for places in (old, slice(max(a, low, first), min(b, high))):
                some = old - a if places is old else slice(places.start - a, places.stop - a)
                if (len(old) if places is old else places.stop - places.start) <= 0:
                    continue
                both = np.bitwise_count(maps[:, some] & own[:, None]).sum(axis=0, dtype=np.int64)
                most = np.minimum(own_spare, spares[some]) + both
                ok = most * (1 + least) * (1 + 1e-9) >= least * (n + self.n[places])
                found.append(old[ok] if places is old else places.start + np.flatnonzero(ok))
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _visits(table: pa.Table):
    """(side, k, other side, first place there that comes later) of every row of a cell, by size; rows that repeat a print come once."""
    prints = table.column("print").combine_chunks().dictionary_encode().indices.to_numpy()
    once = np.sort(np.unique(prints, return_index=True)[1])
    own = table.column("own").to_numpy()[once]
    if table.column("i")[0] == table.column("j")[0]:
        side = _Side(table, once)
        for k in range(len(side.n)):
            yield side, k, side, k + 1
        return
    one, two = (_Side(table, once[own == table.column(c)[0].as_py()]) for c in "ij")
    n, which = np.concatenate((one.n, two.n)), np.repeat([0, 1], (len(one.n), len(two.n)))
    place = np.concatenate((np.arange(len(one.n)), np.arange(len(two.n))))
    for x in np.lexsort((which, n)).tolist():
        side, other = (two, one) if which[x] else (one, two)
        yield side, int(place[x]), other, int(np.searchsorted(other.n, n[x], "right" if which[x] else "left"))


def _in_common(sets: list[np.ndarray], mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many words a set has in common with each of others."""
    out = []
    for a in range(0, len(others), CHUNK):
        them = [sets[r] for r in others[a : a + CHUNK].tolist()]
        flat = np.concatenate(them)
        hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        out.append(np.add.reduceat(hit, np.cumsum([0, *map(len, them[:-1])]), dtype=np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]


def _some(table: pa.Table, least: float, holds) -> np.ndarray:
    """Rows of a cell that are in a pair that can be similar and of which ``holds(row, rows)`` is true.

    A row that a pair has shown already isn't compared again with all, only with those that no pair has shown.
    """
    shown = np.zeros(table.num_rows, bool)
    for side, k, other, first in _visits(table):
        row = side.rows[k]
        if shown[row]:
            side.skipped[k] = True
            continue
        rows = other.rows[other.reach(side, k, first, least)]
        rows = rows[holds(row, rows)] if len(rows) else rows
        shown[rows] = True
        shown[row] = len(rows) > 0
    return np.flatnonzero(shown)


def _group(rows: DataFrame, f, schema: T.StructType) -> DataFrame:
    return rows.groupBy("server", "i", "j").applyInArrow(f, schema)


def _fields(rows: DataFrame, *names: str) -> list[T.StructField]:
    return [rows.schema[c] for c in names]


def marked(rows: DataFrame, least: float) -> DataFrame:
    """(server, i, j, own, print) of the rows (server, i, j, own, print, n, bits) that can be similar to another in their cell."""
    names = ["server", "i", "j", "own", "print"]

    def run(table: pa.Table) -> pa.Table:
        return table.select(names).take(pa.array(_some(table, least, lambda row, rows: np.ones(len(rows), bool))))

    return _group(rows, run, T.StructType(_fields(rows, *names)))


def linked(rows: DataFrame, least: float) -> DataFrame:
    """(server, print) of the rows (server, i, j, own, print, lo, hi, n, bits, set) that are similar to another in their cell, not counting one of the same single tool."""

    def run(table: pa.Table) -> pa.Table:
        sets = _sets(table)
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        lo, hi = (np.array(table.column(c).to_pylist(), object) for c in ("lo", "hi"))

        def holds(row: int, others: np.ndarray) -> np.ndarray:
            both = _in_common(sets, sets[row], others)
            return (both / (n[row] + n[others] - both) >= least) & ((lo[row] != hi[others]) | (hi[row] != lo[others]))

        return table.select(["server", "print"]).take(pa.array(_some(table, least, holds)))

    return _group(rows, run, T.StructType(_fields(rows, "server", "print")))


def links(rows: DataFrame, least: float) -> DataFrame:
    """(server, a, b, na, nb, both): similar pairs of the rows of each cell, by their prints."""
    (server, print_), long = _fields(rows, "server", "print"), T.LongType()
    schema = T.StructType([server, *(T.StructField(c, print_.dataType) for c in "ab"), *(T.StructField(c, long) for c in ("na", "nb", "both"))])

    def run(table: pa.Table) -> pa.Table:
        sets, found = _sets(table), []
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        for side, k, other, first in _visits(table):
            row, rows = side.rows[k], other.rows[other.reach(side, k, first, least)]
            both = _in_common(sets, sets[row], rows)
            ok = both / (n[row] + n[rows] - both) >= least
            if ok.any():
                found.append((np.full(ok.sum(), row), rows[ok], both[ok]))
        a, b, both = (np.concatenate([f[x] for f in found] or [np.zeros(0, np.int64)]) for x in range(3))
        of = lambda c, x: table.column(c).take(pa.array(x)).combine_chunks()
        return pa.table([of("server", a), of("print", a), of("print", b), pa.array(n[a]), pa.array(n[b]), pa.array(both)], schema.names)

    return _group(rows, run, schema)
