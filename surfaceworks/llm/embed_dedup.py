"""Embedding near-dedup: sorted projection passes.

Each pass orders the vectors lexicographically by a concatenation of random hyperplane hashes and
compares every vector with the ``WINDOW`` that follow it: in single precision, and in double
precision what lies within the rounding error of the threshold. A pass is dealt by ranges of
(key, id), so a common key is split like any other; where a range ends, its last vectors are
compared with the first of the next. The links of a task are reduced to those that connect, so a
pass gives few links for each vector. The union over all passes makes components, within which the
links of every vector are then counted exactly, block by block, without listing pairs.

What a pass finds of a pair at the threshold falls as vectors get denser, so the number of passes
follows the table. As many are made as find ``RECALL`` of the pairs at the threshold among evenly
spread vectors; then a pilot, at most ``PILOT`` vectors compared with all, tells which share of their
links the components hold, and passes go on until that is ``RECALL``, whatever the vectors are like.
As many again then square the part that is missing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Stash, components

THRESHOLD = 0.9
WINDOW, BITS = 512, 62
PASSES_AT_ONCE, LEAST_PASSES = 4, 4
RECALL = 0.99
#: Vectors of the pilot, at most, and links of one of them that a task reports, at most.
PILOT, PILOT_LINKS = 1024, 64
#: Vectors in a block of a large component; small components share blocks of about as many.
BLOCK, LEAST_SHARES = 8192, 6
#: Rows that are multiplied at once, and pairs that are decided again at once.
ROWS, PAIRS = 256, 1 << 16

_LINK = "a long, b long, edge long, head boolean, id long, v binary"


def _unit(blobs: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors, one in each row, of binaries of the same length."""
    raw = np.frombuffer(b"".join(blobs.to_pylist()), kind).astype(np.float64).reshape(len(blobs), -1)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _near(x: np.ndarray, y: np.ndarray, y32: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of the unit vectors of x with those of y is the threshold or more."""
    slack = (x.shape[1] + 8) * 2.0**-23  # twice what a single-precision product of unit vectors can be off
    products = x.astype(np.float32) @ y32.T
    near = products >= threshold + slack
    r, c = np.nonzero((products >= threshold - slack) & ~near)
    for at in range(0, len(r), PAIRS):
        i, j = r[at : at + PAIRS], c[at : at + PAIRS]
        near[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return near


def _same_length(batch: pa.RecordBatch, column: int):
    """The rows of a batch by the length of their vectors."""
    lengths = pc.binary_length(batch.column(column)).to_numpy()
    for n in np.unique(lengths):
        yield int(n), batch if (lengths == n).all() else batch.filter(pa.array(lengths == n))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, h1, h2, v): each row with 128 bits of hash of its vector, which are null if it can't link."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0.0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, F.xxhash64(v)).alias("h1"), F.when(fine, F.xxhash64(F.lit(1), v)).alias("h2"), F.col(vector_col).alias("v"))


def passes_for(n: int, window: int, recall: float, threshold: float = THRESHOLD) -> int:
    """Passes that find so much of the pairs at the threshold among n evenly spread vectors.

    A pair shares the next bit of a key with probability 1 - angle / pi, others with 1/2; a window
    holds those that share log2(n / window) bits.
    """
    bits = max(0.0, math.log2(max(n, 1) / window))
    found = min(1.0 - 1e-9, (1 - math.acos(threshold) / math.pi) ** bits)
    return max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def _blobs(nodes: DataFrame, kind: str) -> DataFrame:
    """(id, h1, h2, n_same, v) with the vector as bytes."""

    def run(batches):
        for batch in batches:
            lists = batch.column(4)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            blobs = [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blobs, pa.binary())], ["id", "h1", "h2", "n_same", "v"])

    return nodes.select("id", "h1", "h2", "n_same", "v").mapInArrow(run, "id long, h1 long, h2 long, n_same long, v binary")


def _keys(nodes: DataFrame, kind: str, first: int, n: int) -> DataFrame:
    """(pass, key, id, v) for n passes from ``first`` on; vectors of another length are another pass."""

    def run(batches):
        weights = np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1, dtype=np.int64))
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for size, rows in _same_length(batch, 1):
                unit = _unit(rows.column(1), kind)
                for p in range(first, first + n):
                    if (p, size) not in planes:
                        planes[p, size] = np.random.default_rng((11, p)).normal(size=(unit.shape[1], BITS))
                    keys = (unit @ planes[p, size] >= 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), (p << 32) + size)), pa.array(keys), rows.column(0), rows.column(1)], ["pass", "key", "id", "v"])

    return nodes.select("id", "v").mapInArrow(run, "pass long, key long, id long, v binary")


def _connecting(r: np.ndarray, c: np.ndarray, label: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links (r, c) in order of r, those that connect what has different labels; labels within reach of r follow."""
    i, j = [], []
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(r)) + 1, [len(r)])) if len(r) else [0]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        own = label[r[s]]
        others = c[s:e][label[c[s:e]] != own]
        if len(others):
            joined, one = np.unique(label[others], return_index=True)
            i.append(np.full(len(one), r[s]))
            j.append(others[one])
            span = label[r[s] : r[s] + reach]
            span[np.isin(span, joined)] = own
    whole = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    return whole(i), whole(j)


class _Sweep:
    """Compares rows of one pass, as they come, with the window behind them; keeps the links that connect."""

    def __init__(self, kind: str, threshold: float, window: int):
        self.kind, self.threshold, self.window = kind, threshold, window
        self.ids, self.unit, self.label, self.next = np.zeros(0, np.int64), None, np.zeros(0, np.int64), 0

    def add(self, ids: pa.Array, blobs: pa.Array):
        unit = _unit(blobs, self.kind)
        self.ids = np.concatenate((self.ids, ids.to_numpy()))
        self.unit = unit if self.unit is None else np.concatenate((self.unit, unit))
        self.label = np.concatenate((self.label, np.arange(self.next, self.next + len(unit))))
        self.next += len(unit)
        return self.links(max(0, len(self.ids) - self.window))

    def links(self, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Links of the first rows, which then go."""
        upto = len(self.ids) if upto is None else upto
        a, b, w, label = [], [], self.window, self.label
        y32 = self.unit.astype(np.float32) if upto else None
        for at in range(0, upto, ROWS):
            rows = min(ROWS, upto - at)
            near = _near(self.unit[at : at + rows], self.unit[at : at + rows + w], y32[at : at + rows + w], self.threshold)
            r, c = np.nonzero(near)
            within = (c > r) & (c <= r + w)
            r, c = r[within] + at, c[within] + at
            # rows before can't be linked again, rows behind the window have no other label yet
            i, j = _connecting(r, c, label, w + 1)
            a.append(self.ids[i])
            b.append(self.ids[j])
        self.ids, self.unit, self.label = self.ids[upto:], self.unit[upto:], self.label[upto:]
        whole = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return whole(a), whole(b)


def _windows(sorted_keys: DataFrame, kind: str, threshold: float, window: int) -> DataFrame:
    """Links (a, b) that connect, of what each task's rows show within the window; and, with ``edge``, the vectors (id, v) at its ends."""

    def record(a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["a", "b", "edge", "head", "id", "v"])

    def ends(edge, head, ids, blobs):
        n, none = len(ids), pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(np.full(n, edge)), pa.array(np.full(n, head)), ids, blobs], ["a", "b", "edge", "head", "id", "v"])

    def run(batches):
        part, now, sweep, missing, tail = TaskContext.get().partitionId(), None, None, window, []
        for batch in batches:
            passes = batch.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(passes)) + 1, [len(passes)]))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if e <= s:
                    continue
                rows = batch.slice(s, e - s)
                if now != passes[s]:
                    if sweep is not None:
                        yield record(*sweep.links())
                        missing = 0
                    now, sweep, tail = passes[s], _Sweep(kind, threshold, window), []
                if missing and part:
                    head = rows.slice(0, missing)
                    yield ends(part - 1, True, head.column(2), head.column(3))
                    missing -= len(head)
                tail = [x for x in (*tail, rows.slice(max(0, len(rows) - window))) if len(x)]
                while sum(map(len, tail[1:])) >= window:
                    tail.pop(0)
                a, b = sweep.add(rows.column(2), rows.column(3))
                if len(a):
                    yield record(a, b)
        if sweep is not None:
            yield record(*sweep.links())
            for x in tail:
                yield ends(part, False, x.column(2), x.column(3))

    return sorted_keys.select("pass", "key", "id", "v").mapInArrow(run, _LINK)


def _edge(table: pa.Table, kind: str, threshold: float) -> pa.Table:
    """Links between the last vectors of a task and the first of the next."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in table.select(["id", "v", "head"]).combine_chunks().to_batches():
        for _, rows in _same_length(batch, 1):
            head = rows.column(2).to_numpy(zero_copy_only=False)
            ids, unit = rows.column(0).to_numpy(), _unit(rows.column(1), kind)
            r, c = np.nonzero(_near(unit[~head], unit[head], unit[head].astype(np.float32), threshold))
            both = np.concatenate((ids[~head], ids[head]))
            i, j = _connecting(r, c + (~head).sum(), np.arange(len(both)), len(both))
            a.append(both[i])
            b.append(both[j])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _pilot_links(nodes: DataFrame, chosen: list, kind: str, threshold: float) -> DataFrame:
    """(a, b): of each of the chosen (id, v) links with other nodes, at most ``PILOT_LINKS`` of a task's."""
    by_size: dict[int, tuple] = {}
    for size in {len(r.v) for r in chosen}:
        own = [r for r in chosen if len(r.v) == size]
        unit = _unit(pa.array([bytes(r.v) for r in own], pa.binary()), kind)
        by_size[size] = np.array([r.id for r in own], np.int64), unit, unit.astype(np.float32)

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for size, rows in _same_length(batch, 1):
                if size not in by_size:
                    continue
                of, y, y32 = by_size[size]
                ids, unit = rows.column(0).to_numpy(), _unit(rows.column(1), kind)
                for at in range(0, len(ids), ROWS):
                    r, c = np.nonzero(_near(unit[at : at + ROWS], y, y32, threshold))
                    pairs = [(q, i) for q, i in zip(of[c].tolist(), ids[at : at + ROWS][r].tolist(), strict=True) if q != i]
                    out = []
                    for q, i in pairs:
                        seen[q] = seen.get(q, 0) + 1
                        if seen[q] <= PILOT_LINKS:
                            out.append((q, i))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return nodes.select("id", "v").mapInArrow(run, "a long, b long")


def _count(table: pa.Table, kind: str, threshold: float) -> pa.Table:
    """(id, n): links of the vectors of side L (or B: both) with those of side R (or B) of the same component."""
    out_ids, out_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    table = table.combine_chunks().sort_by("component")
    component = table.column("component").to_numpy()
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(component)) + 1, [len(component)]))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        for batch in table.slice(s, e - s).combine_chunks().to_batches():
            for _, rows in _same_length(batch, batch.schema.get_field_index("v")):
                side = rows.column("side").to_numpy(zero_copy_only=False)
                left, right = side != "R", side != "L"
                ids, same = rows.column("id").to_numpy(), rows.column("n_same").to_numpy()
                unit = _unit(rows.column("v"), kind)
                y, y32 = unit[right], unit[right].astype(np.float32)
                x, own, other, weights = unit[left], ids[left], ids[right], same[right]
                for at in range(0, len(x), ROWS):
                    near = _near(x[at : at + ROWS], y, y32, threshold) & (own[at : at + ROWS, None] != other[None, :])
                    out_n.append(near @ weights)
                out_ids.append(own)
    return pa.table({"id": np.concatenate(out_ids), "n": np.concatenate(out_n).astype(np.int64)})


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. Runs jobs.

    Vectors link when their cosine is ``threshold`` or more; component_id is the smallest id
    reachable by the links that the passes find, kept whether that is the own id, and n_links counts
    all links within the component. Vectors that are null, zero, or hold a null or a non-finite
    component link with nothing; those of different lengths don't link with each other. Equal vectors
    (by 128 bits of hash) are one node from the start and count as linked with each other. Rows that
    share an id count as separate vectors of one node. A row with a null id links with nothing and
    keeps a null component_id. Other columns are not read.
    """
    spark = vectors.sparkSession
    stash = Stash(spark, "embed-dedup")
    rows = usable(vectors, id_col, vector_col)
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    same = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n_same"), F.first("v").alias("v"))
    nodes = stash.put(_blobs(same, kind), "uncompressed")
    n = nodes.count()
    chosen = nodes.orderBy(F.xxhash64("id", "h1")).limit(PILOT).select("id", "v").collect()
    pilot = stash.put(_pilot_links(nodes, chosen, kind, threshold).distinct())
    wanted, done, held, links, found = passes_for(n, window, recall, threshold), 0, False, None, None
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * PASSES_AT_ONCE // 100_000)
    while n:
        now = min(PASSES_AT_ONCE, wanted - done)
        dealt = _keys(nodes, kind, done, now).repartitionByRange(parts, "pass", "key", "id").sortWithinPartitions("pass", "key", "id")
        seen = stash.put(_windows(dealt, kind, threshold, window), "uncompressed")
        across = seen.where("edge is not null").groupBy("edge").applyInArrow(lambda t: _edge(t, kind, threshold), "a long, b long")
        some = seen.where("edge is null").select("a", "b").unionByName(across)
        done += now
        if done < wanted:
            links = stash.put((some if links is None else links.unionByName(some)).distinct())
            stash.drop(seen)
            continue
        found = stash.put(components(spark, some if links is None else links.unionByName(some), stash))
        stash.drop(seen)
        if held:
            break
        end = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: E731, B023
        ends = pilot.join(end("a"), "a", "left").join(end("b"), "b", "left")
        together, of = ends.agg(F.count_if(F.col("of_a") == F.col("of_b")), F.count("*")).first()
        held = together >= recall * of
        wanted = 2 * done if held else done + PASSES_AT_ONCE
        # a component's links to its smallest id are all that later passes need of those before
        links = found.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    if found is None:
        found = spark.createDataFrame([], "id long, component long")

    members = stash.put(nodes.join(found, "id").select("component", "id", "n_same", "v"), "uncompressed")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    placed = members.join(sizes, "component").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    shares = max(LEAST_SHARES, members.count() // BLOCK)
    alone = F.array(F.struct(F.pmod(F.xxhash64("component"), F.lit(shares)).alias("i"), F.lit(-1).cast("long").alias("j"), F.lit("B").alias("side")))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pieces = F.concat(
        F.transform(others, lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit("L").alias("side"))),
        F.transform(others, lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit("R").alias("side"))),
    )
    dealt = placed.select("component", "id", "v", "n_same", F.when(F.col("blocks") > 1, F.col("component")).alias("big"), F.explode(F.when(F.col("blocks") == 1, alone).otherwise(pieces)).alias("e")).select("*", "e.*").drop("e")
    counted = dealt.groupBy("big", "i", "j").applyInArrow(lambda t: _count(t, kind, threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    known = nodes.select("id", "h1", "h2", "n_same").join(counted, "id", "left").join(found, "id", "left")
    known = known.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("n_same") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    slim = rows.select("vec_id", "h1", "h2")
    linked = slim.where("h1 is not null").join(known, ["h1", "h2"]).select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), (F.col("c") == F.col("vec_id")).alias("kept"))
    rest = slim.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.unionByName(rest)
