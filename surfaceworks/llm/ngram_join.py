"""N-gram Jaccard join: which documents share a given part of their word shingles.

First, sets that can't have a partner go. A shingle that no other set holds is a difference, so a
set of n shingles with more than n(1 - t) of them is similar to nothing at a threshold of t. Part of
the space of shingle hashes is enough to see that in most sets; 32-bit prints of it are dealt to
buckets by hash, in which those of one set alone are counted. A print that stands for several
shingles only keeps a set that could have gone.

Size-banded tiles for the rest. Two sets of n and m shingles whose Jaccard similarity is at least t
differ in at most d = (n + m)(1 - t)/(1 + t) shingles. Sizes fall into bands; a band deals every set
into more than d parts by a hash of the shingle, so of a similar pair at least one part is equal, and
the hash of a part's content is the key of a tile that holds both (Arasu et al., 2006). A set is dealt
in its own band and in each above it in which a partner can be. No similar pair is missed. An empty
part says nothing: a band has more parts by as many as are likely to be empty, and a set with more
empty ones than that is dealt again with another seed, as is a partner like it.

Within tiles, bitmaps of the hashed shingles bound the overlap from above: a bit that only one set
has stands for a shingle that only this set has. Pairs that pass are compared exactly, as sorted
arrays. Equal sets are one node from the start. Each set is compared with one other first, the hub of a tile that it
shares most tiles with, and the links found make components (``ROUNDS`` more can compare sets outside a
tile's largest component with one of it); only pairs of a tile in different components follow. A tile's hub
is the member that meets most others over all its tiles: of near copies of one text that is one with few changes
of its own, which links with most of them, while any other, the first by id say, may link with few. So
a group of near copies costs a few comparisons for each member and not one for each pair. A pair that
shares many tiles, as texts with a passage in common do, meets in one of them: each set knows its
largest tiles, in one order for all, and a pair that has some of those in common is made in the first. A tile
that still holds many components, as parts from a passage that many texts share do, is dealt again
by parts of its band under another seed: a similar pair in it has an equal part there too.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Stash, bound_batches, chunked_words, components, only, slices

BITS = 1024
SEEDS = 4
#: A tile with more rows than this outside its largest component is dealt again, if that leaves fewer pairs.
CROWDED = 512
#: It is dealt again so often at most, and no more once that leaves more than this part of the pairs.
REDEALS, WORTH = 4, 0.7
#: So often sets outside a tile's largest component are compared with one of it before all that is left is.
ROUNDS = 0
#: Of its largest tiles, so many go with each set, so that a pair meets in one of those that it shares and not in each.
LARGEST = 8
#: The largest size in a band, in times the smallest.
BAND = 1.5
#: The bits of a tile's key that hold its band.
BAND_BITS = 63
#: Bytes of text whose prints a bucket holds, about.
BUCKET_BYTES = 32 << 20
#: Documents that pass through a bucket, about.
BUCKET_ROWS = 1 << 19
LEAST_BUCKETS = 12
#: The share of the space of hashes that is looked at, in times the part of its shingles that a set may hold alone.
SHARE = 2.5
#: Words of 64 bits in the map of hashed ids that texts are first filtered by; so many rows are broadcast at most.
MAP_WORDS = 1 << 18

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _K[0]
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int, lower: bool) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; a text of fewer words is one shingle."""
    # lower-cased before any cast: pyarrow's ascii_lower misreads a slice that was cast to large_string
    distinct, index, bounds = chunked_words(pc.ascii_lower(pc.fill_null(texts, "")) if lower else texts)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    empty = distinct.index("") if "" in distinct else -1
    keep = index != empty
    bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
    h = hashed[index[keep]]
    n = max(0, len(h) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled = mix(rolled ^ h[k : k + n])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = mix(one ^ x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_EDGES: list[int] = [1]


def _edges(upto: int) -> list[int]:
    """Smallest sizes of the bands, as far as the third beyond ``upto``."""
    while len(_EDGES) < 3 or _EDGES[-3] <= upto:
        _EDGES.append(max(_EDGES[-1] + 1, int(_EDGES[-1] * BAND)))
    return _EDGES


@functools.cache
def plan_of(band: int, num: int, den: int) -> tuple[int, int]:
    """(most differences d, parts) of a band: d + 1 parts, and as many more as may be empty in its smallest sets."""
    low, high = _EDGES[band], _EDGES[band + 1] - 1
    most = 2 * high * (den - num) // (den + num)
    parts = most + 1
    for _ in range(8):
        empty = parts * math.exp(-low * num / den / parts)
        parts = most + 1 + math.ceil(empty + 2 * math.sqrt(empty))
    return most, parts


def bands(n: int, num: int, den: int) -> list[int]:
    """Bands in which a set of n meets its partners: its own, and all above it that a partner can be in."""
    edges = _edges(n * den // num + 1)
    b = int(np.searchsorted(edges, n, "right")) - 1
    out = [b]
    while n * den >= num * edges[out[-1] + 1]:
        out.append(out[-1] + 1)
    return out


def tile_keys(shingles: np.ndarray, num: int, den: int, seeds: tuple[int, ...] = tuple(range(SEEDS))) -> np.ndarray:
    """Keys of the tiles that a set belongs to, the band in the last bits; none if only an equal set can be similar.

    Of k parts at least k - d are equal in a similar pair. If a set has fewer empty parts than that,
    one of the equal ones isn't empty; otherwise it, and a partner as sparse, is dealt again.
    """
    out = []
    for band in bands(len(shingles), num, den):
        most, parts = plan_of(band, num, den)
        if not most:
            continue
        for seed in seeds:
            salt = np.uint64((band * 64 + seed + 1) * 0x2545F4914F6CDD1D & (2**64 - 1))
            dealt = mix(shingles ^ salt)
            part = (dealt % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            content = np.add.reduceat(mix(dealt[order] ^ _K[3]), first)
            full = part[first]
            sparse = parts - len(full) >= parts - most
            if sparse and seed == seeds[-1]:  # empty parts are tiles only with the last seed
                sums = np.zeros(parts, np.uint64)
                sums[full] = content
                full, content = np.arange(parts), sums
            out.append(mix(mix(content ^ salt) ^ full.astype(np.uint64)) & ~np.uint64(BAND_BITS) | np.uint64(band & BAND_BITS))
            if not sparse:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(BITS, bool)
    bits[(shingles >> np.uint64(54)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of 64-bit values between consecutive bounds, modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _homes(f1: np.ndarray, ids: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each document: by fingerprint and id, and by place among the rows equal in both."""
    mixed = mix(f1 ^ mix(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
    order = np.argsort(mixed, kind="stable")
    ordered = mixed[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    place = np.empty(len(mixed), np.uint64)
    place[order] = np.arange(len(mixed), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(mixed)))).astype(np.uint64)
    return ((mixed + place) % np.uint64(buckets)).astype(np.int64)


def _prints(docs: DataFrame, words: int, lower: bool, buckets: int, of: int) -> DataFrame:
    """For each slice of docs (id, text) and each of ``buckets`` a row of prints and of documents.

    Of the space of hashes, cut into ``of`` parts, the first ``buckets`` are kept. prints holds the
    distinct prints of the bucket, those of one set together: of the set f[i] come count[i]; those of
    several sets of the slice have f = 0. Documents (ids, n, f1, f2), where f1 is the lower half of their
    set's fingerprint, only pass through a bucket: equal ones of a slice go to one after the other. What a
    row's bucket is depends on the content of its slice alone.
    """

    def run(batches):
        only("ngram join")
        for batch in batches:
            for first, rows in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(first, rows), words, lower)
                ids = batch.column(0).slice(first, rows)
                sizes = np.fromiter(map(len, sets), np.int64, rows)
                bounds, h = np.concatenate(([0], np.cumsum(sizes))), np.concatenate(sets)
                f1, f2 = np.maximum(_sums(mix(h), bounds), np.uint64(1)), _sums(mix(h ^ _K[1]), bounds)
                part = (h >> np.uint64(32)) % np.uint64(of)
                kept = (part < buckets) & np.repeat(ids.is_valid().to_numpy(zero_copy_only=False), sizes)
                key = part[kept] << np.uint64(32) | h[kept] & np.uint64(0xFFFFFFFF)
                order = np.argsort(key, kind="stable")
                key, f = key[order], np.repeat(f1, sizes)[kept][order]
                starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                key, low, high = key[starts], *((x.reduceat(f, starts) for x in (np.minimum, np.maximum)) if len(key) else (f, f))
                f = np.where(low == high, low, np.uint64(0))
                order = np.lexsort((f, key >> np.uint64(32)))
                key, f = key[order], f[order]
                part, prints = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
                runs = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (f[1:] != f[:-1])))) if len(key) else starts
                counts, of_run, run_part = np.diff(np.append(runs, len(key))).astype(np.uint32), f[runs], part[runs]
                home = _homes(f1, ids, buckets)
                by_home = np.argsort(home, kind="stable")
                out = {k: [] for k in ("bucket", "f", "count", "prints", "ids", "n", "f1", "f2")}
                for b in np.union1d(run_part, home).tolist():
                    r, p, d = (slice(*np.searchsorted(x, (b, b + 1))) for x in (run_part, part, home[by_home]))
                    d = by_home[d]
                    own = b, of_run[r].tobytes(), counts[r].tobytes(), prints[p].tobytes(), ids.take(pa.array(d)).to_pylist(), sizes[d], f1[d].view(np.int64), f2[d].view(np.int64)
                    for x, column in zip(own, out.values(), strict=True):
                        column.append(x)
                kinds = pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out.values(), kinds, strict=True)], list(out))

    return docs.mapInArrow(run, "bucket long, f binary, count binary, prints binary, ids array<long>, n array<long>, f1 array<long>, f2 array<long>")


def _alone(bucket: pa.Table) -> pa.Table:
    """Of a bucket, its documents (id, n, f1, f2) and for each set f1 how many prints it alone holds (alone)."""
    blob = lambda name, kind: np.frombuffer(b"".join(bucket.column(name).to_pylist()), kind)
    prints, f = blob("prints", np.uint32), np.repeat(blob("f", np.uint64), blob("count", np.uint32))
    if len(prints):
        order = np.argsort(prints, kind="stable")
        prints, f = prints[order], f[order]
        starts = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
        low, high = np.minimum.reduceat(f, starts), np.maximum.reduceat(f, starts)
        f = low[(low == high) & (low != 0)]
    sets, alone = np.unique(f, return_counts=True)
    docs = [pa.concat_arrays([x.flatten() for x in bucket.column(c).chunks] or [pa.array([], pa.int64())]) for c in ("ids", "n", "f1", "f2")]
    none = lambda n: pa.nulls(n, pa.int64())
    columns = [docs[0], none(len(sets))], [docs[1], none(len(sets))], [docs[2], pa.array(sets.view(np.int64))], [docs[3], none(len(sets))], [none(len(docs[0])), pa.array(alone.astype(np.int64))]
    return pa.table([pa.concat_arrays(x) for x in columns], ["id", "n", "f1", "f2", "alone"])


def _signatures(docs: DataFrame, words: int, num: int, den: int, lower: bool) -> DataFrame:
    """(id, n, ones, b0..b15, keys, shingles) for each row of docs (id, text); shingles is the sorted set as bytes, ones the number of bits."""
    maps = ", ".join(f"b{i} long" for i in range(BITS // 64))

    def run(batches):
        only("ngram join")
        for batch in batches:
            for first, n in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(first, n), words, lower)
                sizes = np.fromiter(map(len, sets), np.int64, n)
                bits = np.frombuffer(b"".join(map(bitmap, sets)), np.int64).reshape(n, BITS // 64)
                keys = [tile_keys(s, num, den) for s in sets]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(sizes), pa.array(np.bitwise_count(bits.view(np.uint64)).sum(axis=1, dtype=np.int64)), *(pa.array(bits[:, i]) for i in range(BITS // 64)), lists, pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["id", "n", "ones", *(f"b{i}" for i in range(BITS // 64)), "keys", "shingles"],
                )

    return docs.mapInArrow(run, f"id long, n long, ones long, {maps}, keys array<long>, shingles binary")


def _exact(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, sa, sb) that link."""

    def run(batches):
        only("ngram join")
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _tiles(rows: DataFrame) -> DataFrame:
    """(key, members, most, main): the rows of each tile, those of its largest component, and which that is."""
    kinds = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    return kinds.groupBy("key").agg(F.sum("n").alias("members"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"))


def _hubs(shared: DataFrame) -> DataFrame:
    """(id, hub) for each row of shared (key, id, members), but hubs themselves; a hub is the member of its tile that is in the most and largest tiles.

    A tile counts as the digits of its number of rows in base two, so a passage that very many hold doesn't decide it.
    """
    crowd = shared.groupBy("id").agg(F.sum(F.length(F.bin("members"))).alias("crowd"))
    hub = shared.join(crowd, "id").groupBy("key").agg(F.max_by("id", F.struct("crowd", -F.col("id"))).alias("hub"))
    return shared.join(hub, "key").where("id <> hub").select("id", "hub")


def _largest(left: DataFrame, tiles: DataFrame) -> DataFrame:
    """(id, tops): the ``LARGEST`` largest tiles of each set in left (key, id), the largest first; tiles are (key, members)."""
    place = F.struct((-F.col("members")).alias("less"), "key")
    listed = left.join(tiles, "key").groupBy("id").agg(F.collect_list(place).alias("all"))
    return listed.select("id", F.slice(F.array_sort("all"), 1, LARGEST)["key"].alias("tops"))


def _redealt(sets: DataFrame, num: int, den: int, seed: int) -> DataFrame:
    """(id, keys) of sets (id, shingles) under another seed."""

    def run(batches):
        only("ngram join")
        for batch in batches:
            keys = [tile_keys(np.frombuffer(s.as_buffer(), np.uint64), num, den, (seed,)).view(np.int64) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["id", "keys"])

    return sets.mapInArrow(run, "id long, keys array<long>")


def _dealt_again(dense: DataFrame, again: DataFrame) -> DataFrame:
    """(key, id, component): dense (key, id, component) dealt on by the parts of each tile's band in again (id, keys).

    Both sets of a pair have at most the band's largest size, so its parts alone find the pair if it is similar. The
    new keys hold the band too.
    """
    band = F.col("key").bitwiseAND(BAND_BITS)
    parts = F.explode(F.filter("keys", lambda k: k.bitwiseAND(BAND_BITS) == band)).alias("part")
    key = F.xxhash64("key", "part").bitwiseAND(~BAND_BITS).bitwiseOR(band).alias("key")
    return dense.join(again, "id").select("key", "id", "component", parts).select(key, "id", "component")


def _several(rows: DataFrame) -> DataFrame:
    """(key): tiles of rows (key, component) that hold several components."""
    return rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")


def _can_link(num: int, den: int):
    """Whether a pair with signatures a_* and b_* can reach the threshold, by sizes and bits.

    A set has at least as many shingles alone as bits; one count for each word keeps the method that
    Spark makes of this small enough to be compiled.
    """
    both = F.bit_count(F.col("a_b0").bitwiseAND(F.col("b_b0")))
    for i in range(1, BITS // 64):
        both = both + F.bit_count(F.col(f"a_b{i}").bitwiseAND(F.col(f"b_b{i}")))
    most = F.least(F.col("a_n") - F.col("a_ones"), F.col("b_n") - F.col("b_ones")) + both
    return (F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num) & (most * (den + num) >= (F.col("a_n") + F.col("b_n")) * num)


def _pairs(left: DataFrame, tiles: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): sets of a tile in different components that can link, by left (key, id, component), tiles (key, members, main) and maps.

    Every such pair has one side outside the tile's largest component. One that has some of both sets' largest tiles
    in common comes from the first of these alone.
    """
    bits = ["ones", *(f"b{i}" for i in range(BITS // 64))]
    own = "id", "n", *bits, "tops"
    rows = left.join(tiles.select("key", "main"), "key").join(maps.join(_largest(left, tiles), "id"), "id")
    one = rows.where("component <> main").select("key", "main", F.col("component").alias("ca"), *[F.col(c).alias("a" if c == "id" else f"a_{c}") for c in own])
    two = rows.select("key", F.col("component").alias("cb"), *[F.col(c).alias("b" if c == "id" else f"b_{c}") for c in own])
    once = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
    here = F.coalesce(F.get(F.array_intersect("a_tops", "b_tops"), F.lit(0)), one["key"]) == one["key"]
    return one.join(two, (one["key"] == two["key"]) & once & _can_link(num, den) & here).select("a", "b")


def _marked(rows: DataFrame, key, ids: DataFrame) -> DataFrame:
    """(r, id, bit): rows as structs, their key, and 0 where that is certainly not in ids (id). A map of hashed ids, of bounded size, is broadcast."""
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r"), key.cast("long").alias("id"))
    place = F.xxhash64("id")
    word, bit = F.pmod(F.shiftrightunsigned(place, 6), F.lit(MAP_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    held = ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("held"))
    return packed.withColumn("at", word).join(F.broadcast(held), F.col("at") == F.col("word"), "left").select("r", "id", F.coalesce(F.col("held").bitwiseAND(bit), F.lit(0)).alias("bit"))


def of_ids(rows: DataFrame, key, ids: DataFrame) -> DataFrame:
    """The rows whose key is in ids (id, distinct). Few others are shuffled for that."""
    return _marked(rows, key, ids).where("bit <> 0").join(ids, "id", "left_semi").select("r.*")


def not_of_ids(rows: DataFrame, key, ids: DataFrame) -> DataFrame:
    """The rows whose key is null or not in ids (id, distinct). Few of them are shuffled for that."""
    marked = _marked(rows, key, ids)
    return marked.where("bit = 0").select("r.*").unionByName(marked.where("bit <> 0").join(ids, "id", "left_anti").select("r.*"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each group of similar texts stays. Runs jobs.

    Groups are the components of ``join``; the row with the smallest id stays, a null id being the
    last, of equal ids that with the smaller hash. Rows are told apart by id and text, so texts that
    share an id are separate documents; rows that repeat both are one, of which that with the
    smallest other columns stays. Texts without words are similar to none.
    """
    stash = Stash(docs.sparkSession, "one-of-each")
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    found = stash.put(join(docs.select(row.alias("id"), F.col(text_col).alias("text")), "id", "text", words, num, den).select(F.col("doc_id").alias("id"), "component_id"))
    seen = stash.put(found.groupBy("id", "component_id").agg(F.count("*").alias("times")))
    groups = seen.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    members = seen.join(groups, "component_id").select("id", "component_id")
    named = of_ids(docs.select(row.alias("row"), F.col(id_col).cast("long").alias("own")), F.col("row"), stash.put(members.select("id"))).distinct()
    first = F.struct(F.col("own").isNull().alias("last"), "own", "row").alias("first")
    placed = stash.put(members.join(named, members["id"] == named["row"]).select("component_id", "row", first))
    best = placed.groupBy("component_id").agg(F.min("first").alias("best"))
    others = stash.put(placed.join(best, "component_id").where("row <> best.row").select(F.col("row").alias("id")).distinct())
    kept = not_of_ids(docs, row, others)
    again = stash.put(seen.where("times > 1").select("id").join(others, "id", "left_anti"))
    if not again.limit(1).count():
        return kept
    # rows that repeat id and text: the smallest stays
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    own = [F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("rest")] if rest else []
    alike = of_ids(docs, row, again).groupBy(F.col(id_col).alias("id"), F.col(text_col).alias("text")).agg(F.count("*").alias("n"), *own)
    once = alike.select(*[F.col("id" if c == id_col else "text" if c == text_col else f"rest.`{c}`").alias(c) for c in docs.columns])
    return not_of_ids(kept, row, again).unionByName(once)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 90, den: int = 100, lower: bool = True, crowded: int = CROWDED) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id. Runs jobs.

    Two rows link when den * |intersection| >= num * |union| of their sets; component_id is the
    smallest id reachable by links, itself included. A null text or one without words has an empty
    set and links with nothing. Rows that share an id are one node, which has the links of all their
    texts. A row with a null id keeps a null component_id. An empty table gives an empty one. Other
    columns are not read. Sets count as equal if 128 bits of their hash and their sizes are.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    stash = Stash(spark, "ngram-join")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size, n = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES), -(-n // BUCKET_ROWS))
    of = max(buckets, int(buckets * den / (den - num) / SHARE)) if num < den else buckets
    seen = stash.put(_prints(texts, words, lower, buckets, of).groupBy("bucket").applyInArrow(_alone, "id long, n long, f1 long, f2 long, alone long"))
    rows = seen.where("n is not null").select("id", "n", "f1", "f2")
    named = rows.where("id is not null and n > 0")
    same = stash.put(named.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    copies = named.join(same.where("copies > 1"), ["n", "f1", "f2"]).where("id <> rep").select("id", "rep")
    copies = stash.put(copies)

    # one row for each different set that can have a partner
    alone = seen.where("n is null").groupBy("f1").agg(F.sum("alone").alias("alone"))
    open_sets = same.join(alone, "f1", "left").where((F.col("n") - F.coalesce("alone", F.lit(0))) * den >= F.col("n") * num)
    ids = stash.put(open_sets.select(F.col("rep").alias("id")).distinct())
    repeated = stash.put(named.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id"))
    wanted = of_ids(texts, F.col("id"), ids)
    if repeated.limit(1).count():  # rows that repeat id and text; only they are shuffled for that
        wanted = not_of_ids(wanted, F.col("id"), repeated).unionByName(of_ids(wanted, F.col("id"), repeated).dropDuplicates(["id", "text"]))
    nodes = stash.put(_signatures(wanted, words, num, den, lower).where("size(keys) > 0"))

    # tiles of one set are of no use
    dealt = nodes.select(F.explode("keys").alias("key"), "id")
    tiles = dealt.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("key", "members")
    shared = stash.put(dealt.join(tiles, "key").distinct())
    bits = ["ones", *(f"b{i}" for i in range(BITS // 64))]
    maps, sets = nodes.select("id", "n", *bits), nodes.select("id", "shingles")

    def side(name: str, of: DataFrame) -> DataFrame:
        return of.select(*[F.col(c).alias(name if c == "id" else f"{name}_{c}") for c in of.columns])

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that link, stashed."""
        full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        return stash.put(_exact(full.select("a", "b", "sa", "sb"), num, den))

    # of the hubs of its tiles, each set is compared with the one that it shares most tiles with
    def closest(pairs: DataFrame) -> DataFrame:
        """Of (id, hub), once for each tile, (a, b): each id b with its most frequent hub a, of equals the smallest."""
        counted = pairs.groupBy("id", "hub").agg(F.count("*").alias("n"))
        return counted.groupBy("id").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b"))

    def that_can(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a", maps), "a").join(side("b", maps), "b").where(_can_link(num, den)).select("a", "b").distinct()

    hubs = stash.put(closest(_hubs(shared)))
    links = linked(that_can(hubs))

    # what is left: pairs of a tile that those links don't connect
    def opened(tiled: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(components so far, (key, id, component) of the tiles that hold several)."""
        so_far = stash.put(components(spark, links, stash))
        of_tile = tiled.select("key", "id").join(so_far, "id", "left").select("key", "id", F.coalesce(F.col("component"), F.col("id")).alias("component"))
        return so_far, stash.put(of_tile.join(_several(of_tile), "key", "left_semi"))

    so_far, left = opened(shared)
    stash.drop(shared)
    for _ in range(ROUNDS):
        # sets outside a tile's largest component meet one of it, again the one that they share most tiles with
        mains = left.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("id").alias("first")).groupBy("key").agg(F.max_by(F.struct("component", "first"), F.struct("n", "component")).alias("main"))
        outside = left.join(mains, "key").where("component <> main.component").select("id", F.col("main.first").alias("hub"))
        next_hubs = stash.put(closest(outside.join(hubs.select(F.col("b").alias("id"), F.col("a").alias("hub")), ["id", "hub"], "left_anti")))
        more = linked(that_can(next_hubs))
        if not more.limit(1).count():
            break
        links = stash.put(so_far.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more))
        hubs = hubs.unionByName(next_hubs)
        so_far, left = opened(left)
    cost = F.col("members") * (F.col("members") - F.col("most"))
    for seed in range(SEEDS, SEEDS + REDEALS):
        crowd = stash.put(_tiles(left).where(F.col("members") - F.col("most") > crowded))
        pairs_now = crowd.agg(F.sum(cost)).first()[0]
        if not pairs_now:
            break
        dense = left.join(crowd.select("key"), "key", "left_semi")
        again = stash.put(_redealt(sets.join(dense.select("id").distinct(), "id", "left_semi"), num, den, seed))
        dense = _dealt_again(dense, again)
        dense = stash.put(dense.join(_several(dense), "key", "left_semi").distinct())
        if (_tiles(dense).agg(F.sum(cost)).first()[0] or 0) >= pairs_now * WORTH:
            break
        left = stash.put(left.join(crowd.select("key"), "key", "left_anti").unionByName(dense))
    more = _pairs(left, stash.put(_tiles(left).select("key", "members", "main")), maps, num, den).distinct()
    links = links.unionByName(linked(more)).unionByName(copies.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    found = stash.put(components(spark, links, stash))
    out = rows.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))
