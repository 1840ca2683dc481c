"""Near copies by five-word shingles: texts whose sets of shingles are 0.8 alike or more (Jaccard) are linked.

Distinct sets are dealt into shards by pairs of min-hashes (BANDS pairs, so that two sets 0.8 alike miss each other with
probability 0.36 ** 10, or 4 in 100,000). In a shard a BK-tree of SimHash fingerprints, and the min-hashes of both, name
candidates. These only save work: a link counts when the exact sets, made again from the texts, are 0.8 alike.

A shard of more than MAX_SHARD sets is either a large group of near copies or texts that share a passage. It is first searched in overlapping runs of
neighbours in the order of their min-hashes, each with the shard's first set in it, by the sets of which it is the largest shard; a group of
thousands is linked there once. What is then outside a large shard's largest component meets the shard's other sets at its rarest
shingles: two sets that are 0.8 alike share one among the rarest fifth of each, whatever the order of rarity, so no pair is
missed, while a passage that many texts share is among the commonest of each and brings nothing together.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from platen.llm.common import MAX_BROADCAST, broadcast_if_small, connected_components, cut, fresh, slices, without_rows
from platen.llm.simhash_dedup import SEED, BKTree, shingles

SHINGLE, LIKENESS = 5, 0.8
BANDS = 10
HASHES = 4 * BANDS  # the first two for each band; all of them tell how alike two sets are
#: Sets 0.8 alike differ in 9.7 of 64 bits on average, with a deviation of 2.9; fewer than SMALL shingles say too little.
RADIUS, SMALL = 24, 64
#: Equal min-hashes of two sets that may be alike; of 40, sets 0.8 alike have fewer once in 100,000.
LEAST_EQUAL = HASHES // 2
MAX_SHARD = 256
#: Shingles of a shard, run or piece, past which it is split even if it has few sets.
MAX_SHINGLES = 1_000_000
#: Shingles whose counts order the others, those with the highest ones; the list is broadcast.
MOST_FREQUENT = 1 << 19
#: Sets that meet at one shingle in one task; where there are more, each part of the guests meets each part of the others.
MEETING = 512
#: Shingles of a group whose shares are counted at once.
COLUMNS = 1024
_OWN = ["shard", "key", "fp", "n", "mins", "root"]
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' XXH64 values, sorted."""
    own = shingles(text, size)
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in own), np.uint64, len(own)))


def sketch(own: np.ndarray) -> tuple[int, int, bytes]:
    """(hash of the set, SimHash fingerprint, HASHES min-hashes of 32 bits)."""
    key = int(np.uint64(xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64))
    if not len(own):
        return key, 0, bytes(4 * HASHES)
    bits, least = np.zeros(64, np.int64), np.full(HASHES, 2**64 - 1, np.uint64)
    for k in range(0, len(own), 1024):
        part = own[k : k + 1024]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (part[None, :] * _FACTORS[:, None]).min(axis=1))
    fp = int(np.packbits(2 * bits > len(own), bitorder="little").view("<i8")[0])
    return key, fp, (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype("<u4").tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, key, fp, n, mins) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t) for t in b.column(2).to_pylist()]
            made = list(zip(*(sketch(s) for s in sets), strict=True)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.binary())
            key, fp, mins = (pa.array(c, t) for c, t in zip(made, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), key, fp, pa.array(map(len, sets), pa.int32()), mins], ["doc_id", "text_hash", "key", "fp", "n", "mins"])

    read = docs.select(F.col(id_col).cast("long"), text_hash(text_col), F.col(text_col).cast("string"))
    return read.mapInArrow(run, "doc_id long, text_hash long, key long, fp long, n int, mins binary")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(set, set) -> number of shingles that both have. Shingles of one set alone are left out, the others are counted COLUMNS at a time."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    use = (np.bincount(at, minlength=len(values)) > 1)[at]
    at, owner = np.unique(at[use], return_inverse=True)[1], owner[use]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, [low, low + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[a:b], at[a:b] - low] = 1
        counts += held @ held.T
    return counts


class Forest:
    """Union-find over 0, 1, ..."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[a] = b
        return a != b


def candidates(keys: list[int], fps: list[int], sizes: list[int], mins: list[bytes], roots: list[int]) -> list[tuple[int, int]]:
    """(group, key) of the sets of one shard that may be linked, directly or through others. Sets of one root are linked already."""
    tree, forest, sketched = BKTree(), Forest(len(keys)), np.frombuffer(b"".join(mins), "<u4").reshape(-1, HASHES)
    for k, fp in enumerate(fps):
        near = tree.add(fp & (2**64 - 1), RADIUS if sizes[k] >= SMALL else 64)
        if near:
            equal = (sketched[near] == sketched[k]).sum(axis=1)
            for m in np.array(near)[equal >= LEAST_EQUAL].tolist():
                if roots[k] != roots[m]:
                    forest.join(k, m)
    return named_groups(keys, forest)


def named_groups(keys: list[int], forest: Forest) -> list[tuple[int, int]]:
    """(group, key) of the trees of more than one key; equal groups have equal names."""
    groups: dict[int, list[int]] = {}
    for k in range(len(keys)):
        groups.setdefault(forest.find(k), []).append(keys[k])
    out = []
    for members in groups.values():
        members = sorted(set(members))
        if len(members) > 1:
            group = int(np.uint64(xxh64_intdigest(np.array(members, "<i8").tobytes(), SEED)).astype(np.int64))
            out += [(group, m) for m in members]
    return out


def _pairs(out: list[tuple[int, int]], names: list[str]) -> Iterator[pa.RecordBatch]:
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)


def shard_groups(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of (shard, key, fp, n, mins, root), sorted by shard, to (group, key). most: shards are searched in runs of so many, each
    with half of the one before and with the shard's first set, which five more columns give."""
    shard, rows, fresh, held, first = None, [], 0, 0, []

    def search() -> list[tuple[int, int]]:
        return candidates(*map(list, zip(*(first + rows), strict=True))) if fresh and len(first + rows) > 1 else []

    for b in batches:
        out = []
        for s, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if s != shard:
                out += search()
                shard, rows, fresh, held, first = s, [], 0, 0, [tuple(row[5:])] if most else []
            elif most and (len(rows) >= most or held > MAX_SHINGLES):
                out += search()
                rows, fresh = rows[len(rows) // 2 :] if len(rows) > 2 else [], 0
                held = sum(r[2] for r in rows)
            rows.append(tuple(row[:5]))
            fresh, held = fresh + 1, held + row[2]
        yield from _pairs(out, ["grp", "key"])
    yield from _pairs(search(), ["grp", "key"])


def rarest(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], likeness: float) -> np.ndarray:
    """The shingles of a set, rarest first, that are enough to share one with every set `likeness` alike. frequent: shingles, sorted, with their counts; others count as rarer, equals go by hash."""
    values, counts = frequent
    at = np.minimum(np.searchsorted(values, own), max(0, len(values) - 1))
    seen = np.where(values[at] == own, counts[at], 0) if len(values) else np.zeros(len(own), np.int64)
    return own[np.lexsort((own, seen))][: len(own) - ceil(likeness * len(own) - 1e-9) + 1]


def met_groups(batches: Iterator[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """Batches of (meeting, key, n, place, root, asks, host, fp, mins), sorted by meeting, to (group, key): what may be linked, directly or through others, among guests and hosts of different
    roots, by their sizes, the places of the shingle in both, fingerprints and min-hashes. A meeting gives no more rows than it has."""
    meeting, rows = None, []

    def groups() -> list[tuple[int, int]]:
        if len(rows) < 2 or not any(r[4] for r in rows):
            return []
        keys, n, place, root, asks, host, fps = (np.array(c) for c in list(zip(*rows, strict=True))[:7])
        sketched, forest = np.frombuffer(b"".join(r[7] for r in rows), "<u4").reshape(-1, HASHES), Forest(len(rows))
        for k in np.flatnonzero(asks).tolist():
            # At the first shingle that two share, this one and the shorter rest after it are all they can share.
            most = np.minimum(n[k] - place[k], n - place)
            good = host & (root != root[k]) & (n >= likeness * n[k] - 1e-9) & (n[k] >= likeness * n - 1e-9) & (most * (1 + likeness) >= likeness * (n + n[k]) - 1e-9)
            near = np.flatnonzero(good & ((np.bitwise_count((fps ^ fps[k]).view(np.uint64)) <= RADIUS) | (n < SMALL) | (n[k] < SMALL)))
            for m in near[(sketched[near] == sketched[k]).sum(axis=1) >= LEAST_EQUAL].tolist():
                forest.join(k, m)
        return named_groups(keys.tolist(), forest)

    for b in batches:
        out: list[tuple[int, int]] = []
        for m, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if m != meeting:
                out += groups()
                meeting, rows = m, []
            rows.append(row)
        yield from _pairs(out, ["grp", "key"])
    yield from _pairs(groups(), ["grp", "key"])


def verified(batches: Iterator[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """Batches of (group, key, set, root), sorted by group, to a spanning forest (a, b) of the exact links in each group between sets of different roots."""
    group, keys, sets, roots = None, [], [], []

    def links() -> list[tuple[int, int]]:
        forest, out, one = Forest(len(keys)), [], {}
        for k, r in enumerate(roots):
            forest.join(k, one.setdefault(r, k))
        if len(one) > 1:
            n, both = np.array([len(x) for x in sets], float), shared_counts(sets)
            for k in range(1, len(sets)):
                for m in np.flatnonzero(both[k, :k] >= likeness * (n[k] + n[:k] - both[k, :k].astype(float))).tolist():
                    if forest.join(k, m):
                        out.append((keys[k], keys[m]))
        return out

    for b in slices(batches):
        out = []
        for g, key, raw, root in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if g != group:
                out += links()
                group, keys, sets, roots = g, [], [], []
            keys.append(key)
            sets.append(np.frombuffer(raw, "<u8"))
            roots.append(root)
        yield from _pairs(out, ["a", "b"])
    yield from _pairs(links(), ["a", "b"])


def _dealt(rows: DataFrame, max_shard: int) -> DataFrame:
    """rows once for each band, with the shard's number of rows and whether it is large; rows alone in a shard go."""
    band = [F.xxhash64(F.lit(k), F.substring("mins", 8 * k + 1, 8)) for k in range(BANDS)]
    dealt = rows.select(F.explode(F.array(*band)).alias("shard"), "key", "fp", "n", "mins")
    large = (F.col("rows") > max_shard) | (F.col("held") > MAX_SHINGLES)
    sized = cut(dealt.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("n").alias("held")).where("rows > 1").select("shard", "rows", large.alias("large")))
    return cut(dealt.join(broadcast_if_small(sized, MAX_BROADCAST // 4), "shard"))


def near_links(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, likeness: float = LIKENESS, max_shard: int = MAX_SHARD, meeting: int = MEETING) -> DataFrame:
    """(a, b): links between keys of rows that connect all sets `likeness` alike. rows: sketches of docs."""
    # One row speaks for each set; mins, fp and n follow from the key.
    sets = cut(rows.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash", "fp", "n", "mins")).alias("x")).select("key", "x.*"))
    alone = sets.select("key", F.col("key").alias("root"))
    dealt = _dealt(sets, max_shard)
    small, large = dealt.where("not large"), dealt.where("large")
    exact = lambda found, roots: _exact_links(docs, sets, found, roots, id_col, text_col, likeness)
    if large.isEmpty():
        return exact(_in_shards(small.withColumn("root", F.col("key"))), alone)
    # Each set is searched in the largest of its shards first: a group of thousands is linked there once, not in every shard it fills.
    homes = large.groupBy("key").agg(F.max(F.struct("rows", "shard")).alias("x")).select("key", F.col("x.shard").alias("shard"))
    links = exact(_in_runs(cut(large.join(homes, ["shard", "key"]).withColumn("root", F.col("key"))), max_shard), alone)
    roots = _roots(sets, links)
    found = _in_shards(small.join(roots, "key")).union(_met(docs, sets, _outside_core(large, roots), id_col, text_col, likeness, meeting))
    return fresh(links.union(exact(found, roots)).distinct())


def _in_shards(rows: DataFrame) -> DataFrame:
    """(group, key) of shards that are searched whole."""
    return rows.select(_OWN).repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(shard_groups, "grp long, key long")


def _in_runs(rows: DataFrame, max_shard: int) -> DataFrame:
    """(group, key) of shards that are searched in runs of neighbours. rows is checkpointed."""
    first = cut(rows.groupBy("shard").agg(F.min(F.struct(*_OWN[1:])).alias("x")).select("shard", *(F.col(f"x.{c}").alias(f"first_{c}") for c in _OWN[1:])))
    runs = rows.select(_OWN).join(first, "shard").repartitionByRange("shard", "mins", "key").sortWithinPartitions("shard", "mins", "key")
    return runs.mapInArrow(lambda batches: shard_groups(batches, max_shard), "grp long, key long")


def _roots(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(key, root) of all sets."""
    linked = connected_components(links).withColumnRenamed("node", "key")
    return fresh(sets.select("key").join(linked, "key", "left").select("key", F.coalesce("root", "key").alias("root")))


def _outside_core(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, root, guest): the sets of large shards that are not one component, and whether a set is outside the largest component of one of them."""
    rooted = cut(rows.join(roots, "key"))
    parts = rooted.groupBy("shard", "root").agg(F.count("*").alias("n"))
    cores = parts.groupBy("shard").agg(F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("all")).where("all > x.n").select("shard", F.col("x.root").alias("core"))
    return cut(rooted.join(cut(cores), "shard").groupBy("key").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("core")).alias("guest")))


def _met(docs: DataFrame, sets: DataFrame, open_: DataFrame, id_col: str, text_col: str, likeness: float, meeting: int) -> DataFrame:
    """(group, key): open sets, a guest among them, that share one of their rarest shingles and may be alike. Rarity is counted over all open sets."""
    spark = docs.sparkSession
    texts = _texts_of(docs, open_.join(sets.select("key", "doc_id", "text_hash"), "key"), id_col, text_col).select("text", "key", "root", "guest")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            own = [shingle_set(t) for t in b.column(0).to_pylist()]
            shingle, n = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n, pa.int64())], ["shingle", "n"])

    counts = cut(texts.mapInArrow(every, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1"))
    sizes = sorted(((r["size"], r["count"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("size")).count().collect()), reverse=True)
    least, held = 2**64, 0
    for size, count in sizes:
        held += count
        if held > MOST_FREQUENT:
            break
        least = 2**size
    listed = counts.where(F.col("n") >= F.lit(least).cast("decimal(38,0)")).toArrow()
    values = listed["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(values)
    frequent = spark.sparkContext.broadcast((values[order], listed["n"].to_numpy()[order]))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            own = [shingle_set(t) for t in b.column(0).to_pylist()]
            few = [rarest(s, frequent.value, likeness) for s in own]
            each = [len(f) for f in few]
            at = np.repeat(np.arange(len(few)), each)
            place = np.concatenate([np.arange(n) for n in each]) if each else []
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(few).view(np.int64) if few else [], pa.int64()), b.column(1).take(pa.array(at)), pa.array(np.repeat([len(s) for s in own], each), pa.int32()), pa.array(place, pa.int32()), b.column(2).take(pa.array(at)), b.column(3).take(pa.array(at))], ["shingle", "key", "n", "place", "root", "guest"])

    tokens = cut(texts.mapInArrow(rare, "shingle long, key long, n int, place int, root long, guest boolean"))
    parts = lambda c: F.ceil(F.col(c) / meeting).cast("int")
    shared = cut(tokens.groupBy("shingle").agg(F.count("*").alias("all"), F.sum(F.col("guest").cast("long")).alias("guests")).where("`all` > 1 AND guests > 0").select("shingle", parts("all").alias("chunks"), parts("guests").alias("pieces")))
    met = tokens.join(broadcast_if_small(shared), "shingle").join(sets.select("key", "fp", "mins"), "key")
    own = lambda c, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(c)).cast("int")
    span = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # A guest is asked in each chunk, a host answers in each piece; a set that is both stands in its own place twice over.
    asked = F.transform(span("chunks"), lambda c: F.struct(own("pieces", 1).alias("piece"), c.alias("chunk"), F.lit(True).alias("asks"), (c == own("chunks", 2)).alias("host")))
    answers = F.transform(span("pieces"), lambda p: F.struct(p.alias("piece"), own("chunks", 2).alias("chunk"), F.lit(False).alias("asks"), F.lit(True).alias("host")))
    answers = F.filter(answers, lambda x: ~F.col("guest") | (x["piece"] != own("pieces", 1)))
    spread = met.select("shingle", "key", "n", "place", "root", "fp", "mins", F.inline(F.when(F.col("guest"), F.concat(asked, answers)).otherwise(answers)))
    spread = spread.select(F.xxhash64("shingle", "piece", "chunk").alias("meeting"), "key", "n", "place", "root", "asks", "host", "fp", "mins")
    return spread.repartition("meeting").sortWithinPartitions("meeting", "key").mapInArrow(lambda batches: met_groups(batches, likeness), "grp long, key long")


def _texts_of(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """asked (doc_id, text_hash, more columns), with the text of each; a repeated row gives its text as often."""
    named = broadcast_if_small(cut(asked.withColumnsRenamed({"doc_id": "asked_id", "text_hash": "asked_text"})), MAX_BROADCAST // 4)
    texts = docs.select(F.col(id_col).cast("long").alias("own_id"), text_hash(text_col).alias("own_text"), F.col(text_col).cast("string").alias("text"))
    return texts.join(named, F.col("own_id").eqNullSafe(F.col("asked_id")) & (F.col("own_text") == F.col("asked_text")))


def _exact_links(docs: DataFrame, sets: DataFrame, found: DataFrame, roots: DataFrame, id_col: str, text_col: str, likeness: float) -> DataFrame:
    """(a, b): the links in the groups found that hold between the exact sets and join different roots."""
    groups = cut(found.distinct())
    asked = groups.select("key").distinct().join(sets, "key").join(roots, "key").select("key", "root", "doc_id", "text_hash")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t).tobytes() for t in b.column(1).to_pylist()], pa.binary()), b.column(2)], ["key", "own", "root"])

    # A repeated row would give its set twice.
    held = _texts_of(docs, asked, id_col, text_col).groupBy("key").agg(F.first("text").alias("text"), F.first("root").alias("root"))
    full = groups.join(held.mapInArrow(exact, "key long, own binary, root long"), "key").select("grp", "key", "own", "root").repartition("grp").sortWithinPartitions("grp", "key")
    return cut(full.mapInArrow(lambda batches: verified(batches, likeness), "a long, b long"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS, max_shard: int = MAX_SHARD, meeting: int = MEETING) -> DataFrame:
    """The rows of docs that stay: of each group of near copies one with the smallest id, with all its columns.

    A null text is an empty one. Rows without an id are linked like others, and one stays only where
    no row of its group has an id. Of a repeated row one stays. An empty table gives an empty result.
    """
    rows = cut(sketches(docs, id_col, text_col))
    roots = connected_components(near_links(docs, rows, id_col, text_col, likeness, max_shard, meeting))
    placed = rows.select("doc_id", "text_hash", "key").join(roots, rows.key == roots.node, "left").select("doc_id", "text_hash", F.coalesce("root", "key").alias("root"))
    placed = cut(placed)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    stays = cut(placed.groupBy("root").agg(F.min(row).alias("x"), F.count("*").alias("n")).where("n > 1"))
    marked = placed.join(stays, "root").select("doc_id", F.col("text_hash").alias("mark"), (~row.eqNullSafe(F.col("x"))).alias("gone"))
    return without_rows(docs, marked, id_col, text_hash(text_col))
