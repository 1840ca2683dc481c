"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming radius by BK-trees.

Two fingerprints within radius r agree on all of some choice of (blocks - r) blocks of bits, so each choice
deals the distinct fingerprints into shards, and links lie inside shards. Every shard is one BK-tree, built where the
shard's fingerprints meet. (The trees aren't broadcast: an index of all fingerprints has no bound, and in bounded batches every
fingerprint would search every batch's tree.) A shard
gives a spanning forest of its links, not all pairs. A shard of more than MAX_TREE fingerprints is not searched as
a tree: there, fingerprints meet at the neighbours they share, at most 65 at each, which finds the same links in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from platen.llm.common import connected_components, cut, table

SHINGLE, RADIUS, SEED = 3, 2, 42
MAX_TREE = 1024
#: Distinct fingerprints expected in a shard at most when blocks are chosen.
SHARD_ROWS = 64


def shingles(text: str | None, size: int = SHINGLE) -> list[memoryview]:
    """Shingles of `size` words of the lower-cased text (A-Z only), joined by one space; all of it if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: \x20 and \x09-\x0D split, nothing else
    if not words:
        return []
    joined = memoryview(b" ".join(words))
    if len(words) <= size:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    return [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """A bit is 1 if over half of the shingles' XXH64 values have it; 0 for a text without words."""
    hashes = [xxh64_intdigest(s, SEED) for s in shingles(text, size)]
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, radius: int) -> list[int]:
        """Adds value; numbers of the nodes within radius of it, found by following edges within the radius."""
        found, todo, own = [], [0] if self.value else [], len(self.value)
        while todo:
            k = todo.pop()
            d = (value ^ self.value[k]).bit_count()
            if d <= radius:
                found.append(k)
            todo += [c for e, c in self.children[k].items() if d - radius <= e <= d + radius]
        k = 0
        while own and (d := (value ^ self.value[k]).bit_count()) in self.children[k]:
            k = self.children[k][d]
        if own:
            self.children[k][d] = own
        self.value.append(value)
        self.children.append({})
        return found


def shard_links(fps: list[int], ids: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within radius between fps, as pairs of ids."""
    tree, root, links = BKTree(), list(range(len(fps))), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, fp in enumerate(fps):
        for m in tree.add(fp & (2**64 - 1), radius):
            if (a := find(k)) != (b := find(m)):
                root[a] = b
                links.append((ids[k], ids[m]))
    return links


def tree_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches of (shard, fp, low), sorted by shard; a shard may go on in the next batch."""
    shard, fps, ids = None, [], []
    for b in batches:
        out = []
        for s, fp, low in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if s != shard:
                if len(fps) > 1:
                    out += shard_links(fps, ids, radius)
                shard, fps, ids = s, [], []
            fps.append(fp)
            ids.append(low)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
    if len(fps) > 1 and (out := shard_links(fps, ids, radius)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def masks(blocks: int, radius: int) -> list[int]:
    """For each choice of blocks - radius blocks of 64 bits, the bits in them (as signed numbers)."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(block, blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks with which n evenly spread fingerprints give shards of about SHARD_ROWS."""
    blocks = radius + 1
    while n >> (64 * (blocks - radius) // blocks) > SHARD_ROWS and blocks < radius + 6:
        blocks += 1
    return blocks


def links(fps: DataFrame, radius: int = RADIUS, max_tree: int = MAX_TREE, blocks: int | None = None) -> DataFrame:
    """(a, b): links between the ids `low` of distinct fingerprints `fp` that connect all within radius (2 at most)."""
    if not 0 <= radius <= 2:
        raise ValueError("shared neighbours find a radius of 0 to 2")
    keyed = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks(blocks or blocks_for(fps.count(), radius), radius))]
    dealt = fps.select(F.explode(F.array(*keyed)).alias("shard"), "fp", "low")
    sized = cut(dealt.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = cut(dealt.join(sized, "shard"))
    small = dealt.where(F.col("n") <= max_tree).select("shard", "fp", "low").repartition("shard").sortWithinPartitions("shard", "fp", "low")
    by_tree = small.mapInArrow(lambda batches: tree_links(batches, radius), "a long, b long")
    large = dealt.where(F.col("n") > max_tree).select("fp", "low").distinct()
    meet: list[Column] = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << k).astype(np.int64)))) for k in range(64)]
    met = large.select(F.explode(F.array(*meet)).alias("at"), "low")
    first = met.groupBy("at").agg(F.min("low").alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = met.join(first, "at").where("low != a").select("a", F.col("low").alias("b")).distinct()
    if radius == 2:
        return by_tree.union(shared)
    both = fps.select(F.col("low").alias("a"), F.col("fp").alias("x"))
    exact = shared.join(both, "a").join(both.toDF("b", "y"), "b").where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)
    return by_tree.union(exact.select("a", "b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, max_tree: int = MAX_TREE) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable, itself included).

    A null text is an empty one: fingerprint zero, linked like any other. A row without an id links nothing and
    has no component. Rows that repeat an id are nodes of that one id. An empty table gives
    an empty result. Other columns are not read. radius is 2 at most: large shards find no more by shared neighbours.
    """
    rows = cut(fingerprints(docs, id_col, text_col, size))
    fps = cut(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = links(fps, radius, max_tree)
    # An id on several rows has several fingerprints; they are one node.
    twice = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x != y").select("doc_id")
    tied = rows.join(twice, "doc_id").join(fps, "fp").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    roots = connected_components(found.union(tied))
    named = fps.join(roots, fps.low == roots.node, "left").select("fp", F.coalesce("root", "low").alias("component"))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(named, "fp", "left").select("doc_id", text.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
