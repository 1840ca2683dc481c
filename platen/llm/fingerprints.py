"""Document fingerprints: SimHash over weighted terms, and a Hamming search in permuted block tables."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from platen.llm.common import cut, table

BITS, SEED = 64, 0
#: A text of fewer words than this is described by its three-character strings as well.
FEW_WORDS = 8
#: Slices of the ids by which documents and their successors are brought together, for each shuffle partition.
SLICES = 4


def terms(text: str) -> Counter[str]:
    """Pairs of neighbouring words in lower case; of a short text also its words and three-character strings."""
    words = text.lower().split()
    found = Counter(map(" ".join, zip(words, words[1:], strict=False)))
    if len(words) < FEW_WORDS:
        found.update(words)
        found.update(text[k : k + 3] for k in range(max(1, len(text) - 2)) if text)
    return found


def simhash(text: str) -> int:
    """Each term's hash votes with 1 + ln(its count) on every bit, for if the bit is set and against otherwise; a tie is 0."""
    found = terms(text)
    if not found:
        return 0
    hashes = np.fromiter((xxh64_intdigest(t.encode("utf-8", "surrogatepass"), SEED) for t in found), "<u8", len(found))
    weights = 1 + np.log(np.fromiter(found.values(), np.float32, len(found)))
    votes = weights @ np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    return int(np.packbits(2 * votes > weights.sum(), bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many first characters of the following text, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def dealt(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text, slice, guest): slices of the ids' range, in which a document stands before
    the next in descending order of ids. The largest id of a slice is a guest in the slice above it, where it follows the smallest.

    Only ids are read to find the slices; their number, which follows the shuffle partitions, bounds what the driver holds.
    """
    spark = docs.sparkSession
    slices = SLICES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    cuts = np.unique(np.array(ids.agg(F.percentile_approx("doc_id", [k / slices for k in range(1, slices)], 10 * slices)).first()[0] or [], np.int64))

    def tops_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, int] = {}
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(cuts, own)
            for k in np.unique(at).tolist():
                tops[k] = max(tops.get(k, -(2**63)), int(own[at == k].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(tops), pa.int32()), pa.array(list(tops.values()), pa.int64())], ["slice", "top"])

    tops = sorted(ids.mapInArrow(tops_of, "slice int, top long").groupBy("slice").agg(F.max("top")).collect())
    host = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            visits = [(k, host[i]) for k, i in enumerate(own.tolist()) if i in host]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(cuts, own).astype(np.int32)), pa.array(np.zeros(len(own), bool))], ["doc_id", "text", "slice", "guest"])
            if visits:
                rows = b.take(pa.array([k for k, _ in visits], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([s for _, s in visits], pa.int32()), pa.array([True] * len(visits))], ["doc_id", "text", "slice", "guest"])

    return docs.mapInArrow(deal, "doc_id long, text string, slice int, guest boolean")


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of dealt() -> fingerprints of each document and of its text edited with the next one's start."""
    names = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    last = None  # (doc_id, text, slice, fp) that waits for its successor
    for b in batches:
        out = []
        for doc, text, at, guest in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
            fp = simhash(text)
            if last is not None and last[2] == at:
                new = edited(last[1], text)
                out.append((last[0], len(last[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), last[3], simhash(new), fp))
            last = None if guest else (doc, text, at, fp)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, "<u8").view("<i8") if n in ("fp", "edited_fp", "next_fp") else c, k) for n, c, k in zip(names, zip(*out, strict=True), kinds, strict=True)], names)


def block_masks(radius: int, agree: int = 2) -> list[int]:
    """The bits of each choice of `agree` of radius + agree blocks: fingerprints within radius agree on all bits of one of them."""
    n = radius + agree
    edges = [BITS * k // n for k in range(n + 1)]
    return [int(np.uint64(sum((1 << edges[k + 1]) - (1 << edges[k]) for k in c)).astype(np.int64)) for c in combinations(range(n), agree)]


def within(queries: DataFrame, fps: DataFrame, radius: int) -> DataFrame:
    """(q, fp, distance): every distinct fp of fps (fp long) within radius bits of a distinct one of queries.

    One table for each choice of blocks, keyed by the bits in it; only what meets in a table is compared, so
    nothing is missed and no two tables are crossed.
    """
    masks = block_masks(radius)
    tables = lambda df, name: df.select(F.col("fp").alias(name)).distinct().select(name, F.posexplode(F.array(*(F.col(name).bitwiseAND(F.lit(m)) for m in masks))).alias("table", "bits"))
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))).cast("int")
    met = tables(queries, "q").join(tables(fps, "fp"), ["table", "bits"]).withColumn("distance", distance).where(F.col("distance") <= radius)
    return met.select("q", "fp", "distance").distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp (the next in descending order of ids; after the last comes the first).

    A null text is an empty one, with fingerprint 0. A null id is below all ids. Rows that repeat an id stand in the order
    of their texts' hashes. A document that is alone follows itself. An empty table gives an empty result. Other
    columns are not read.
    """
    read = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = dealt(read).repartition("slice").sortWithinPartitions("slice", "guest", F.desc("doc_id"), F.xxhash64("text"))
    made = rows.mapInArrow(described, "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long")
    return made.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))


#: Radius of the query's search.
RADIUS = 3


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the fingerprints: n_near, for ids divisible by 50 the number of other documents within RADIUS bits. Rows that share an id each have their own."""
    rows = cut(fingerprints(table(spark, sf_dir, "documents")))
    sizes = rows.groupBy("fp").agg(F.count("*").alias("n"))
    asked = rows.where("doc_id % 50 = 0")
    near = within(asked, rows, RADIUS).join(sizes, "fp").groupBy("q").agg((F.sum("n") - 1).alias("n_near"))
    found = asked.select("doc_id", "fp").distinct().join(near.withColumnRenamed("q", "fp"), "fp")
    text = lambda c: F.lpad(F.lower(F.hex(c)), BITS // 4, "0")
    alike = lambda c: 1 - F.bit_count(F.col("fp").bitwiseXOR(F.col(c))) / BITS
    described_ = rows.select("doc_id", "fp", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), alike("edited_fp").alias("near_edited"), alike("next_fp").alias("near_next"))
    return described_.join(found, ["doc_id", "fp"], "left").drop("fp")
