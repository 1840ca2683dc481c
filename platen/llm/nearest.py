"""Approximate nearest neighbours by inner product along shifted space-filling curves.

The coordinates of a random rotation are dealt to CURVES groups; each group, shifted by a random offset, is ordered by a Hilbert curve. Along
each curve the rows are range-partitioned into blocks and sorted by key, and every query is scored, in double precision, against
the tiles before, around and after it: TILE to 2 * TILE neighbours on either side. The windows of all curves merge and the best remain.

Rows are indexed as distinct vectors, each with the few smallest ids that have it, so copies of one vector, however many, are one row
and are still all found. The low bits of a key come from the vector's hash, so that near copies with one place on the curve
spread over blocks. What a query costs is fixed by CURVES and TILE, so the whole grows in proportion to the rows; the recall of a fixed window falls slowly as they grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platen.llm.common import cut, slices, table

CURVES, TILE, TOP = 8, 3072, 20
#: Coordinates of a curve and bits of each; TIE bits of a hash stand below them in the key.
DIMS, BITS, TIE = 8, 6, 15
#: Vectors, those with the smallest hashes, from which centre and spread of the coordinates are taken; all rows are indexed.
FIT = 10_000
#: Rows of a block that are aimed at, and blocks of a curve at most; a larger block is streamed through like a smaller one.
BLOCK_ROWS, MOST_BLOCKS = 16_384, 1 << 14
#: Queries scored at once.
QUERIES = 256
SEED = 7


@dataclass
class Curves:
    """The orderings: row -> one key for each curve."""

    rotation: np.ndarray  # curve, coordinate of the vector and its complement, coordinate of the curve
    shift: np.ndarray  # curve, coordinate of the curve
    spread: np.ndarray
    longest: float  # of all vectors; the complement makes all of one length, so that nearness is largest inner product

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])

    def keys(self, x: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """(curve, row) -> key."""
        full, side = self.lifted(x), 1 << BITS
        cells = [np.clip(np.floor(((full @ r - s) / w / 6 + 0.5) * side), 0, side - 1).astype(np.int64) for r, s, w in zip(self.rotation, self.shift, self.spread, strict=True)]
        return np.stack([(hilbert(c, BITS) << TIE) | (ties & ((1 << TIE) - 1)) for c in cells])


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points (row, coordinate) of `bits` bits each, by turning and reflecting each half of the cube in turn."""
    x, d = cells.T.copy(), cells.shape[1]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(d):
            upper = (x[i] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flips
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> level) & 1
    return key


def fitted(sample: np.ndarray, longest: float, curves: int, seed: int = SEED) -> Curves:
    """Curves for vectors like those of sample (row, coordinate). Each takes DIMS new coordinates of a rotation until it has no more, then of the next."""
    rng, size = np.random.default_rng(seed), sample.shape[1] + 1
    dims, parts = min(DIMS, size), []
    while len(parts) < curves:
        turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
        parts += [turn[:, a : a + dims] for a in range(0, size - dims + 1, dims)]
    made = Curves(np.stack(parts[:curves]), np.zeros((curves, dims)), np.ones((curves, dims)), longest)
    at = np.einsum("nd,cdk->cnk", made.lifted(sample), made.rotation)
    made.spread = np.maximum(at.std(axis=1), 1e-12)
    made.shift = at.mean(axis=1) + made.spread * rng.uniform(-0.5, 0.5, (curves, dims))
    return made


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length, without nulls, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, h1, h2): rows with an id and a vector of the table's commonest length (of equals the longest) that is finite and not zero; h1 and h2 name the vector."""
    v = F.transform(F.col(vector_col).cast("array<float>"), lambda x: x + F.lit(0.0).cast("float"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    huge = F.lit(float("inf")).cast("float")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < huge)) & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (lengths["n"] if lengths else 0)).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2"))


def named(rows: DataFrame) -> DataFrame:
    """(id, h1, h2): each id once."""
    return rows.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")


def distinct_vectors(rows: DataFrame, asked: str, top: int) -> DataFrame:
    """(h1, h2, v, ids, asks): each vector once, with its top + 1 smallest ids and whether a query has it."""
    names = named(rows)
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    few = names.withColumn("nth", nth).where(F.col("nth") <= top + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asks = names.where(asked).select("h1", "h2").distinct().withColumn("asks", F.lit(True))
    one = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"))
    # A vector that stands for no id goes.
    return one.join(few, ["h1", "h2"]).join(asks, ["h1", "h2"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))


_ROW = "curve int, block int, key long, guest boolean, h1 long, h2 long, asks boolean, ids array<long>, v array<float>"
_NAMES = ["curve", "block", "key", "guest", "h1", "h2", "asks", "ids", "v"]


def dealt(distinct: DataFrame, curves: Curves, tile: int, block_rows: int) -> DataFrame:
    """distinct once for each curve, in its block; queries near the end of a block are guests of the next one as well.

    Blocks are ranges of keys between approximate quantiles. Near each cut stand two more, TILE ranks below and above it. The driver holds
    three numbers for each of at most MOST_BLOCKS blocks of a curve.
    """
    n, count = distinct.count(), len(curves.rotation)
    blocks = max(1, min(MOST_BLOCKS, n // max(block_rows, tile)))
    shared = distinct.sparkSession.sparkContext.broadcast(curves)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = shared.value.keys(matrix(b.column(1)), b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(count, dtype=np.int32), b.num_rows)), pa.array(keys.ravel())], ["curve", "key"])

    cuts = np.zeros((count, 3, 0), np.int64)
    if blocks > 1:
        share = [min(1.0, max(0.0, k / blocks + side * tile / n)) for side in (-1, 0, 1) for k in range(1, blocks)]
        found = distinct.select("h1", "v").mapInArrow(keyed, "curve int, key long").groupBy("curve").agg(F.percentile_approx("key", share, 20 * blocks).alias("cuts")).collect()
        cuts = np.array([r["cuts"] for r in sorted(found)], np.int64).reshape(count, 3, blocks - 1)
    edges = distinct.sparkSession.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(pa.Table.from_batches([batch]).to_batches(max_chunksize=2048), 2048):
                every = shared.value.keys(matrix(b.column("v")), b.column("h1").to_numpy())
                asks = b.column("asks").to_numpy(zero_copy_only=False)
                for c, keys in enumerate(every):
                    below, cut_, above = edges.value[c]
                    own = np.searchsorted(cut_, keys, "right")
                    visits = [(np.arange(len(keys)), own, False)]
                    if len(cut_):
                        up = np.flatnonzero(asks & (own < len(cut_)) & (keys >= np.append(below, 0)[own]))
                        down = np.flatnonzero(asks & (own > 0) & (keys < above[own - 1]))
                        visits += [(up, own[up] + 1, True), (down, own[down] - 1, True)]
                    for at, block, guest in visits:
                        if len(at):
                            rest = [b.column(x).take(pa.array(at)) for x in _NAMES[4:]]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(block.astype(np.int32)), pa.array(keys[at]), pa.array(np.full(len(at), guest)), *rest], _NAMES)

    return distinct.select(_NAMES[4:]).mapInArrow(deal, _ROW)


@dataclass
class Tile:
    h: np.ndarray  # h1, h2 by row
    x: np.ndarray
    ids: list[list[int]]
    host: np.ndarray
    asks: np.ndarray


def best(queries: np.ndarray, tiles: list[Tile], top: int) -> Iterator[list[tuple[int, float]]]:
    """For each query the top + 1 best (id, score) among the hosts of tiles, best first."""
    x = np.concatenate([t.x[t.host] for t in tiles])
    ids = [i for t in tiles for i, host in zip(t.ids, t.host, strict=True) if host]
    first = np.array([i[0] for i in ids], np.int64)
    sizes = np.sqrt((x * x).sum(1))
    for a in range(0, len(queries), QUERIES):
        q = queries[a : a + QUERIES]
        scores, most = q @ x.T, min(top + 1, len(x))
        least = np.partition(scores, -most, axis=1)[:, -most]
        # Sums in another order may differ in their last bits: what is that near the last place stays in, and is summed once more, always in the same order.
        slack = 1e-15 * x.shape[1] * np.sqrt((q * q).sum(1)) * sizes.max()
        for k in range(len(q)):
            at = np.flatnonzero(scores[k] >= least[k] - slack[k])
            exact = (x[at] * q[k]).sum(axis=1)
            order = np.lexsort((first[at], -exact))[:most]
            found = [(-exact[o], i) for o in order for i in ids[at[o]]]
            yield [(i, -s) for s, i in sorted(found)[: top + 1]]


def searched(batches: Iterator[pa.RecordBatch], tile: int, top: int) -> Iterator[pa.RecordBatch]:
    """Rows of dealt(), sorted by (curve, block, key) -> (h1, h2, id, score): what each query finds in its window. Three tiles are held at a time."""

    def answers(tiles: list[Tile | None]) -> Iterator[pa.RecordBatch]:
        now = tiles[1]
        if now is None or not (pick := np.flatnonzero(now.asks)).size:
            return
        near = [t for t in tiles if t is not None and t.host.any()]
        if not near:
            return
        out = [(*now.h[k].tolist(), i, s) for k, found in zip(pick, best(now.x[pick], near, top), strict=True) for i, s in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["h1", "h2", "id", "score"])

    held: list[pa.RecordBatch] = []
    tiles: list[Tile | None] = [None, None, None]
    place, hosts = None, 0

    def closed() -> Iterator[pa.RecordBatch]:
        """The rows held become the newest tile; the one before it has both neighbours now."""
        t = pa.Table.from_batches(held).combine_chunks() if held else None
        column = lambda n: t.column(n).combine_chunks()
        new = t and Tile(np.stack([column("h1").to_numpy(), column("h2").to_numpy()], 1), matrix(column("v")), column("ids").to_pylist(), ~column("guest").to_numpy(zero_copy_only=False), column("asks").to_numpy(zero_copy_only=False))
        held.clear()
        tiles[:] = [*tiles[1:], new]
        yield from answers(tiles)

    for b in batches:
        if not b.num_rows:
            continue
        where = np.stack([b.column("curve").to_numpy(), b.column("block").to_numpy()], 1)
        host = ~b.column("guest").to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for a, z in zip(starts, starts[1:], strict=False):
            if place != (now := tuple(where[a].tolist())):
                yield from closed()
                yield from closed()
                tiles, place, hosts = [None, None, None], now, 0
            while a < z:
                full = np.flatnonzero(np.cumsum(host[a:z]) == tile - hosts)
                end = a + int(full[0]) + 1 if len(full) else z
                held.append(b.slice(a, end - a))
                hosts += int(host[a:end].sum())
                a = end
                if hosts == tile:
                    yield from closed()
                    hosts = 0
    yield from closed()
    yield from closed()


def nearest(vectors: DataFrame, asked: str, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, curves: int = CURVES, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found of each query; asked is a SQL condition on the column id.

    Nearness is the largest inner product; ties go to the smaller id. Rows without an id, and vectors that are null, zero, of another length than
    most, or hold null or non-finite components, take no part. Rows of one id count once; if
    their vectors differ, the one with the least hash (h1, h2) stands for it. Equal vectors under different ids are neighbours like others. With fewer other ids than `top` all are
    returned. An empty table gives no row. Other columns are not read.
    """
    rows = cut(usable(vectors, id_col, vector_col))
    distinct = cut(distinct_vectors(rows, asked, top))
    sample = distinct.orderBy(F.xxhash64("h2"), "h1").limit(FIT).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    model = fitted(matrix(sample), distinct.agg(F.max(length)).first()[0], curves)
    windows = dealt(distinct, model, tile, block_rows).repartition("curve", "block").sortWithinPartitions("curve", "block", "key", "h1", "h2")
    found = windows.mapInArrow(lambda batches: searched(batches, tile, top), "h1 long, h2 long, id long, score double")
    merged = found.groupBy("h1", "h2", "id").agg(F.max("score").alias("score"))
    # One more than asked for stays, as a query's own id is among them.
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id"))
    lists = cut(merged.withColumn("nth", first).where(F.col("nth") <= top + 1).drop("nth"))
    pairs = named(rows.where(asked)).withColumnRenamed("id", "query_id").join(lists, ["h1", "h2"]).where("id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.select("query_id", rank.alias("rank"), F.col("id").alias("vec_id"), "score").where(F.col("rank") <= top)


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
