"""Connected parts of masks: bands of rows are labelled by tasks, and what crosses from band to band is linked by star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.sources.checkpoints import checkpointed

#: Rows of a band.
BAND = 256


def row_runs(cells: DataFrame, width: int, key: str = "mask_id") -> DataFrame:
    """(key, y, a, b, id): cells of a row without a gap, from a to b; id is the place of the first in raster order."""
    row = Window.partitionBy(key, "y").orderBy("x")
    runs = cells.withColumn("g", F.col("x") - F.row_number().over(row)).groupBy(key, "y", "g").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return runs.select(F.col(key).cast("long").alias(key), F.col("y").cast("int").alias("y"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), (F.col("y").cast("long") * width + F.col("a")).alias("id"))


def banded(batches: Iterator[pa.RecordBatch], band: int) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (key, y, a) come back with `part`, the least id of the part of their band that they belong to. One band of one key is held at a time."""
    held: list[tuple] = []
    where = None

    def labelled() -> list[tuple]:
        """held with parts: runs of neighbouring rows that touch, corners included, are one part."""
        above, root = list(range(len(held))), {}

        def find(k: int) -> int:
            while above[k] != k:
                above[k] = above[above[k]]
                k = above[k]
            return k

        first = k = 0  # of the row above, and of the rows that may still touch
        row_start = 0
        for n, (_, y, a, b, _) in enumerate(held):
            if n == 0 or held[n - 1][1] != y:
                first, row_start = row_start if n and held[n - 1][1] == y - 1 else n, n
                k = first
            while k < row_start and held[k][3] < a - 1:
                k += 1
            m = k
            while m < row_start and held[m][2] <= b + 1:
                above[max(find(m), find(n))] = min(find(m), find(n))
                m += 1
        for n in range(len(held)):
            root.setdefault(find(n), held[n][4])
        return [(*r, root[find(n)]) for n, r in enumerate(held)]

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "y", "a", "b", "id", "part"])

    for batch in batches:
        done: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if where != (now := (row[0], row[1] // band)):
                done += labelled()
                held, where = [], now
            held.append(row)
        yield from out(done)
    yield from out(labelled())


def star_roots(links: DataFrame, key: str, most: int = 64) -> tuple[DataFrame, int]:
    """((key, node, root), rounds): the least node that each linked one (u, v) reaches.

    Each round hangs a node's larger neighbours on its least one, and then its lesser ones as well, so chains shorten by half or more. A
    round's links are checkpointed. Over `most` rounds are an error.
    """
    checkpointed(links.sparkSession)
    edges = links.where("u != v").select(key, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    for n in range(most):
        around = edges.unionByName(edges.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy(key, "u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        upper = around.where("v > u").join(least, [key, "u"]).select(key, F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct().checkpoint()
        lowest = upper.groupBy(key, "u").agg(F.min("v").alias("low"))
        both = F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))
        edges = upper.join(lowest, [key, "u"]).select(key, F.inline(both)).where("u != v").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(key, "u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(key, F.col("u").alias("node"), F.col("v").alias("root")), n + 1
        before = now
    raise RuntimeError(f"parts still grow after {most} rounds")


def component_runs(cells: DataFrame, width: int, key: str = "mask_id", band: int = BAND, most: int = 64) -> DataFrame:
    """(key, y, a, b, root): row runs with the raster place of their part's first cell."""
    checkpointed(cells.sparkSession)
    runs = row_runs(cells, width, key).withColumn("band", F.floor(F.col("y") / band)).repartition(key, "band").sortWithinPartitions(key, "y", "a").drop("band")
    parts = runs.mapInArrow(lambda batches: banded(batches, band), "key long, y int, a int, b int, id long, part long").withColumnRenamed("key", key).checkpoint()
    last = parts.where(F.col("y") % band == band - 1).select(key, (F.col("y") + 1).alias("y"), F.col("a").alias("la"), F.col("b").alias("lb"), F.col("part").alias("u"))
    first = parts.where(F.col("y") % band == 0).select(key, "y", "a", "b", F.col("part").alias("v"))
    links = last.join(first, [key, "y"]).where("a <= lb + 1 AND b >= la - 1").select(key, "u", "v")
    roots, _ = star_roots(links, key, most)
    return parts.join(roots.withColumnRenamed("node", "part"), [key, "part"], "left").select(key, "y", "a", "b", F.coalesce("root", "part").alias("root"))


def connected_components(cells: DataFrame, width: int, key: str = "mask_id", band: int = BAND, most: int = 64) -> DataFrame:
    """(key, y, x, label): 8-connected parts, numbered by their first cell in raster order.

    Only parts that cross a band's border take part in rounds, whose number grows with the logarithm of their longest chain. Repeated cells count
    once; without cells there is no row.
    """
    runs = component_runs(cells.select(key, "y", "x").distinct(), width, key, band, most)
    named = runs.select(key, "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy(key).orderBy("root")))
    return runs.join(named, [key, "root"]).select(key, "y", F.explode(F.sequence("a", "b")).alias("x"), "label")


def component_boxes(cells: DataFrame, width: int, key: str = "mask_id", band: int = BAND, most: int = 64) -> DataFrame:
    """(key, label, x, y, w, h, area, cx, cy): box, cells and centre of each part, from its runs alone."""
    runs = component_runs(cells.select(key, "y", "x").distinct(), width, key, band, most)
    n = F.col("b") - F.col("a") + 1
    g = runs.groupBy(key, "root").agg(F.min("a").alias("x"), F.min("y").alias("y"), F.max("b").alias("r"), F.max("y").alias("t"), F.sum(n).alias("area"), F.sum(n * (F.col("a") + F.col("b")) / 2).alias("sx"), F.sum(n * F.col("y")).alias("sy"))
    g = g.withColumn("label", F.row_number().over(Window.partitionBy(key).orderBy("root")))
    return g.select(key, "label", "x", "y", (F.col("r") - F.col("x") + 1).alias("w"), (F.col("t") - F.col("y") + 1).alias("h"), "area", (F.col("sx") / F.col("area")).alias("cx"), (F.col("sy") / F.col("area")).alias("cy"))
