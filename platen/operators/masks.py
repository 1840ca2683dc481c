"""Masks as cells, and rasters as pixel rows: shapes, hulls, morphology, components and filters over them."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.functions.expr import fold_angle, settled
from platen.operators import bands

#: Pixels that are compared with a hull at once.
AT_ONCE = 1 << 18


def mask_shape(cells: DataFrame, size: int) -> DataFrame:
    """(mask_id, x0, y0, x1, y1, area, rectangularity): box in shares of the frame; masks under 2 percent are none."""
    g = cells.groupBy("mask_id").agg(F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("t"), F.max("y").alias("b"), F.count("*").alias("n")).where(F.col("n") / (size * size) >= 0.02)
    return g.select("mask_id", (F.col("l") / size).alias("x0"), (F.col("t") / size).alias("y0"), ((F.col("r") + 1) / size).alias("x1"), ((F.col("b") + 1) / size).alias("y1"), (F.col("n") / (size * size)).alias("area"), (F.col("n") / ((F.col("r") - F.col("l") + 1) * (F.col("b") - F.col("t") + 1))).alias("rectangularity"))


def edges_touched(reach: float = 0.015) -> Column:
    """How many sides of x0, y0, x1, y1 lie on the frame's edge."""
    return sum(((d <= reach).cast("int") for d in (F.col("x0"), F.col("y0"), 1 - F.col("x1"), 1 - F.col("y1"))), F.lit(0))


def shape_predicates(shapes: DataFrame) -> DataFrame:
    """Adds four_sided, document_like and whole_like to shapes with fill."""
    s = shapes.withColumn("touched", edges_touched()).withColumn("four_sided", (F.col("rectangularity") >= 0.88) | (F.col("fill") >= 0.95))
    return s.withColumn("document_like", (F.col("area") <= 0.85) & F.col("four_sided") & (F.col("touched") < 3)).withColumn("whole_like", F.col("four_sided") & (F.col("area") <= 0.97) & (F.col("touched") < 3))


def quad_agreement(cells: DataFrame, quads: DataFrame, size: int) -> DataFrame:
    """(mask_id, agreement): overlap over union of a mask and the quad qx0..qy3 (in cells, either way round), cell centres counting."""
    spark = cells.sparkSession
    grid = spark.range(size * size).select(F.floor(F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    q, px, py = quads.crossJoin(F.broadcast(grid)), F.col("x") + 0.5, F.col("y") + 0.5
    cross = [(F.col(f"qx{(k + 1) % 4}") - F.col(f"qx{k}")) * (py - F.col(f"qy{k}")) - (F.col(f"qy{(k + 1) % 4}") - F.col(f"qy{k}")) * (px - F.col(f"qx{k}")) for k in range(4)]
    inside = (F.least(*cross) >= 0) | (F.greatest(*cross) <= 0)
    both = q.select("mask_id", "y", "x", inside.alias("inside")).join(cells.withColumn("on", F.lit(True)), ["mask_id", "y", "x"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    either = F.sum((F.col("inside") | F.col("on")).cast("long"))
    return both.groupBy("mask_id").agg(F.coalesce(F.try_divide(F.sum((F.col("inside") & F.col("on")).cast("long")), either), F.lit(0.0)).alias("agreement"))


def pick_mask(shares: DataFrame, high: float = 0.97) -> DataFrame:
    """(scan_id, mask_id): the best-scored mask of a share in (0.05, high), else the best-scored one of all."""
    good = (F.col("share") > 0.05) & (F.col("share") < high)
    order = F.struct("score", -F.col("mask_id"))
    g = shares.groupBy("scan_id").agg(F.max_by("mask_id", F.when(good, order)).alias("good"), F.max_by("mask_id", order).alias("any"))
    return g.select("scan_id", F.coalesce("good", "any").alias("mask_id"))


def best_at_points(shares: DataFrame) -> DataFrame:
    """(scan_id, mask_id): the best-scored mask with a valid rectangle, else the best-scored."""
    order = F.struct("score", -F.col("mask_id"))
    g = shares.groupBy("scan_id").agg(F.max_by("mask_id", F.when(F.col("valid"), order)).alias("good"), F.max_by("mask_id", order).alias("any"))
    return g.select("scan_id", F.coalesce("good", "any").alias("mask_id"))


def theil_sen(points: DataFrame, keys: list[str], min_gap: Column | float, least: int = 8) -> DataFrame:
    """(keys, slope, intercept, scatter) of points (t, v): medians over the slopes of pairs at least min_gap apart; lines with fewer than `least` points or slopes are none."""
    a, b = points.alias("a"), points.alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    gap = F.col("b.t") - F.col("a.t")
    pairs = a.join(b, on & (gap >= min_gap)).select(*(F.col(f"a.{k}") for k in keys), ((F.col("b.v") - F.col("a.v")) / gap).alias("s"))
    slopes = pairs.groupBy(*keys).agg(F.median("s").alias("slope"), F.count("*").alias("pairs")).where(F.col("pairs") >= least)
    line = points.join(slopes, keys).groupBy(*keys).agg(F.first("slope").alias("slope"), F.median(F.col("v") - F.col("slope") * F.col("t")).alias("intercept"), F.count("*").alias("n")).where(F.col("n") >= least)
    return points.join(line, keys).groupBy(*keys).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.median(F.abs(F.col("v") - F.col("slope") * F.col("t") - F.col("intercept"))).alias("scatter"))


def row_extremes(cells: DataFrame) -> DataFrame:
    """First and last cell of each row: all that hulls need."""
    return cells.groupBy("mask_id", "y").agg(F.min("x").alias("first_x"), F.max("x").alias("last_x"))


def convex_hull(cells: DataFrame) -> DataFrame:
    """(mask_id, hull): the cells (x, y) at the corners of each mask's hull in order, without those in line. A monotone chain, folded over the mask's sorted row extremes."""
    r = row_extremes(cells)
    points = r.select("mask_id", F.explode(F.array(*(F.struct(F.col(c).cast("long").alias("x"), F.col("y").cast("long").alias("y")) for c in ("first_x", "last_x")))).alias("p")).distinct()
    per = points.groupBy("mask_id").agg(F.sort_array(F.collect_list("p")).alias("up"))
    per = per.select("mask_id", "up", F.reverse("up").alias("down"))
    kind = "array<struct<x:bigint,y:bigint>>"

    def turn(a: Column, b: Column, c: Column) -> Column:
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def chain(points_: str) -> Column:
        def step(s: Column, p: Column) -> Column:
            # The last corners go as long as the new point makes them needless.
            popped = F.aggregate(F.sequence(F.lit(0), F.size(s)), s, lambda acc, _: F.when((F.size(acc) >= 2) & (turn(F.element_at(acc, -2), F.element_at(acc, -1), p) <= 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
            return F.concat(popped, F.array(p))

        return F.aggregate(points_, F.array().cast(kind), step)

    both = settled(per, low=chain("up"), high=chain("down"))
    return both.select("mask_id", F.concat(F.slice("low", F.lit(1), F.size("low") - 1), F.slice("high", F.lit(1), F.size("high") - 1)).alias("hull"))


def hull_edges(hulls: DataFrame) -> DataFrame:
    """A row (mask_id, x, y, nx, ny) for each side of the hulls of three corners and more."""
    n = F.size("hull")
    e = hulls.where(n >= 3).select("mask_id", "hull", F.posexplode("hull").alias("k", "p"))
    nxt = F.element_at(F.col("hull"), ((F.col("k") + 1) % n + 1).cast("int"))
    return e.select("mask_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"), nxt["x"].alias("nx"), nxt["y"].alias("ny"))


def clean_mask(cells: DataFrame, hulls: DataFrame) -> DataFrame:
    """The hull's silhouette, row by row between its rounded sides, which bridges all parts of a mask; one without a hull of three corners stays."""
    e = hull_edges(hulls)
    rows = e.where("y != ny").withColumn("row", F.explode(F.sequence(F.least("y", "ny"), F.greatest("y", "ny") - 1)))
    crossing = rows.select("mask_id", "row", (F.col("x") + (F.col("row") - F.col("y")) / (F.col("ny") - F.col("y")) * (F.col("nx") - F.col("x"))).alias("at"))
    at = crossing.union(e.select("mask_id", F.col("y").alias("row"), F.col("x").cast("double")))
    span = at.groupBy("mask_id", "row").agg(F.floor(F.min("at") + 0.5).cast("int").alias("a"), F.floor(F.max("at") + 0.5).cast("int").alias("b"))
    filled = span.select("mask_id", F.col("row").cast("int").alias("y"), F.explode(F.sequence("a", "b")).alias("x"))
    return filled.union(cells.join(e.select("mask_id").distinct(), "mask_id", "left_anti").select("mask_id", "y", "x"))


class _Trims:
    """How far the pixels of runs lie outside the hulls that come with them (corners x, y, x, y, ...; null: none)."""

    def __init__(self, b: pa.RecordBatch, width: int, offset: float, ramp: float):
        self.t = pa.Table.from_batches([b])
        self.y, self.x, self.v, self.of = bands.unpacked(self.t)
        ids = self.t.column("mask_id").to_numpy()
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ends = np.append(0, np.cumsum(self.t.column("n").to_numpy(), dtype=np.int64))
        self.ids, self.heights, self.hulls = ids[first], self.t.column("height").to_numpy()[first], self.t.column("corners").take(pa.array(first)).to_pylist()
        self.spans = list(zip(ends[first].tolist(), [*ends[first[1:]].tolist(), int(ends[-1])], strict=True))
        self.alpha = np.ones(len(self.v))
        for (a, z), h, hull in zip(self.spans, self.heights.tolist(), self.hulls, strict=True):
            if hull:
                for k in range(a, z, AT_ONCE):
                    part = slice(k, min(k + AT_ONCE, z))
                    self.alpha[part] = self.of_hull(np.array(hull, np.float64).reshape(-1, 2), self.y[part], self.x[part], width, h, offset, ramp)

    @staticmethod
    def of_hull(hull: np.ndarray, y: np.ndarray, x: np.ndarray, width: int, height: int, offset: float, ramp: float) -> np.ndarray:
        (l, t), (r, b) = hull.min(axis=0), hull.max(axis=0)
        mx, my = l + (x + 0.5) / width * (r - l + 1) - 0.5, t + (y + 0.5) / height * (b - t + 1) - 0.5
        inside, off = np.ones(len(x), bool), np.full(len(x), np.inf)
        for (sx, sy), (nx, ny) in zip(hull, np.roll(hull, -1, axis=0), strict=True):
            dx, dy = nx - sx, ny - sy
            inside &= dx * (my - sy) - dy * (mx - sx) >= 0
            k = np.clip(((mx - sx) * dx + (my - sy) * dy) / (dx * dx + dy * dy), 0.0, 1.0)
            ex, ey = mx - sx - k * dx, my - sy - k * dy
            off = np.minimum(off, np.sqrt(ex * ex + ey * ey))
        return np.floor(np.where(inside, 1.0, np.clip((offset - off) / ramp + 0.5, 0.0, 1.0)) * 1e6 + 0.37) / 1e6


def trim_to_mask(pixels: DataFrame, hulls: DataFrame, width: int, most: float = 0.009, offset: float = 0.5, ramp: float = 0.35) -> DataFrame:
    """(mask_id, y, x, v): pixels of a crop outside its mask's hull whitened over a soft edge, the crop being the hull's box. height is a column.

    No more than `most` of the crop changes: of the pixels that would, the ones furthest outside do, in raster order among equals. Runs are dealt by
    mask once, and passed over twice: for the last pixel that changes, of which a task holds a crop's share `most` alone, and to change them.
    """
    flat = F.flatten(F.transform("hull", lambda p: F.array(p["x"].cast("int"), p["y"].cast("int"))))
    corners = hulls.where(F.size("hull") >= 3).select(F.col("mask_id").cast("long").alias("mask_id"), flat.alias("corners"))
    rows = bands.runs(pixels, ("mask_id",), ("height",)).repartition("mask_id").join(corners.hint("merge"), "mask_id", "left").select("mask_id", "y", "x", "n", "v", "whole", "height", "corners")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, share, held, done = None, 0, [np.empty(0)] * 2, []

        def least() -> list[np.ndarray]:
            """The first `share` of held (alpha, place), in order."""
            order = np.lexsort(held[::-1])[:share]
            return [c[order] for c in held]

        def cut() -> Iterator[tuple]:
            if now is not None and len(held[0]):
                alpha, place = least()
                yield (now, float(alpha[-1]), int(place[-1])) if share else (now, -1.0, -1)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int64(), pa.float64(), pa.int64()), strict=True)], ["mask_id", "last_alpha", "last_place"])

        for b in batches:
            if not b.num_rows:
                continue
            p, done = _Trims(b, width, offset, ramp), []
            for mask, height, (a, z) in zip(p.ids.tolist(), p.heights.tolist(), p.spans, strict=True):
                if mask != now:
                    done.extend(cut())
                    now, share, held = mask, floor(width * height * most), [np.empty(0), np.empty(0, np.int64)]
                changed = a + np.flatnonzero(p.alpha[a:z] < 1)
                held = [np.append(held[0], p.alpha[changed]), np.append(held[1], p.y[changed] * width + p.x[changed])]
                if len(held[0]) > share + 1:
                    held = [c[:1] for c in held] if not share else least()
            if done:
                yield out()
        done = list(cut())
        if done:
            yield out()

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = _Trims(b, width, offset, ramp)
            alpha, place = (p.t.column(c).to_numpy()[p.of] for c in ("last_alpha", "last_place"))
            new = (p.alpha < 1) & ((p.alpha < alpha) | (p.alpha == alpha) & (p.y * width + p.x <= place))
            v = np.where(new, np.floor(p.v * p.alpha + 255 * (1 - p.alpha) + 0.5000005), p.v).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(p.t.column("mask_id").to_numpy()[p.of]), pa.array(p.y.astype(np.int32)), pa.array(p.x.astype(np.int32)), pa.array(v)], ["mask_id", "y", "x", "v"])

    lasts = rows.mapInArrow(last, "mask_id long, last_alpha double, last_place long")
    return rows.join(lasts.hint("merge"), "mask_id", "left").withColumns({"last_alpha": F.coalesce("last_alpha", F.lit(-1.0)), "last_place": F.coalesce("last_place", F.lit(-1).cast("long"))}).mapInArrow(trimmed, "mask_id long, y int, x int, v int")


def min_area_rect(hulls: DataFrame) -> DataFrame:
    """(mask_id, cx, cy, w, h, angle): of the rectangles along each hull edge the least in area, the first of equals, its angle folded."""
    n = F.size("hull")
    e = hulls.where(n >= 3).select("mask_id", "hull", F.posexplode("hull").alias("k", "p"))
    nxt = F.element_at(F.col("hull"), ((F.col("k") + 1) % n + 1).cast("int"))
    e = settled(e, dx=(nxt["x"] - F.col("p.x")).cast("double"), dy=(nxt["y"] - F.col("p.y")).cast("double"))
    e = settled(e, a=F.atan2("dy", "dx"))
    along, across = (lambda p: p["x"] * F.cos(F.col("a")) + p["y"] * F.sin(F.col("a"))), (lambda p: p["y"] * F.cos(F.col("a")) - p["x"] * F.sin(F.col("a")))
    e = settled(e, us=F.transform("hull", along), vs=F.transform("hull", across))
    e = settled(e, u0=F.array_min("us"), u1=F.array_max("us"), v0=F.array_min("vs"), v1=F.array_max("vs"))
    area = F.floor((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0")) * 1e6 + 0.5)
    best = e.groupBy("mask_id").agg(F.min_by(F.struct("u0", "u1", "v0", "v1", "a"), F.struct(area, "k")).alias("b")).select("mask_id", "b.*")
    u, v = (F.col("u0") + F.col("u1")) / 2, (F.col("v0") + F.col("v1")) / 2
    angle, w, h = fold_angle(F.degrees("a"), F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0"))
    return best.select("mask_id", (u * F.cos("a") - v * F.sin("a")).alias("cx"), (u * F.sin("a") + v * F.cos("a")).alias("cy"), w.alias("w"), h.alias("h"), angle.alias("angle"))


def dense(cells: DataFrame, size: int) -> DataFrame:
    """All cells (mask_id, y, x, v) of masks that have any: v is 1 where on."""
    grid = cells.sparkSession.range(size * size).select(F.floor(F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    return cells.select("mask_id").distinct().crossJoin(F.broadcast(grid)).join(cells.select("mask_id", "y", "x", F.lit(1).alias("v")), ["mask_id", "y", "x"], "left").fillna(0, ["v"])


def morphology(grid: DataFrame, op: str, r: int, key: str = "mask_id") -> DataFrame:
    """dilate, erode, close or open v of a dense grid with a (2r+1) square, clipped at the border: two window passes each."""
    if op in ("close", "open"):
        first, second = ("dilate", "erode") if op == "close" else ("erode", "dilate")
        return morphology(morphology(grid, first, r, key), second, r, key)
    f = F.max if op == "dilate" else F.min
    across, down = Window.partitionBy(key, "y").orderBy("x").rowsBetween(-r, r), Window.partitionBy(key, "x").orderBy("y").rowsBetween(-r, r)
    return grid.withColumn("v", f("v").over(across)).withColumn("v", f("v").over(down))


def boundary_edges(cells: DataFrame) -> DataFrame:
    """(mask_id, y, x, side): unit edges between cells that are on and neighbours that are not."""
    around = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for s, dy, dx in (("top", -1, 0), ("right", 0, 1), ("bottom", 1, 0), ("left", 0, -1))))
    e = cells.select("mask_id", "y", "x", F.inline(around)).withColumn("ny", F.col("y") + F.col("dy")).withColumn("nx", F.col("x") + F.col("dx"))
    on = cells.select("mask_id", F.col("y").alias("ny"), F.col("x").alias("nx"))
    return e.join(on, ["mask_id", "ny", "nx"], "left_anti").select("mask_id", "y", "x", "side")


def print_density(rects: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """(rect_id, density): share of print among photo cells in each rectangle x0, y0, x1, y1 of a scan; null under 2 cells a side or 20 in all."""
    cut = lambda c, low: F.floor((F.greatest(F.col(c), F.lit(0.0)) if low else F.least(F.col(c), F.lit(1.0))) * size).cast("int")
    r = settled(rects, a=cut("x0", True), b=cut("x1", False), c=cut("y0", True), d=cut("y1", False))
    inside = (F.col("x") >= F.col("a")) & (F.col("x") < F.col("b")) & (F.col("y") >= F.col("c")) & (F.col("y") < F.col("d")) & (F.col("v") != 2)
    hit = r.where("b - a >= 2 AND d - c >= 2").join(cells, "scan_id").where(inside).groupBy("rect_id").agg(F.avg((F.col("v") == 1).cast("double")).alias("density"), F.count("*").alias("n")).where("n >= 20")
    return rects.select("rect_id").join(hit.select("rect_id", "density"), "rect_id", "left")


def mask_print_density(cells: DataFrame, print_cells: DataFrame) -> DataFrame:
    """(mask_id, density): share of print under a mask, 0 for up to 50 cells of photo."""
    j = cells.join(print_cells.where("v != 2"), ["mask_id", "y", "x"])
    g = j.groupBy("mask_id").agg(F.avg((F.col("v") == 1).cast("double")).alias("d"), F.count("*").alias("n"))
    return cells.select("mask_id").distinct().join(g, "mask_id", "left").select("mask_id", F.when(F.col("n") > 50, F.col("d")).otherwise(0.0).alias("density"))


def outer_strips(boxes: DataFrame) -> DataFrame:
    """Four rows per box x0, y0, x1, y1: the strips just outside it. Those above and below are as deep as its width asks, and the others as its height."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    gy, dy, gx, dx = 0.012 + 0.01 * h, 0.15 * w, 0.012 + 0.01 * w, 0.15 * h
    s = lambda k, a, b, c, d: F.struct(F.lit(k).alias("strip"), a.alias("sx0"), b.alias("sy0"), c.alias("sx1"), d.alias("sy1"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return boxes.select("*", F.inline(F.array(s(0, x0, y0 - gy - dy, x1, y0 - gy), s(1, x0, y1 + gy, x1, y1 + gy + dy), s(2, x0 - gx - dx, y0, x0 - gx, y1), s(3, x1 + gx, y0, x1 + gx + dx, y1))))


def continues_beyond(boxes: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """(box_id, beyond): whether print in some outer strip is denser than 0.02."""
    strips = outer_strips(boxes).select("box_id", "scan_id", (F.col("box_id") * 4 + F.col("strip")).alias("rect_id"), F.col("sx0").alias("x0"), F.col("sy0").alias("y0"), F.col("sx1").alias("x1"), F.col("sy1").alias("y1"))
    d = print_density(strips, cells, size)
    return strips.join(d, "rect_id").groupBy("box_id").agg((F.coalesce(F.max("density"), F.lit(0.0)) > 0.02).alias("beyond"))


def ring_gain(best: DataFrame, others: DataFrame, print_cells: DataFrame, size: int) -> DataFrame:
    """(scan_id, mask_id, density): print in what a larger mask has beyond the best one grown by a cell."""
    grown = morphology(dense(best.select("mask_id", "y", "x"), size), "dilate", 1).where("v = 1")
    owner = best.select("scan_id", F.col("mask_id").alias("best_id")).distinct()
    ring = others.join(owner, "scan_id").join(grown.select(F.col("mask_id").alias("best_id"), "y", "x"), ["best_id", "y", "x"], "left_anti")
    return ring.join(print_cells.where("v != 2"), ["scan_id", "y", "x"]).groupBy("scan_id", "mask_id").agg(F.avg((F.col("v") == 1).cast("double")).alias("density"))


def classic_objects(components: DataFrame, size: int, least: float = 0.015, rectangular: float = 0.82, most: int = 16) -> DataFrame:
    """(mask_id, label, cx, cy, w, h, angle, score): parts of a share of the frame and rectangular once filled by their hull, the largest first, most at most; the score is the rectangularity."""
    parts = components.select((F.col("mask_id") * size * size + F.col("label")).alias("mask_id"), "y", "x")
    hulls = convex_hull(parts)
    filled = clean_mask(parts, hulls).groupBy("mask_id").agg(F.count("*").alias("n"))
    r = min_area_rect(hulls).join(filled, "mask_id").withColumn("score", F.col("n") / ((F.col("w") + 1) * (F.col("h") + 1))).where((F.col("n") >= least * size * size) & (F.col("score") >= rectangular))
    r = r.withColumn("label", F.col("mask_id") % (size * size)).withColumn("mask_id", F.expr(f"mask_id div {size * size}"))
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("mask_id").orderBy(F.desc("n"), "label"))).where(F.col("k") <= most)
    return r.select("mask_id", "label", "cx", "cy", "w", "h", "angle", "score")


def candidates_from_masks(cells: DataFrame, size: int, close: int = 1, share: tuple[float, float] = (0.015, 0.92), least_side: float = 2.0, rectangular: float = 0.82, longest: float = 8.0) -> DataFrame:
    """(mask_id, cx, cy, w, h, angle, share): the least rectangle around each mask, in cells, once closed by `close` cells, of those with a share of the frame, sides, filling and proportions a document could have."""
    closed = morphology(dense(cells, size), "close", close).where("v = 1").select("mask_id", "y", "x")
    r = min_area_rect(convex_hull(closed)).join(closed.groupBy("mask_id").agg(F.count("*").alias("n")), "mask_id").withColumn("share", F.col("n") / (size * size))
    fills = F.col("n") / ((F.col("w") + 1) * (F.col("h") + 1)) >= rectangular
    shaped = (F.least("w", "h") >= least_side) & (F.greatest(F.col("w") / F.col("h"), F.col("h") / F.col("w")) < longest)
    return r.where((F.col("share") > share[0]) & (F.col("share") < share[1]) & shaped & fills).drop("n")


def outline_quad(cells: DataFrame, size: int, margin: float = 0.15, tilt: tuple[float, float] = (0.02, 0.45)) -> DataFrame:
    """(mask_id, x0..y3): the mask's four sides as lines met in corners, in cells.

    Each side's boundary cells, without the ends, are fitted robustly. A side takes its own tilt only when the mask is inside the
    frame, the tilt is a document's and the points lie on the line; else it is the box's.
    """
    box = cells.groupBy("mask_id").agg(F.min("x").alias("l"), (F.max("x") + 1).alias("r"), F.min("y").alias("t"), (F.max("y") + 1).alias("b"))
    inside = (F.col("l") / size > 0.015) & (F.col("t") / size > 0.015) & (1 - F.col("r") / size > 0.015) & (1 - F.col("b") / size > 0.015)
    box = box.withColumn("inside", inside)
    fits = None
    for sides, along, across, low, high in ((("top", "bottom"), "x", "y", "l", "r"), (("left", "right"), "y", "x", "t", "b")):
        cut = F.floor(margin * (F.col(high) - F.col(low)))
        ends = cells.join(box, "mask_id").where((F.col(along) >= F.col(low) + cut) & (F.col(along) < F.col(high) - cut)).groupBy("mask_id", along, low, high).agg(F.min(across).alias("first"), (F.max(across) + 1).alias("last"))
        for side, at in zip(sides, ("first", "last"), strict=True):
            pts = ends.select("mask_id", F.lit(side).alias("side"), (F.col(along) + 0.5 - (F.col(low) + F.col(high)) / 2).alias("t"), F.col(at).cast("double").alias("v"), F.greatest(F.lit(4.0), 0.2 * (F.col(high) - F.col(low))).alias("gap"))
            fits = pts if fits is None else fits.union(pts)
    lines = theil_sen(fits, ["mask_id", "side"], F.col("a.gap"))
    grid = box.select("*", F.explode(F.array(*(F.lit(s) for s in ("top", "right", "bottom", "left")))).alias("side"))
    j = grid.join(lines, ["mask_id", "side"], "left")
    good = F.col("inside") & F.coalesce((F.abs("slope") > tilt[0]) & (F.abs("slope") <= tilt[1]) & (F.col("scatter") <= 1), F.lit(False))
    flat = F.when(F.col("side") == "top", F.col("t")).when(F.col("side") == "bottom", F.col("b")).when(F.col("side") == "left", F.col("l")).otherwise(F.col("r"))
    mid = F.when(F.col("side").isin("top", "bottom"), (F.col("l") + F.col("r")) / 2).otherwise((F.col("t") + F.col("b")) / 2)
    j = j.select("mask_id", "side", F.when(good, F.col("slope")).otherwise(0.0).alias("m"), (F.when(good, F.col("intercept")).otherwise(flat) - F.when(good, F.col("slope")).otherwise(0.0) * mid).alias("c"))
    w = j.groupBy("mask_id").pivot("side", ["top", "right", "bottom", "left"]).agg(F.first("m").alias("m"), F.first("c").alias("c"))
    out = {}
    for k, (h, u) in enumerate((("top", "left"), ("top", "right"), ("bottom", "right"), ("bottom", "left"))):
        y = F.try_divide(F.col(f"{h}_m") * F.col(f"{u}_c") + F.col(f"{h}_c"), 1 - F.col(f"{h}_m") * F.col(f"{u}_m"))
        out[f"x{k}"], out[f"y{k}"] = F.col(f"{u}_m") * y + F.col(f"{u}_c"), y
    return w.select("mask_id", *(c.alias(n) for n, c in out.items()))
