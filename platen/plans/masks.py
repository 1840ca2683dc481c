"""Queries on masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from platen.functions.expr import tidy
from platen.sources.checkpoints import checkpointed
from platen.operators import masks, parts
from platen.plans.register import query

T6 = "floor(({}) * 1e6 + 0.5) / 1e6"
SIZE = 8
_SHAPE = """shape AS (SELECT mask_id, min(x) / 8.0::double AS x0, min(y) / 8.0::double AS y0, (max(x) + 1) / 8.0::double AS x1, (max(y) + 1) / 8.0::double AS y1, count(*) / 64.0::double AS area,
 count(*)::double / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)) AS rectangularity FROM mask_cells GROUP BY mask_id HAVING count(*) / 64.0 >= 0.02)"""


@query("dt1_mask_shape", f"WITH {_SHAPE} SELECT * FROM shape")
def _(v):
    return masks.mask_shape(v("mask_cells"), SIZE)


def quads(v):
    """A tilted quad for each mask."""
    k = F.col("mask_id")
    at = {"qx0": 1 + k % 2, "qy0": 1 + k % 3 * 0.5, "qx1": 6.5 + k % 2 * 0.5, "qy1": 0.5 + k % 2, "qx2": 7 - k % 3 * 0.5, "qy2": F.lit(7.0), "qx3": 0.5 + k % 2 * 0.25, "qy3": 6.5 - k % 2}
    return v("masks").select("mask_id", *(c.cast("double").alias(n) for n, c in at.items()))


_QUADS = """quads8 AS (SELECT mask_id, (1 + mask_id % 2)::double AS qx0, 1 + mask_id % 3 * 0.5::double AS qy0, 6.5 + mask_id % 2 * 0.5::double AS qx1, (0.5 + mask_id % 2)::double AS qy1,
 7 - mask_id % 3 * 0.5::double AS qx2, 7.0::double AS qy2, 0.5 + mask_id % 2 * 0.25::double AS qx3, (6.5 - mask_id % 2)::double AS qy3 FROM masks)"""
_CROSS = [f"((qx{(k + 1) % 4} - qx{k}) * (c.y + 0.5 - qy{k}) - (qy{(k + 1) % 4} - qy{k}) * (c.x + 0.5 - qx{k}))" for k in range(4)]


@query("dt2_quad_agreement", f"""WITH {_QUADS}, c AS (SELECT mask_id, cast(floor(pos / 8) AS int) AS y, pos % 8 AS x, v > 0 AS "on" FROM vector_cells), j AS (SELECT c.mask_id, "on", least({', '.join(_CROSS)}) >= 0 OR greatest({', '.join(_CROSS)}) <= 0 AS inside FROM c JOIN quads8 q ON q.mask_id = c.mask_id)
 SELECT mask_id, coalesce(sum((inside AND "on")::int)::double / nullif(sum((inside OR "on")::int), 0), 0) AS agreement FROM j GROUP BY mask_id""")
def _(v):
    return masks.quad_agreement(v("mask_cells"), quads(v), SIZE)


_POINTS = "points AS (SELECT l_orderkey AS scan_id, (pk % 97)::double AS t, (sk % 53 + pk % 7)::double AS v, cand_id FROM lines)"


@query("dt4_theil_sen", f"""WITH {_POINTS}, s AS (SELECT a.scan_id, quantile_cont((b.v - a.v) / (b.t - a.t), 0.5) AS slope, count(*) AS n FROM points a JOIN points b ON a.scan_id = b.scan_id AND b.t - a.t >= 4 GROUP BY 1 HAVING count(*) >= 8),
 l AS (SELECT p.scan_id, any_value(slope) AS slope, quantile_cont(v - slope * t, 0.5) AS intercept FROM points p JOIN s ON s.scan_id = p.scan_id GROUP BY 1 HAVING count(*) >= 8)
 SELECT p.scan_id, {T6.format('any_value(slope)')} AS slope, {T6.format('any_value(intercept)')} AS intercept, {T6.format('quantile_cont(abs(v - slope * t - intercept), 0.5)')} AS scatter FROM points p JOIN l ON l.scan_id = p.scan_id GROUP BY 1""")
def _(v):
    p = v("lines").select(F.col("l_orderkey").alias("scan_id"), (F.col("pk") % 97).cast("double").alias("t"), (F.col("sk") % 53 + F.col("pk") % 7).cast("double").alias("v"))
    return masks.theil_sen(p, ["scan_id"], 4).select("scan_id", *(tidy(c).alias(c) for c in ("slope", "intercept", "scatter")))


_TOUCHED = "(x0 <= 0.015)::int + (y0 <= 0.015)::int + (1 - x1 <= 0.015)::int + (1 - y1 <= 0.015)::int"


@query("dt5_edges_touched", f"WITH {_SHAPE} SELECT mask_id, {_TOUCHED} AS touched FROM shape")
def _(v):
    return masks.mask_shape(v("mask_cells"), SIZE).select("mask_id", masks.edges_touched().alias("touched"))


@query("dt6_shape_predicates", f"""WITH {_SHAPE}, t AS (SELECT *, {_TOUCHED} AS touched, rectangularity >= 0.88 OR (mask_id % 10) / 10.0::double + 0.1 >= 0.95 AS four_sided FROM shape)
 SELECT mask_id, four_sided, area <= 0.85 AND four_sided AND touched < 3 AS document_like, four_sided AND area <= 0.97 AND touched < 3 AS whole_like FROM t""")
def _(v):
    s = masks.mask_shape(v("mask_cells"), SIZE).withColumn("fill", F.col("mask_id") % 10 / 10.0 + 0.1)
    return masks.shape_predicates(s).select("mask_id", "four_sided", "document_like", "whole_like")


_SHARES = "shares AS (SELECT m.mask_id, m.scan_id, m.score, s.share, coalesce(s.share, 0) > 0.5 AS valid FROM masks m LEFT JOIN (SELECT mask_id, count(*) / 64.0::double AS share FROM mask_cells GROUP BY 1) s ON s.mask_id = m.mask_id)"


def shares(v):
    share = v("mask_cells").groupBy("mask_id").agg((F.count("*") / 64.0).alias("share"))
    return v("masks").join(share, "mask_id", "left").withColumn("valid", F.coalesce("share", F.lit(0.0)) > 0.5)


@query("dt10_pick_mask", f"WITH {_SHARES} SELECT scan_id, coalesce(first(mask_id ORDER BY score DESC, mask_id) FILTER (WHERE share > 0.05 AND share < 0.5), first(mask_id ORDER BY score DESC, mask_id)) AS mask_id FROM shares GROUP BY scan_id")
def _(v):
    return masks.pick_mask(shares(v), 0.5)


@query("dt11_best_at_points", f"WITH {_SHARES} SELECT scan_id, coalesce(first(mask_id ORDER BY score DESC, mask_id) FILTER (WHERE valid), first(mask_id ORDER BY score DESC, mask_id)) AS mask_id FROM shares GROUP BY scan_id")
def _(v):
    return masks.best_at_points(shares(v))


@query("ra19_row_extremes", "SELECT mask_id, y, min(x) AS first_x, max(x) AS last_x FROM mask_cells GROUP BY mask_id, y")
def _(v):
    return masks.row_extremes(v("mask_cells"))


_HULL = """ext AS (SELECT mask_id, y, min(x) AS a, max(x) AS b FROM mask_cells GROUP BY 1, 2), pts AS (SELECT DISTINCT mask_id, x, y FROM (SELECT mask_id, a AS x, y FROM ext UNION ALL SELECT mask_id, b, y FROM ext)),
 sides AS (SELECT p.mask_id, p.x, p.y, q.x AS nx, q.y AS ny FROM pts p JOIN pts q ON q.mask_id = p.mask_id AND (q.x, q.y) <> (p.x, p.y) JOIN pts r ON r.mask_id = p.mask_id
  GROUP BY ALL HAVING min((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) >= 0),
 hull AS (SELECT mask_id, x, y, nx, ny FROM (SELECT *, row_number() OVER (PARTITION BY mask_id, x, y ORDER BY (nx - x) * (nx - x) + (ny - y) * (ny - y) DESC) AS k FROM sides) WHERE k = 1),
 edges AS (SELECT h.* FROM hull h WHERE NOT EXISTS (SELECT 1 FROM hull g WHERE g.mask_id = h.mask_id AND (g.nx, g.ny) <> (h.x, h.y) AND (g.x, g.y) <> (h.x, h.y)
  AND (g.nx - g.x) * (h.y - g.y) - (g.ny - g.y) * (h.x - g.x) = 0 AND (h.x - g.x) * (h.x - g.nx) + (h.y - g.y) * (h.y - g.ny) < 0))"""


@query("ra20_convex_hull", f"WITH {_HULL} SELECT mask_id, x::bigint AS x, y::bigint AS y FROM edges")
def _(v):
    return masks.convex_hull(v("mask_cells")).select("mask_id", F.inline("hull"))


_FILLED = """c AS (SELECT mask_id, r.r AS row, x + (r.r - y)::double / (ny - y) * (nx - x) AS cut FROM edges, range(8) r(r) WHERE (y <= r.r AND ny > r.r) OR (ny <= r.r AND y > r.r) UNION ALL SELECT mask_id, y, x FROM edges),
 s AS (SELECT mask_id, row, floor(min(cut) + 0.5) AS a, floor(max(cut) + 0.5) AS b FROM c GROUP BY ALL), filled AS (SELECT mask_id, row::int AS y, x.x::int AS x FROM s, range(8) x(x) WHERE x.x BETWEEN a AND b)"""


@query("ra21_clean_mask", f"WITH {_HULL}, {_FILLED} SELECT * FROM filled")
def _(v):
    return masks.clean_mask(v("mask_cells"), masks.convex_hull(v("mask_cells")))


@query("ra23_trim_to_mask", f"""WITH {_HULL}, n AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT scan_id, y, x, v, max(y) OVER (PARTITION BY scan_id) + 1 AS height, scan_id % n AS mask_id FROM pixels, n),
 box AS (SELECT mask_id, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b FROM mask_cells GROUP BY 1),
 m AS (SELECT p.*, l + (x + 0.5::double) / 80 * (r - l + 1) - 0.5 AS mx, t + (y + 0.5::double) / height * (b - t + 1) - 0.5 AS my FROM p JOIN box ON box.mask_id = p.mask_id),
 d AS (SELECT m.scan_id, m.y, m.x, min((e.nx - e.x) * (my - e.y) - (e.ny - e.y) * (mx - e.x)) >= 0 AS inside,
  min(sqrt((mx - e.x - greatest(least(((mx - e.x) * (e.nx - e.x) + (my - e.y) * (e.ny - e.y)) / ((e.nx - e.x) ** 2 + (e.ny - e.y) ** 2), 1), 0) * (e.nx - e.x)) ** 2
  + (my - e.y - greatest(least(((mx - e.x) * (e.nx - e.x) + (my - e.y) * (e.ny - e.y)) / ((e.nx - e.x) ** 2 + (e.ny - e.y) ** 2), 1), 0) * (e.ny - e.y)) ** 2)) AS off FROM m JOIN edges e ON e.mask_id = m.mask_id GROUP BY ALL),
 a AS (SELECT scan_id, y, x, floor(CASE WHEN inside THEN 1 ELSE least(greatest((0.5 - off) / 0.35 + 0.5, 0), 1) END * 1e6 + 0.37) / 1e6 AS alpha FROM d),
 k AS (SELECT a.*, row_number() OVER (PARTITION BY scan_id ORDER BY alpha, y, x) AS k FROM a WHERE alpha < 1)
 SELECT p.scan_id AS mask_id, p.y, p.x, CASE WHEN k.k <= floor((80 * p.height)::double * 0.009::double) THEN floor(p.v * alpha + 255 * (1 - alpha) + 0.5000005) ELSE p.v END::int AS v FROM p LEFT JOIN k ON k.scan_id = p.scan_id AND k.y = p.y AND k.x = p.x""")
def _(v):
    """Each document's raster is trimmed to one of the masks, which is named by the document here."""
    n = v("embeddings").count()
    of = v("documents").select(F.col("doc_id").alias("scan_id"), (F.col("doc_id") % n).alias("mask_id"))
    hulls = masks.convex_hull(v("mask_cells")).join(of, "mask_id").select(F.col("scan_id").alias("mask_id"), "hull")
    return masks.trim_to_mask(v("pixel_runs").withColumnRenamed("scan_id", "mask_id"), hulls, 80)


@query("ra22_min_area_rect", f"""WITH {_HULL}, a AS (SELECT mask_id, x, y, atan2(ny - y, nx - x) AS a FROM edges), p AS (SELECT a.mask_id, a.x, a.y, a.a, min(e.x * cos(a.a) + e.y * sin(a.a)) AS u0, max(e.x * cos(a.a) + e.y * sin(a.a)) AS u1,
 min(e.y * cos(a.a) - e.x * sin(a.a)) AS v0, max(e.y * cos(a.a) - e.x * sin(a.a)) AS v1 FROM a JOIN edges e ON e.mask_id = a.mask_id GROUP BY ALL) SELECT mask_id, {T6.format('min((u1 - u0) * (v1 - v0))')} AS area FROM p GROUP BY mask_id""")
def _(v):
    r = masks.min_area_rect(masks.convex_hull(v("mask_cells")))
    return r.select("mask_id", tidy(F.col("w") * F.col("h")).alias("area"))


_GRID = "grid AS (SELECT mask_id, cast(floor(pos / 8) AS int) AS y, cast(pos % 8 AS int) AS x, (v > 0)::int AS v FROM vector_cells)"


_CLOSED = """d AS (SELECT a.mask_id, a.y, a.x, max(b.v) AS v FROM grid a JOIN grid b ON b.mask_id = a.mask_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY ALL),
 shut AS (SELECT a.mask_id, a.y, a.x, min(b.v) AS v FROM d a JOIN d b ON b.mask_id = a.mask_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY ALL)"""


@query("ra8_morphology", f"WITH {_GRID}, {_CLOSED} SELECT * FROM shut")
def _(v):
    return masks.morphology(masks.dense(v("mask_cells"), SIZE), "close", 1)


#: The least rectangle along an edge of the hull, the first of equals from the least x and y on, its angle folded; hulls of two corners have none.
_RECT = """corners AS (SELECT mask_id, x, y, atan2(ny - y, nx - x) AS a, count(*) OVER (PARTITION BY mask_id) AS n FROM edges), across AS (SELECT c.mask_id, c.a, min(e.x * cos(c.a) + e.y * sin(c.a)) AS u0, max(e.x * cos(c.a) + e.y * sin(c.a)) AS u1,
 min(e.y * cos(c.a) - e.x * sin(c.a)) AS v0, max(e.y * cos(c.a) - e.x * sin(c.a)) AS v1 FROM corners c JOIN edges e ON e.mask_id = c.mask_id WHERE c.n >= 3 GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY mask_id ORDER BY floor((u1 - u0) * (v1 - v0) * 1e6 + 0.5), CASE WHEN a <= -pi() / 2 THEN a + 2 * pi() ELSE a END) AS k FROM across),
 least_rect AS (SELECT mask_id, (u0 + u1) / 2 * cos(a) - (v0 + v1) / 2 * sin(a) AS cx, (u0 + u1) / 2 * sin(a) + (v0 + v1) / 2 * cos(a) AS cy, u1 - u0 AS du, v1 - v0 AS dv, degrees(a) AS deg, greatest(ceil((abs(degrees(a)) - 45) / 90), 0)::int AS turns FROM ranked WHERE k = 1),
 rect AS (SELECT mask_id, cx, cy, CASE WHEN turns % 2 = 1 THEN dv ELSE du END AS w, CASE WHEN turns % 2 = 1 THEN du ELSE dv END AS h, deg - sign(deg) * 90 * turns AS angle FROM least_rect)"""
_TIDY_RECT = ", ".join(f"{T6.format(c)} AS {c}" for c in ("cx", "cy", "w", "h", "angle"))


@query("dt7_candidate_from_mask", f"""WITH {_GRID}, {_CLOSED}, closed AS (SELECT mask_id, y, x FROM shut WHERE v = 1), {_HULL.replace("mask_cells", "closed")}, {_RECT}
 SELECT rect.mask_id, {_TIDY_RECT} FROM rect JOIN (SELECT mask_id, count(*) AS n FROM closed GROUP BY 1) c ON c.mask_id = rect.mask_id WHERE n / 64.0 > 0.015 AND n / 64.0 < 0.92 AND least(w, h) >= 2 AND greatest(w / h, h / w) < 8 AND n / ((w + 1) * (h + 1)) >= 0.82""")
def _(v):
    """Masks closed by one cell, with a share and rectangle a document could have."""
    r = masks.candidates_from_masks(v("mask_cells"), SIZE)
    return r.select("mask_id", *(tidy(c).alias(c) for c in ("cx", "cy", "w", "h", "angle")))


@query("ra26_boundary_edges", """SELECT c.mask_id, c.y, c.x, d.side FROM mask_cells c, (VALUES ('top', -1, 0), ('right', 0, 1), ('bottom', 1, 0), ('left', 0, -1)) d(side, dy, dx)
 WHERE NOT EXISTS (SELECT 1 FROM mask_cells o WHERE o.mask_id = c.mask_id AND o.y = c.y + d.dy AND o.x = c.x + d.dx)""")
def _(v):
    return masks.boundary_edges(v("mask_cells"))


_PARTS = """r AS (SELECT mask_id, y, x, y * 8 + x AS label FROM mask_cells UNION SELECT c.mask_id, c.y, c.x, r.label FROM r JOIN mask_cells c ON c.mask_id = r.mask_id AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1),
 l AS (SELECT mask_id, y, x, min(label) AS label FROM r GROUP BY ALL), labelled AS (SELECT mask_id, y, x, dense_rank() OVER (PARTITION BY mask_id ORDER BY label)::int AS label FROM l)"""


@query("ra11_connected_components", f"WITH RECURSIVE {_PARTS} SELECT * FROM labelled")
def _(v):
    checkpointed(v.spark)
    return parts.connected_components(v("mask_cells"), SIZE)


_RECTS = "rects AS (SELECT l_orderkey * 10 + cand_id AS rect_id, (pk % m.n) AS scan_id, pk % 5 / 10.0::double AS x0, sk % 4 / 10.0::double AS y0, 0.6 + pk % 4 / 10.0::double AS x1, 0.5 + sk % 5 / 10.0::double AS y1 FROM lines, (SELECT count(*) AS n FROM embeddings) m)"


def rects(v):
    n, pk, sk = v("embeddings").count(), F.col("pk"), F.col("sk")
    return v("lines").select((F.col("l_orderkey") * 10 + F.col("cand_id")).alias("rect_id"), (pk % n).alias("scan_id"), (pk % 5 / 10.0).alias("x0"), (sk % 4 / 10.0).alias("y0"), (0.6 + pk % 4 / 10.0).alias("x1"), (0.5 + sk % 5 / 10.0).alias("y1"))


_CUT = "floor(greatest(x0, 0) * 8) AS a, floor(least(x1, 1) * 8) AS b, floor(greatest(y0, 0) * 8) AS c, floor(least(y1, 1) * 8) AS d"


@query("ra14_print_density", f"""WITH {_RECTS}, k AS (SELECT *, {_CUT} FROM rects), h AS (SELECT rect_id, avg((p.v = 1)::int) AS density FROM k JOIN print_cells p ON p.scan_id = k.scan_id AND p.x >= a AND p.x < b AND p.y >= c AND p.y < d AND p.v <> 2
 WHERE b - a >= 2 AND d - c >= 2 GROUP BY rect_id HAVING count(*) >= 20) SELECT r.rect_id, h.density FROM rects r LEFT JOIN h ON h.rect_id = r.rect_id""")
def _(v):
    return masks.print_density(rects(v), v("print_cells"), SIZE)


@query("ra15_mask_print_density", """SELECT m.mask_id, CASE WHEN count(p.v) > 50 THEN avg((p.v = 1)::int) ELSE 0 END::double AS density FROM mask_cells m
 LEFT JOIN print_cells p ON p.scan_id = m.mask_id AND p.y = m.y AND p.x = m.x AND p.v <> 2 GROUP BY m.mask_id""")
def _(v):
    return masks.mask_print_density(v("mask_cells"), v("print_cells").withColumnRenamed("scan_id", "mask_id"))


_STRIPS = """strips AS (SELECT mask_id AS box_id, s.k, CASE s.k WHEN 2 THEN x0 - (0.012 + 0.01 * w) - 0.15 * h WHEN 3 THEN x1 + 0.012 + 0.01 * w ELSE x0 END AS x0, CASE s.k WHEN 0 THEN y0 - (0.012 + 0.01 * h) - 0.15 * w WHEN 1 THEN y1 + (0.012 + 0.01 * h) ELSE y0 END AS y0,
 CASE s.k WHEN 2 THEN x0 - (0.012 + 0.01 * w) WHEN 3 THEN x1 + (0.012 + 0.01 * w) + 0.15 * h ELSE x1 END AS x1, CASE s.k WHEN 0 THEN y0 - (0.012 + 0.01 * h) WHEN 1 THEN y1 + (0.012 + 0.01 * h) + 0.15 * w ELSE y1 END AS y1
 FROM (SELECT mask_id, 0.25::double AS x0, 0.25::double AS y0, 1.0 + mask_id % 3::double AS x1, 1.0 + mask_id % 4::double AS y1, 0.75 + mask_id % 3::double AS w, 0.75 + mask_id % 4::double AS h FROM masks), range(4) s(k))"""


@query("ra16_continues_beyond", f"""WITH {_STRIPS}, k AS (SELECT box_id, k, {_CUT} FROM strips), h AS (SELECT box_id, k.k, avg((p.v = 1)::int) AS density FROM k JOIN print_cells p ON p.scan_id = k.box_id AND p.x >= a AND p.x < b AND p.y >= c AND p.y < d AND p.v <> 2
 WHERE b - a >= 2 AND d - c >= 2 GROUP BY ALL HAVING count(*) >= 20) SELECT s.box_id, coalesce(max(h.density), 0) > 0.02 AS beyond FROM strips s LEFT JOIN h ON h.box_id = s.box_id AND h.k = s.k GROUP BY s.box_id""")
def _(v):
    """Boxes far wider than the frame, so that their strips hold enough of eight-cell masks."""
    k = F.col("mask_id")
    b = v("masks").select(k.alias("box_id"), k.alias("scan_id"), F.lit(0.25).alias("x0"), F.lit(0.25).alias("y0"), (1.0 + k % 3).alias("x1"), (1.0 + k % 4).alias("y1"))
    return masks.continues_beyond(b, v("print_cells"), SIZE)


@query("dt14_classic_objects", f"""WITH RECURSIVE {_PARTS}, pieces AS (SELECT mask_id * 64 + label AS mask_id, y, x FROM labelled), {_HULL.replace("mask_cells", "pieces")}, {_FILLED}, {_RECT},
 scored AS (SELECT rect.*, n, n / ((w + 1) * (h + 1)) AS score FROM rect JOIN (SELECT mask_id, count(*) AS n FROM filled GROUP BY 1) f ON f.mask_id = rect.mask_id),
 listed AS (SELECT mask_id // 64 AS mask_id, mask_id % 64 AS label, {_TIDY_RECT}, {T6.format("score")} AS score, row_number() OVER (PARTITION BY mask_id // 64 ORDER BY n DESC, mask_id) AS k FROM scored WHERE n >= 0.015 * 64 AND score >= 0.5)
 SELECT * EXCLUDE (k) FROM listed WHERE k <= 16""")
def _(v):
    checkpointed(v.spark)
    r = masks.classic_objects(parts.connected_components(v("mask_cells"), SIZE), SIZE, rectangular=0.5)
    return r.select("mask_id", "label", *(tidy(c).alias(c) for c in ("cx", "cy", "w", "h", "angle", "score")))


@query("dt3_outline_quad", """SELECT mask_id, min(x)::double AS x0, min(y)::double AS y0, (max(x) + 1)::double AS x1, min(y)::double AS y1, (max(x) + 1)::double AS x2, (max(y) + 1)::double AS y2, min(x)::double AS x3, (max(y) + 1)::double AS y3 FROM mask_cells GROUP BY mask_id""")
def _(v):
    """Masks of eight cells have too few points for a tilted side, so every outline is the box."""
    return masks.outline_quad(v("mask_cells"), SIZE)
