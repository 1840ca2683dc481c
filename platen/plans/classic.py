"""Queries on the detection without a model: the text of each document as a colour image of 80 columns, its last row left out where it is short."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from platen.functions.expr import tidy
from platen.operators import classic, parts
from platen.plans.register import query
from platen.sources.checkpoints import checkpointed

WIDTH = 80
#: Kernels for such small frames.
SMALL = {"blur": 5, "close": 7, "open_": 5}


def frames(v):
    height = F.floor(F.length("text") / WIDTH).cast("int")
    return v("documents").select(F.col("doc_id").alias("scan_id"), F.lit(WIDTH).alias("width"), height.alias("height")).where("height >= 1")


def colours(v):
    """As runs; what is beyond a frame stays, as operators leave it out."""
    return classic.coloured(v("pixel_runs"), lambda k, x: (k, np.where(x % 40 < 25, k, k * 7 % 256), k))


def _taps(out: str, source: str, axis: str, weights: dict[int, int], *columns: str) -> str:
    """A pass of weighted sums along an axis, mirrored at the frame's border. Columns are 'name = source column'."""
    n, other = ("80", "y") if axis == "x" else ("a.h", "x")
    place = f"(CASE WHEN {n} = 1 THEN 0 ELSE ({n} - 1) - abs(({n} - 1) - (((a.{axis} + k.k) % greatest(2 * ({n} - 1), 1) + 2 * ({n} - 1)) % greatest(2 * ({n} - 1), 1))) END)"
    taps = ", ".join(f"({k}, {w})" for k, w in weights.items())
    kept = ", ".join(f"sum(a.w * b.{c.split(' = ')[1]})::bigint AS {c.split(' = ')[0]}" for c in columns)
    return f"{out} AS (SELECT a.scan_id, a.h, a.y, a.x, {kept} FROM (SELECT a.*, k.w, {place} AS place FROM {source} a, (VALUES {taps}) k(k, w)) a JOIN {source} b ON b.scan_id = a.scan_id AND b.{other} = a.{other} AND b.{axis} = a.place GROUP BY ALL)"


_FIVE, _ONE, _EDGE, _BOX = {-2: 1, -1: 4, 0: 6, 1: 4, 2: 1}, {-1: 1, 0: 2, 1: 1}, {-1: -1, 1: 1}, {k: 1 for k in range(-2, 3)}
_SLOPES = f"""f AS (SELECT scan_id, (count(*) // 80)::int AS h FROM pixels GROUP BY 1 HAVING count(*) >= 80),
 rgb AS (SELECT p.scan_id, f.h, y, x, v AS r, CASE WHEN x % 40 < 25 THEN v ELSE v * 7 % 256 END AS g, v AS b FROM pixels p JOIN f ON f.scan_id = p.scan_id WHERE y < h),
 grey AS (SELECT scan_id, h, y, x, (4899 * r + 9617 * g + 1868 * b + 8192)::int >> 14 AS v, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE floor((greatest(r, g, b) - least(r, g, b)) * 255.0::double / greatest(r, g, b) + 0.5)::int END AS s FROM rgb),
 {_taps('soft1', 'grey', 'x', _FIVE, 'v = v')}, {_taps('soft2', 'soft1', 'y', _FIVE, 'v = v')}, soft AS (SELECT scan_id, h, y, x, (v + 128)::int >> 8 AS v FROM soft2),
 {_taps('sm', 'soft', 'y', _ONE, 'v = v')}, {_taps('ch', 'soft', 'y', _EDGE, 'v = v')}, {_taps('gx', 'sm', 'x', _EDGE, 'v = v')}, {_taps('gy', 'ch', 'x', _ONE, 'v = v')},
 slopes AS (SELECT g.scan_id, g.h, g.y, g.x, abs(a.v) AS gx, abs(b.v) AS gy, g.s FROM grey g JOIN gx a ON a.scan_id = g.scan_id AND a.y = g.y AND a.x = g.x JOIN gy b ON b.scan_id = g.scan_id AND b.y = g.y AND b.x = g.x)"""
_SCORES = f"""e0 AS (SELECT scan_id, h, y, x, gx + gy AS e, s FROM slopes), {_taps('e1', 'e0', 'x', _BOX, 'e = e', 's = s')}, {_taps('e2', 'e1', 'y', _BOX, 'e = e', 's = s')},
 ends AS (SELECT scan_id, min(e) AS e0, max(e) AS e1, min(s) AS s0, max(s) AS s1 FROM e2 GROUP BY 1),
 scores AS (SELECT e2.scan_id, h, y, x, coalesce((e - e0) * 255.0::double / nullif(e1 - e0, 0), 0) + coalesce((s - s0) * 255.0::double / nullif(s1 - s0, 0), 0) AS score FROM e2 JOIN ends ON ends.scan_id = e2.scan_id),
 cuts AS (SELECT scan_id, list_sort(list(score))[floor(0.55::double * (count(*) - 1))::bigint + 1] AS cut FROM scores GROUP BY 1)"""


def _spread(out: str, source: str, axis: str, r: int, f: str) -> str:
    other = "y" if axis == "x" else "x"
    return f"{out} AS (SELECT scan_id, h, y, x, {f}(v) OVER (PARTITION BY scan_id, {other} ORDER BY {axis} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM {source})"


_STEPS = [(a, r, f) for r, f in ((3, "max"), (3, "min"), (2, "min"), (2, "max")) for a in "xy"]
_MASK = "m0 AS (SELECT s.scan_id, h, y, x, (score > cut)::int AS v FROM scores s JOIN cuts c ON c.scan_id = s.scan_id), " + ", ".join(_spread(f"m{k + 1}", f"m{k}", a, r, f) for k, (a, r, f) in enumerate(_STEPS))
_PARTS = """runs AS (SELECT scan_id, y, min(x) AS a, max(x) AS b, scan_id * 100000000 + y * 80 + min(x) AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY scan_id, y ORDER BY x) AS g FROM m8 WHERE v = 1) GROUP BY scan_id, y, g),
 touch AS (SELECT p.id AS u, q.id AS v FROM runs p JOIN runs q ON q.scan_id = p.scan_id AND q.y = p.y + 1 AND q.a <= p.b + 1 AND q.b >= p.a - 1), links AS (SELECT u, v FROM touch UNION ALL SELECT v, u FROM touch),
 cc(id, label) USING KEY (id) AS (SELECT id, id FROM runs UNION SELECT l.u, min(n.label) FROM cc n JOIN links l ON l.v = n.id JOIN recurring.cc o ON o.id = l.u WHERE n.label < o.label GROUP BY l.u),
 areas AS (SELECT scan_id, label, min(a) AS l, max(b) AS r, min(y) AS t, max(y) AS d, sum(b - a + 1) AS n FROM runs JOIN cc ON cc.id = runs.id GROUP BY ALL),
 tops AS (SELECT scan_id, first(l ORDER BY n DESC, label) AS l, first(r ORDER BY n DESC, label) AS r, first(t ORDER BY n DESC, label) AS t, first(d ORDER BY n DESC, label) AS d FROM areas GROUP BY 1),
 boxes AS (SELECT f.scan_id, h, coalesce((r - l + 1) * (d - t + 1) > 0.15::double * 80 * h, false) AS found, floor(0.004::double * greatest(80, h)) AS pad, l, r, t, d FROM f LEFT JOIN tops ON tops.scan_id = f.scan_id),
 shares AS (SELECT scan_id, h, found, CASE WHEN found THEN greatest(0, (l - pad) / 80.0::double) ELSE 0.02 END AS x0, CASE WHEN found THEN greatest(0, (t - pad) / h::double) ELSE 0.02 END AS y0,
  CASE WHEN found THEN least(1, (l + (r - l + 1) + pad) / 80.0::double) ELSE 0.98 END AS x1, CASE WHEN found THEN least(1, (t + (d - t + 1) + pad) / h::double) ELSE 0.98 END AS y1 FROM boxes)"""
_SNAP = """px AS (SELECT *, floor(x0 * 80)::int AS "left", floor(y0 * h)::int AS top, floor(x1 * 80)::int AS "right", floor(y1 * h)::int AS bottom FROM shares),
 prof AS (SELECT s.scan_id, 'x' AS axis, s.x AS pos, avg(gx) AS p FROM slopes s JOIN px ON px.scan_id = s.scan_id WHERE s.y >= top + floor((bottom - top) / 4) AND s.y < bottom - floor((bottom - top) / 4) GROUP BY ALL
  UNION ALL SELECT s.scan_id, 'y', s.y, avg(gy) FROM slopes s JOIN px ON px.scan_id = s.scan_id WHERE s.x >= "left" + floor(("right" - "left") / 4) AND s.x < "right" - floor(("right" - "left") / 4) GROUP BY ALL),
 med AS (SELECT scan_id, axis, CASE WHEN median(p) = 0 THEN 1 ELSE median(p) END AS m FROM prof GROUP BY ALL),
 sides AS (SELECT scan_id, 'left' AS side, 'x' AS axis, "left" AS c, 80 AS n, -1 AS sg FROM px UNION ALL SELECT scan_id, 'top', 'y', top, h, -1 FROM px UNION ALL SELECT scan_id, 'right', 'x', "right", 80, 1 FROM px UNION ALL SELECT scan_id, 'bottom', 'y', bottom, h, 1 FROM px),
 spans AS (SELECT *, greatest(0, c - CASE WHEN sg < 0 THEN floor(n * 0.06::double) ELSE floor(floor(n * 0.06::double) * 0.2::double) END) AS low, least(n, c + CASE WHEN sg < 0 THEN floor(floor(n * 0.06::double) * 0.2::double) ELSE floor(n * 0.06::double) END) AS high FROM sides),
 near AS (SELECT s.scan_id, s.axis, s.side, first(r.pos ORDER BY p DESC, r.pos) AS pos, max(p) AS p FROM spans s JOIN prof r ON r.scan_id = s.scan_id AND r.axis = s.axis WHERE high - low >= 5 AND r.pos >= low AND r.pos < high GROUP BY ALL),
 hit AS (SELECT near.scan_id, side, pos FROM near JOIN med ON med.scan_id = near.scan_id AND med.axis = near.axis WHERE p > m * 4),
 moved AS (SELECT px.*, coalesce((SELECT pos FROM hit WHERE hit.scan_id = px.scan_id AND side = 'left'), "left") AS l2, coalesce((SELECT pos FROM hit WHERE hit.scan_id = px.scan_id AND side = 'top'), top) AS t2,
  coalesce((SELECT pos FROM hit WHERE hit.scan_id = px.scan_id AND side = 'right'), "right") AS r2, coalesce((SELECT pos FROM hit WHERE hit.scan_id = px.scan_id AND side = 'bottom'), bottom) AS b2 FROM px),
 done AS (SELECT *, r2 - l2 < 80 * 0.2::double OR b2 - t2 < h * 0.2::double AS small FROM moved)"""
_T6 = "floor(({}) * 1e6 + 0.5) / 1e6"


@query("ra7_classic_mask", f"WITH {_SLOPES}, {_SCORES}, {_MASK} SELECT scan_id, y, x FROM m8 WHERE v = 1")
def _(v):
    return classic.whole_mask(colours(v), frames(v), **SMALL)


@query("ra7_detect_classic", f"""WITH RECURSIVE {_SLOPES}, {_SCORES}, {_MASK}, {_PARTS}, {_SNAP} SELECT scan_id, {_T6.format('CASE WHEN small THEN x0 ELSE l2 / 80.0::double END')} AS x0, {_T6.format('CASE WHEN small THEN y0 ELSE t2 / h::double END')} AS y0,
 {_T6.format('CASE WHEN small THEN x1 ELSE least(1, r2 / 80.0::double) END')} AS x1, {_T6.format('CASE WHEN small THEN y1 ELSE least(1, b2 / h::double) END')} AS y1, found FROM done""")
def _(v):
    d = classic.detect_classic(colours(v), frames(v), **SMALL)
    return d.select("scan_id", *(tidy(c).alias(c) for c in ("x0", "y0", "x1", "y1")), "found")


@query("ra11_component_boxes", """WITH RECURSIVE r AS (SELECT mask_id, y, x, y * 8 + x AS label FROM mask_cells UNION SELECT c.mask_id, c.y, c.x, r.label FROM r JOIN mask_cells c ON c.mask_id = r.mask_id AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1),
 l AS (SELECT mask_id, y, x, min(label) AS label FROM r GROUP BY ALL) SELECT mask_id, row_number() OVER (PARTITION BY mask_id ORDER BY label)::int AS label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, floor(avg(x) * 1e6 + 0.5) / 1e6 AS cx, floor(avg(y) * 1e6 + 0.5) / 1e6 AS cy FROM l GROUP BY mask_id, l.label""")
def _(v):
    checkpointed(v.spark)
    return parts.component_boxes(v("mask_cells"), 8).withColumns({"cx": tidy("cx"), "cy": tidy("cy")})
