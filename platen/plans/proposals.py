"""Queries on model proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from platen.functions.expr import tidy
from platen.operators import masks, proposals, scale
from platen.plans.register import query

_SIDE = "greatest(0, least({a}.{c} + {a}.{s} / 2, {b}.{c} + {b}.{s} / 2) - greatest({a}.{c} - {a}.{s} / 2, {b}.{c} - {b}.{s} / 2))"


def inter(a, b):
    return f"({_SIDE.format(a=a, b=b, c='cx', s='w')} * {_SIDE.format(a=a, b=b, c='cy', s='h')})"


def iou(a, b):
    return f"({inter(a, b)} / ({a}.w * {a}.h + {b}.w * {b}.h - {inter(a, b)}))"


def inside(a, b):
    return f"({inter(a, b)} / least({a}.w * {a}.h, {b}.w * {b}.h))"


T9 = "floor(({}) * 1e9 + 0.5) / 1e9"


def fold_sql(source: str, order: str, joins: str) -> str:
    """CTE `grouped` (scan_id, cand_id, group_no, k): the greedy groups by recursion over each scan's candidates."""
    prim = "{'cx': cx, 'cy': cy, 'w': w, 'h': h}"
    new = prim.replace(": ", ": i.")
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {order}) AS k FROM {source}),
 f AS (SELECT scan_id, cand_id, k, [{prim}] AS firsts, 0 AS group_no FROM o WHERE k = 1 UNION ALL
 SELECT i.scan_id, i.cand_id, i.k, CASE WHEN list_position(list_transform(f.firsts, lambda p: {joins}), true) > 0 THEN f.firsts ELSE list_append(f.firsts, {new}) END,
 CASE WHEN list_position(list_transform(f.firsts, lambda p: {joins}), true) > 0 THEN list_position(list_transform(f.firsts, lambda p: {joins}), true) - 1 ELSE len(f.firsts) END
 FROM f JOIN o i ON i.scan_id = f.scan_id AND i.k = f.k + 1),
 grouped AS (SELECT scan_id, cand_id, group_no::int AS group_no, (row_number() OVER (PARTITION BY scan_id, group_no ORDER BY k) - 1)::int AS rank FROM f)"""


_GROUPS = fold_sql("(SELECT * FROM candidates WHERE score >= 0.8)", "score DESC, w * h DESC, cand_id", f"{iou('p', 'i')} > 0.45 OR {inside('p', 'i')} > 0.75")


@query("dt8_score_filter", "SELECT scan_id, cand_id, score FROM candidates WHERE score >= 0.8")
def _(v):
    return proposals.score_filter(v("candidates")).select("scan_id", "cand_id", "score")


@query("dt9_iou_containment", f"""SELECT a.scan_id, a.cand_id AS a, b.cand_id AS b, {T9.format(iou('a', 'b'))} AS iou, {T9.format(inside('a', 'b'))} AS containment FROM candidates a JOIN candidates b
 ON a.scan_id = b.scan_id AND a.cand_id < b.cand_id AND abs(a.cx - b.cx) < (a.w + b.w) / 2 AND abs(a.cy - b.cy) < (a.h + b.h) / 2""")
def _(v):
    return proposals.overlap_pairs(v("candidates")).withColumn("iou", tidy("iou", 9)).withColumn("containment", tidy("containment", 9))


def groups(v):
    return proposals.group_candidates(proposals.score_filter(v("candidates")))


_MM = "floor(({}) * 10 + 0.5) / 10"


@query("gr1_group_candidates", f"""WITH RECURSIVE {_GROUPS} SELECT g.scan_id, g.cand_id, g.group_no, g.rank, c.score, {_MM.format('c.w * 210')} AS w_mm, {_MM.format('c.h * 297')} AS h_mm
 FROM grouped g JOIN candidates c ON c.scan_id = g.scan_id AND c.cand_id = g.cand_id""")
def _(v):
    """The flagship: proposals filtered, grouped by overlap, and measured on an A4 frame."""
    sized = v("candidates").select("scan_id", "cand_id", "score", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("w").alias("x1"), F.col("h").alias("y1"), F.lit(210).alias("width_px"), F.lit(297).alias("height_px"), F.lit(1.0).alias("mm_per_px"))
    return groups(v).join(scale.measure_box(sized), ["scan_id", "cand_id"]).select("scan_id", "cand_id", "group_no", "rank", "score", "w_mm", "h_mm")


@query("gr2_dedupe", f"WITH RECURSIVE {_GROUPS} SELECT scan_id, cand_id, group_no FROM grouped WHERE rank = 0")
def _(v):
    return groups(v).where("rank = 0").select("scan_id", "cand_id", "group_no")


@query("gr3_cap_groups", f"WITH RECURSIVE {_GROUPS} SELECT scan_id, count(*) AS members FROM grouped WHERE group_no < 16 GROUP BY scan_id")
def _(v):
    return groups(v).where(F.col("group_no") < proposals.MOST_GROUPS).groupBy("scan_id").agg(F.count("*").alias("members"))


_ALT = "alts AS (SELECT scan_id, group_no, list(cand_id ORDER BY rank) AS ids FROM grouped GROUP BY ALL)"


@query("gr4_alternatives", f"WITH RECURSIVE {_GROUPS}, {_ALT} SELECT scan_id, group_no, ids[1] AS primary_id, ids[2:4] AS choices FROM alts")
def _(v):
    return proposals.alternatives(groups(v))


@query("gr5_choose_alternative", f"""WITH RECURSIVE {_GROUPS}, {_ALT}, k AS (SELECT *, 1 + scan_id % 3 AS c, ids[2:] AS rest FROM alts) SELECT scan_id, group_no, CASE WHEN c <= len(rest) THEN rest[c] ELSE ids[1] END AS primary_id,
 list_transform(rest, lambda x, i: CASE WHEN i = c THEN ids[1] ELSE x END) AS choices FROM k""")
def _(v):
    return proposals.choose_alternative(proposals.alternatives(groups(v), None), 1 + F.col("scan_id") % 3)


@query("gr5b_cycle_alternatives", f"WITH RECURSIVE {_GROUPS}, {_ALT} SELECT scan_id, group_no, coalesce(ids[2], ids[1]) AS primary_id, CASE WHEN len(ids) > 1 THEN list_append(ids[3:], ids[1]) ELSE ids[2:] END AS choices FROM alts")
def _(v):
    return proposals.cycle_alternatives(proposals.alternatives(groups(v), None))


_MERGED = """merged AS (SELECT scan_id AS merge_id, count(*) AS n, min(cx - w / 2) AS x0, max(cx + w / 2) AS x1, min(cy - h / 2) AS y0, max(cy + h / 2) AS y1, min(score) AS score, list(cand_id ORDER BY cand_id) AS parts
 FROM candidates WHERE score >= 0.8 GROUP BY scan_id HAVING count(*) >= 2)"""


def merges(v):
    return proposals.merge_bounds(proposals.score_filter(v("candidates")).withColumnRenamed("scan_id", "merge_id"))


@query("gr6_merge_bounds", f"WITH {_MERGED} SELECT merge_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x1 - x0 AS w, y1 - y0 AS h, score, len(parts) AS parts FROM merged")
def _(v):
    return merges(v).withColumn("parts", F.size("parts").cast("long"))


@query("gr7_undo_merge", f"WITH {_MERGED} SELECT merge_id, (generate_subscripts(parts, 1) - 1)::int AS position, unnest(parts) AS cand_id FROM merged")
def _(v):
    return proposals.undo_merge(merges(v))


_RECT = "(cand_id * 7 + scan_id * 3) % 20 / 20.0::double"
_VOTES = fold_sql("candidates", "cand_id", f"{iou('p', 'i')} >= 0.8")


@query("gr11_vote_groups", f"""WITH RECURSIVE {_VOTES}, m AS (SELECT g.*, c.w * c.h AS area, {_RECT.replace('cand_id', 'c.cand_id').replace('scan_id', 'c.scan_id')} AS rect, c.score FROM grouped g JOIN candidates c ON c.scan_id = g.scan_id AND c.cand_id = g.cand_id),
 s AS (SELECT scan_id, group_no, count(*) AS members, max(CASE WHEN rank = 0 THEN area END) AS seed_area, first(cand_id ORDER BY rect DESC, score DESC, cand_id) AS winner FROM m GROUP BY ALL)
 SELECT scan_id, first(winner ORDER BY members DESC, seed_area DESC, group_no) AS winner, max(members) AS members FROM s GROUP BY scan_id""")
def _(v):
    return proposals.vote_groups(v("candidates").withColumn("rectangularity", (F.col("cand_id") * 7 + F.col("scan_id") * 3) % 20 / 20.0))


@query("gr13_tight_shot", "SELECT scan_id, cand_id, CASE WHEN cand_id % 3 = 0 AND w * h < 0.06 THEN 'frame' ELSE 'vote' END AS method FROM candidates")
def _(v):
    w = v("candidates").withColumn("four_sided", F.col("cand_id") % 3 == 0).withColumn("winner_area", F.col("w") * F.col("h"))
    return proposals.tight_shot(w).select("scan_id", "cand_id", "method")


@query("gr15_nearest_size_match", """WITH e AS (SELECT l_orderkey AS scan_id, cand_id AS item, (20 + pk % 50) / 100.0::double AS ew, (20 + sk % 40) / 100.0::double AS eh FROM lines),
 j AS (SELECT e.*, c.cand_id, abs(greatest(ew, eh) - greatest(w, h)) + abs(least(ew, eh) - least(w, h)) AS off FROM e JOIN candidates c ON c.scan_id = e.scan_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, item ORDER BY off, cand_id) AS k FROM j) SELECT scan_id, item, cand_id, floor(off * 1e9 + 0.5) / 1e9 AS off FROM r WHERE k = 1""")
def _(v):
    e = v("lines").select(F.col("l_orderkey").alias("scan_id"), F.col("cand_id").cast("long").alias("item"), ((20 + F.col("pk") % 50) / 100.0).alias("ew"), ((20 + F.col("sk") % 40) / 100.0).alias("eh"))
    return proposals.nearest_size(e, v("candidates")).withColumn("off", tidy("off", 9))


_CLASSES = [("page", 80.0, 140.0, 60.0, 100.0), ("sleeve", 100.0, 180.0, 80.0, 150.0), ("false-spread", 150.0, 400.0, 40.0, 90.0)]


@query("gr16_size_class", "WITH s AS (SELECT greatest(w * 210, h * 297) AS l, least(w * 210, h * 297) AS s FROM candidates), c AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, a, b, c, d in _CLASSES) + ") AS t(class, a, b, c, d)) SELECT class, count(*) AS n FROM s JOIN c ON l BETWEEN a AND b AND s.s BETWEEN c.c AND d GROUP BY class")
def _(v):
    w, h = F.col("w") * 210, F.col("h") * 297
    classes = v.spark.createDataFrame(_CLASSES, "class string, long_low double, long_high double, short_low double, short_high double")
    return proposals.size_class(v("candidates").select(F.greatest(w, h).alias("long_mm"), F.least(w, h).alias("short_mm")), classes)


@query("dt12_engine_fallback", """WITH m AS (SELECT * FROM candidates WHERE score >= 0.9) SELECT scan_id, cand_id, 'model' AS engine FROM m UNION ALL
 SELECT scan_id, cand_id, 'classic' FROM candidates WHERE score < 0.9 AND scan_id NOT IN (SELECT scan_id FROM m)""")
def _(v):
    c = v("candidates").select("scan_id", "cand_id", "score")
    return proposals.engine_fallback(c.where("score >= 0.9"), c.where("score < 0.9")).drop("score")


@query("dt13_hit_test", """WITH p AS (SELECT l_orderkey AS scan_id, l_orderkey * 100 + cand_id AS point_id, (pk % 100) / 100.0::double AS px, (sk * 7 % 100) / 100.0::double AS py FROM lines)
 SELECT p.point_id, min(c.cand_id) AS cand_id FROM p LEFT JOIN candidates c ON c.scan_id = p.scan_id AND abs(px - cx) <= w / 2 * 1.05::double AND abs(py - cy) <= h / 2 * 1.05::double GROUP BY p.point_id""")
def _(v):
    p = v("lines").select(F.col("l_orderkey").alias("scan_id"), (F.col("l_orderkey") * 100 + F.col("cand_id")).alias("point_id"), (F.col("pk") % 100 / 100.0).alias("px"), (F.col("sk") * 7 % 100 / 100.0).alias("py"))
    return proposals.hit_test(p, v("candidates"))


@query("dt15_best_of_prompt", "SELECT scan_id, first(mask_id ORDER BY score DESC, prompt_id) AS mask_id, max(score) AS score FROM masks GROUP BY scan_id")
def _(v):
    return proposals.best_of_prompt(v("masks"))


_SHAPES = """shapes AS (SELECT m.scan_id, m.mask_id, m.score, s.area, s.rect >= 0.5 AND s.area <= 0.5 AS document_like, s.rect >= 0.5 AS whole_like FROM masks m
 JOIN (SELECT mask_id, count(*) / 64.0::double AS area, count(*)::double / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)) AS rect FROM mask_cells GROUP BY 1 HAVING count(*) / 64.0 >= 0.02) s ON s.mask_id = m.mask_id)"""


def shapes(v):
    """Random masks fill about half of their boxes, so the bars are lower here than for real ones."""
    s = masks.mask_shape(v("mask_cells"), 8).select("mask_id", "area", "rectangularity")
    return v("masks").join(s, "mask_id").select("scan_id", "mask_id", "score", "area", ((F.col("rectangularity") >= 0.5) & (F.col("area") <= 0.5)).alias("document_like"), (F.col("rectangularity") >= 0.5).alias("whole_like"))


_CLEAN = """clean AS (SELECT scan_id, mask_id FROM (SELECT scan_id, first(document_like ORDER BY score DESC, mask_id) AS likes, first(mask_id ORDER BY area DESC, mask_id) FILTER (WHERE whole_like) AS mask_id FROM shapes GROUP BY scan_id)
 WHERE NOT likes AND mask_id IS NOT NULL)"""


@query("gr10_clean_rectangle", f"WITH {_SHAPES}, {_CLEAN} SELECT * FROM clean")
def _(v):
    return proposals.clean_rectangle(shapes(v))


_RING = """best AS (SELECT scan_id, first(mask_id ORDER BY score DESC, mask_id) AS best_id, first(area ORDER BY score DESC, mask_id) AS best_area FROM shapes GROUP BY 1),
 grown AS (SELECT DISTINCT b.scan_id, c.y + dy.d - 1 AS y, c.x + dx.d - 1 AS x FROM best b JOIN mask_cells c ON c.mask_id = b.best_id, range(3) dy(d), range(3) dx(d)),
 ring AS (SELECT s.scan_id, s.mask_id, avg((p.v = 1)::int) AS density FROM shapes s JOIN best b ON b.scan_id = s.scan_id AND s.mask_id <> b.best_id AND s.area >= 1.04 * b.best_area AND s.whole_like
 JOIN mask_cells c ON c.mask_id = s.mask_id JOIN print_cells p ON p.scan_id = s.scan_id AND p.y = c.y AND p.x = c.x AND p.v <> 2
 WHERE NOT EXISTS (SELECT 1 FROM grown g WHERE g.scan_id = s.scan_id AND g.y = c.y AND g.x = c.x) GROUP BY ALL)"""


def rings(v):
    s = shapes(v)
    best = s.groupBy("scan_id").agg(F.max_by(F.struct("mask_id", "area"), F.struct("score", -F.col("mask_id"))).alias("b")).select("scan_id", F.col("b.mask_id").alias("best_id"), F.col("b.area").alias("best_area"))
    larger = s.join(best, "scan_id").where("mask_id != best_id AND area >= 1.04 * best_area AND whole_like").select("scan_id", "mask_id")
    of = v("mask_cells").join(best.select("scan_id", F.col("best_id").alias("mask_id")), "mask_id")
    return masks.ring_gain(of, v("mask_cells").join(larger, "mask_id"), v("print_cells"), 8)


@query("gr9_ring_gain", f"WITH {_SHAPES}, {_RING} SELECT * FROM ring")
def _(v):
    return rings(v)


_BOXED = "boxed AS (SELECT scan_id, cand_id, cx - w / 2 AS x0, cy - h / 2 AS y0, cx + w / 2 AS x1, cy + h / 2 AS y1, w * h AS area, score, cand_id % 3 = 0 AS beyond FROM candidates)"
_WHOLE = """win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, cand_id) AS k FROM boxed) WHERE k = 1),
 wholes AS (SELECT w.scan_id, first(c.cand_id ORDER BY c.area DESC, c.cand_id) AS whole_id FROM win w JOIN boxed c ON c.scan_id = w.scan_id AND c.area > 1.15 * w.area AND c.x0 <= w.x0 + 0.01 AND c.y0 <= w.y0 + 0.01 AND c.x1 >= w.x1 - 0.01 AND c.y1 >= w.y1 - 0.01 AND NOT c.beyond GROUP BY 1)"""


def winners(v):
    b = v("candidates").selectExpr("scan_id", "cand_id", "cx - w / 2 AS x0", "cy - h / 2 AS y0", "cx + w / 2 AS x1", "cy + h / 2 AS y1", "w * h AS area", "score", "cand_id % 3 = 0 AS beyond")
    w = b.groupBy("scan_id").agg(F.max_by(F.struct("cand_id", "x0", "y0", "x1", "y1", "area", "beyond"), F.struct("score", -F.col("cand_id"))).alias("b")).select("scan_id", "b.*")
    return w, b


@query("gr12_prefer_whole", f"""WITH {_BOXED}, {_WHOLE} SELECT w.scan_id, CASE WHEN NOT (whole_id IS NULL AND beyond) THEN coalesce(whole_id, cand_id) END AS cand_id, CASE WHEN whole_id IS NULL AND beyond THEN 'page' ELSE 'vote' END AS method
 FROM win w LEFT JOIN wholes h ON h.scan_id = w.scan_id""")
def _(v):
    return proposals.prefer_whole(*winners(v))


@query("gr14_detection_result", f"""WITH {_SHAPES}, {_CLEAN}, {_RING}, frame AS (SELECT scan_id, first(mask_id ORDER BY score DESC, mask_id) AS best_id, first(document_like ORDER BY score DESC, mask_id) AS best_like FROM shapes GROUP BY 1),
 printed AS (SELECT scan_id, min(mask_id) AS ring_id FROM ring WHERE density >= 0.05 GROUP BY 1), vote AS (SELECT scan_id, CASE WHEN scan_id % 4 = 0 THEN NULL ELSE max(mask_id) END AS vote_id FROM shapes WHERE scan_id % 3 = 0 GROUP BY 1)
 SELECT f.scan_id, CASE WHEN best_like THEN coalesce(ring_id, best_id) WHEN c.mask_id IS NOT NULL THEN c.mask_id WHEN v.scan_id IS NOT NULL THEN vote_id ELSE best_id END AS mask_id,
 CASE WHEN best_like OR c.mask_id IS NOT NULL THEN 'frame' WHEN v.scan_id IS NOT NULL THEN CASE WHEN vote_id IS NULL THEN 'page' ELSE 'vote' END ELSE 'frame' END AS method
 FROM frame f LEFT JOIN printed r ON r.scan_id = f.scan_id LEFT JOIN clean c ON c.scan_id = f.scan_id LEFT JOIN vote v ON v.scan_id = f.scan_id""")
def _(v):
    """Every third scan has a vote, every fourth of them for the page."""
    s = shapes(v)
    frame = s.groupBy("scan_id").agg(F.max_by(F.struct("mask_id", "document_like"), F.struct("score", -F.col("mask_id"))).alias("b")).select("scan_id", F.col("b.mask_id").alias("best_id"), F.col("b.document_like").alias("best_like"))
    printed = rings(v).where("density >= 0.05").groupBy("scan_id").agg(F.min("mask_id").alias("mask_id"))
    vote = s.where("scan_id % 3 = 0").groupBy("scan_id").agg(F.max("mask_id").alias("m")).select("scan_id", F.when(F.col("scan_id") % 4 != 0, F.col("m")).alias("mask_id"))
    return proposals.detection_result(frame, printed, proposals.clean_rectangle(s), vote)
