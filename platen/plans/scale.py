"""Queries on scale, measurement, turns and perspective."""

from __future__ import annotations

from pyspark.sql import functions as F

from platen.functions.expr import tidy
from platen.operators import frames, scale
from platen.plans.register import query

R1 = "floor(({}) * 10 + 0.5) / 10"
_OPTICAL = """optical AS (SELECT scan_id, CASE WHEN bbox_w_pt >= 1 AND bbox_h_pt >= 1 THEN least(w / (bbox_w_pt / 72), h / (bbox_h_pt / 72)) END AS optical_dpi
 FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY w * h DESC, image_no) AS k FROM page_images) WHERE k = 1)"""
_WANTED = """wanted AS (SELECT s.scan_id, o.optical_dpi, coalesce(least(greatest(o.optical_dpi, 120), 900), 300.0::double) AS wanted,
 sqrt(36e6 / greatest(page_w_pt / 72 * (page_h_pt / 72), 0.01)) AS budget FROM scans s LEFT JOIN optical o ON o.scan_id = s.scan_id)"""
_DPI = "CASE WHEN header_dpi > 0 AND header_dpi * (CASE WHEN dpi_unit = 3 THEN 2.54::double ELSE 1 END) BETWEEN 30 AND 4800 THEN header_dpi * (CASE WHEN dpi_unit = 3 THEN 2.54::double ELSE 1 END) END"
_SCALED = f"scaled AS (SELECT *, 25.4::double / ({_DPI}) AS mm_per_px, {_DPI} AS dpi FROM scans)"
T6 = "floor(({}) * 1e6 + 0.5) / 1e6"


@query("geo1_optical_dpi", f"WITH {_OPTICAL} SELECT * FROM optical")
def _(v):
    return scale.optical_dpi(v("page_images"))


@query("geo2_render_dpi", f"""WITH {_OPTICAL}, {_WANTED} SELECT scan_id, least(wanted, budget) AS render_dpi,
 concat(CASE WHEN optical_dpi IS NULL THEN 'default' WHEN abs(wanted - optical_dpi) < 1 THEN 'matched' ELSE 'clamped' END, CASE WHEN wanted > budget THEN '+capped' ELSE '' END) AS reason FROM wanted""")
def _(v):
    return scale.render_dpi(v("scans"), scale.optical_dpi(v("page_images")))


@query("geo3_screen_dpi", "SELECT scan_id, least(300.0::double, floor(sqrt(40e6 / greatest(page_w_pt / 72 * (page_h_pt / 72), 1e-6)))) AS dpi FROM scans")
def _(v):
    return scale.screen_dpi(v("scans"))


@query("geo4_raster_dpi", f"SELECT scan_id, {_DPI} AS dpi FROM scans")
def _(v):
    return v("scans").select("scan_id", scale.raster_dpi().alias("dpi"))


@query("geo5_mm_per_px", f"WITH {_SCALED} SELECT scan_id, mm_per_px, {R1.format('page_w_pt / 72 * 25.4::double')} AS page_w_mm, {R1.format('page_h_pt / 72 * 25.4::double')} AS page_h_mm FROM scaled")
def _(v):
    return scale.with_scale(v("scans")).select("scan_id", "mm_per_px", "page_w_mm", "page_h_mm")


@query("geo6_measure_px", f"WITH {_SCALED} SELECT scan_id, {R1.format('width_px * mm_per_px')} AS w_mm, {R1.format('height_px * mm_per_px')} AS h_mm FROM scaled")
def _(v):
    return scale.measured_px(v("scans"))


def boxes(v):
    """Candidates' bounds in the frame of the scan their id points to."""
    scans = scale.with_scale(v("scans")).select(F.col("scan_id").alias("page_id"), "width_px", "height_px", "mm_per_px", "page_w_mm", "page_h_mm")
    n = v("part").count()
    return frames.rect_bounds(v("candidates")).withColumn("page_id", F.col("scan_id") % n).join(F.broadcast(scans) if n < 1_000_000 else scans, "page_id")


BOXES = f"""{_SCALED}, boxes AS (SELECT c.*, s.width_px, s.height_px, s.mm_per_px, c.scan_id % n.n AS page_id, greatest(0, least(1, cx - w / 2)) AS x0, greatest(0, least(1, cy - h / 2)) AS y0,
 greatest(0, least(1, cx + w / 2)) AS x1, greatest(0, least(1, cy + h / 2)) AS y1 FROM candidates c CROSS JOIN (SELECT count(*) AS n FROM part) n JOIN scaled s ON s.scan_id = c.scan_id % n.n)"""
_W, _H = R1.format("(x1 - x0) * width_px * mm_per_px"), R1.format("(y1 - y0) * height_px * mm_per_px")


@query("geo7_measure_box", f"WITH {BOXES} SELECT scan_id, cand_id, CASE WHEN mm_per_px > 0 THEN {_W} END AS w_mm, CASE WHEN mm_per_px > 0 THEN {_H} END AS h_mm FROM boxes")
def _(v):
    return scale.measure_box(boxes(v)).select("scan_id", "cand_id", "w_mm", "h_mm")


_RATIO = "greatest({0}, {1})::double / least({0}, {1})"


@query("geo8_focal_px", f"""SELECT scan_id, CASE WHEN abs({_RATIO.format('width_px', 'height_px')} / ({_RATIO.format('taken_w', 'taken_h')}) - 1) <= 0.01
 THEN {T6.format('focal35 / 43.27 * sqrt(width_px::double * width_px + height_px::double * height_px)')} END AS focal_px FROM scans""")
def _(v):
    return scale.focal_px(v("scans")).withColumn("focal_px", tidy("focal_px"))


def requests(v):
    """One request for each group of four pages; every third asks for a resolution of its own."""
    pages = scale.render_dpi(v("scans"), scale.optical_dpi(v("page_images"))).select(F.floor(F.col("scan_id") / 4).cast("long").alias("request_id"), "render_dpi")
    asked = pages.select("request_id").distinct().withColumn("asked_dpi", F.when(F.col("request_id") % 3 == 0, (150.0 + F.col("request_id") % 7 * 50)))
    return asked, pages


@query("geo9_out_dpi", f"""WITH {_OPTICAL}, {_WANTED}, r AS (SELECT cast(floor(scan_id / 4) AS bigint) AS request_id, max(least(wanted, budget)) AS highest FROM wanted GROUP BY 1)
 SELECT request_id, CASE WHEN request_id % 3 = 0 THEN (150 + request_id % 7 * 50)::double ELSE highest END AS out_dpi FROM r""")
def _(v):
    return scale.out_dpi(*requests(v))


@query("geo10_output_pixels", f"""WITH {BOXES}, s AS (SELECT *, CASE WHEN cand_id % 2 = 0 THEN 300 END AS output_dpi FROM boxes) SELECT scan_id, cand_id,
 greatest(1, CASE WHEN output_dpi IS NULL THEN least(width_px, floor(x1 * width_px + 0.5)) - greatest(0, floor(x0 * width_px + 0.5)) ELSE floor((10 + w * 100) / 25.4 * 300 + 0.5) END)::bigint AS out_w,
 greatest(1, CASE WHEN output_dpi IS NULL THEN least(height_px, floor(y1 * height_px + 0.5)) - greatest(0, floor(y0 * height_px + 0.5)) ELSE floor((10 + h * 100) / 25.4 * 300 + 0.5) END)::bigint AS out_h FROM s""")
def _(v):
    b = boxes(v).withColumn("output_dpi", F.when(F.col("cand_id") % 2 == 0, 300)).withColumn("content_w_mm", 10 + F.col("w") * 100).withColumn("content_h_mm", 10 + F.col("h") * 100)
    return scale.output_pixels(b).select("scan_id", "cand_id", "out_w", "out_h")


_SC = "coalesce(mm_per_px, 25.4::double / 300)"


@query("geo11_placed_size", f"""WITH {_SCALED}, r AS (SELECT *, height_px::double / width_px AS aspect, CASE scan_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'real' ELSE 'none' END AS fit,
 125.0::double AS tw, CASE WHEN scan_id % 2 = 0 THEN 88.0::double END AS th FROM scaled) SELECT scan_id, fit,
 {R1.format(f"CASE WHEN fit = 'real' THEN CASE WHEN th IS NOT NULL AND tw * aspect > th THEN th / aspect ELSE tw END WHEN fit = 'true' THEN width_px * mm_per_px ELSE width_px * {_SC} END")} AS placed_w_mm,
 {R1.format(f"CASE WHEN fit = 'real' THEN CASE WHEN th IS NOT NULL AND tw * aspect > th THEN th ELSE tw * aspect END WHEN fit = 'true' THEN height_px * mm_per_px ELSE height_px * {_SC} END")} AS placed_h_mm FROM r""")
def _(v):
    k = F.col("scan_id") % 3
    r = scale.with_scale(v("scans")).withColumns({"fit": F.when(k == 0, "true").when(k == 1, "real").otherwise("none"), "target_w_mm": F.lit(125.0), "target_h_mm": F.when(F.col("scan_id") % 2 == 0, 88.0), "render_dpi": F.lit(300.0)})
    return scale.placed_size(r).select("scan_id", "fit", "placed_w_mm", "placed_h_mm")


@query("geo12_margin_clean", "SELECT l_orderkey, l_linenumber, l_extendedprice, least(greatest(CASE WHEN l_linenumber = 3 THEN 0 ELSE l_extendedprice / 1000 - 20 END, 0), 40)::double AS margin FROM lineitem")
def _(v):
    given = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 1000 - 20)
    return v("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", scale.clean_margin(given).alias("margin"))


@query("geo13_page_listing", f"""WITH {_OPTICAL}, {_WANTED}, {_SCALED} SELECT s.doc_id, s.page, s.width_px, s.height_px, s.mm_per_px, floor(least(w.wanted, w.budget) + 0.5)::bigint AS dpi,
 CASE WHEN s.dpi IS NULL THEN 'unknown' ELSE 'header' END AS origin, {R1.format('page_w_pt / 72 * 25.4::double')} AS page_w_mm, {R1.format('page_h_pt / 72 * 25.4::double')} AS page_h_mm
 FROM scaled s JOIN wanted w ON w.scan_id = s.scan_id""")
def _(v):
    return scale.page_listing(v("scans"), scale.optical_dpi(v("page_images")))


@query("geo14_size_text", f"""WITH {_SCALED}, m AS (SELECT scan_id, {R1.format('width_px * mm_per_px')} AS w, {R1.format('height_px * mm_per_px')} AS h FROM scaled)
 SELECT scan_id, coalesce(format('{{:.1f}} by {{:.1f}} mm', w, h), 'scale unknown') AS size_text FROM m""")
def _(v):
    return scale.measured_px(v("scans")).select("scan_id", scale.size_text("w_mm", "h_mm").alias("size_text"))


@query("geo15_default_box", "SELECT scan_id, cand_id, CASE WHEN score >= 0.8 THEN cx - w / 2 ELSE 0.05 END::double AS x0, CASE WHEN score >= 0.8 THEN cx + w / 2 ELSE 0.95 END::double AS x1 FROM candidates")
def _(v):
    found = F.when(F.col("score") >= 0.8, F.struct((F.col("cx") - F.col("w") / 2).alias("x0"), (F.col("cy") - F.col("h") / 2).alias("y0"), (F.col("cx") + F.col("w") / 2).alias("x1"), (F.col("cy") + F.col("h") / 2).alias("y1")))
    return v("candidates").withColumn("box", found).withColumn("box", scale.default_box("box")).select("scan_id", "cand_id", "box.x0", "box.x1")


@query("tr1_turn_pixels", """SELECT scan_id, CASE scan_id % 4 WHEN 1 THEN mh - 1 - y WHEN 2 THEN 79 - x WHEN 3 THEN y ELSE x END::int AS x,
 CASE scan_id % 4 WHEN 1 THEN x WHEN 2 THEN mh - 1 - y WHEN 3 THEN 79 - x ELSE y END::int AS y, v FROM pixels JOIN (SELECT scan_id AS s, max(y) + 1 AS mh FROM pixels GROUP BY 1) ON s = scan_id""")
def _(v):
    p = v("pixels")
    heights = v("documents").select(F.col("doc_id").alias("scan_id"), F.floor((F.length("text") + 79) / 80).cast("int").alias("mh"))
    return frames.turn_cells(p.join(heights, "scan_id"), F.lit(80), F.col("mh"), F.col("scan_id")).select("scan_id", "x", "y", "v")


@query("tr2_turn_box", """WITH b AS (SELECT scan_id, cand_id, cand_id % 4 AS k, cx - w / 2 AS x0, cy - h / 2 AS y0, cx + w / 2 AS x1, cy + h / 2 AS y1 FROM candidates)
 SELECT scan_id, cand_id, CASE k WHEN 1 THEN 1 - y1 WHEN 2 THEN 1 - x1 WHEN 3 THEN y0 ELSE x0 END AS x0, CASE k WHEN 1 THEN x0 WHEN 2 THEN 1 - y1 WHEN 3 THEN 1 - x1 ELSE y0 END AS y0,
 CASE k WHEN 1 THEN 1 - y0 WHEN 2 THEN 1 - x0 WHEN 3 THEN y1 ELSE x1 END AS x1, CASE k WHEN 1 THEN x1 WHEN 2 THEN 1 - y0 WHEN 3 THEN 1 - x0 ELSE y1 END AS y1 FROM b""")
def _(v):
    b = v("candidates").selectExpr("scan_id", "cand_id", "cand_id % 4 AS k", "cx - w / 2 AS x0", "cy - h / 2 AS y0", "cx + w / 2 AS x1", "cy + h / 2 AS y1")
    return frames.turn_box(b).drop("k")


@query("tr3_turn_mask", "SELECT mask_id, CASE mask_id % 4 WHEN 1 THEN 7 - y WHEN 2 THEN 7 - x WHEN 3 THEN y ELSE x END::int AS x, CASE mask_id % 4 WHEN 1 THEN x WHEN 2 THEN 7 - y WHEN 3 THEN 7 - x ELSE y END::int AS y FROM mask_cells")
def _(v):
    return frames.turn_cells(v("mask_cells"), F.lit(8), F.lit(8), F.col("mask_id")).select("mask_id", "x", "y")


_QUAD = ", ".join(f"x{k} / w_px AS a{k}, y{k} / h_px AS b{k}" for k in range(4))
_TURNED = " UNION ALL ".join(f"SELECT scan_id, cand_id, k, {c} AS i, CASE k WHEN 1 THEN 1 - b{c} WHEN 2 THEN 1 - a{c} WHEN 3 THEN b{c} ELSE a{c} END AS x, CASE k WHEN 1 THEN a{c} WHEN 2 THEN 1 - b{c} WHEN 3 THEN 1 - a{c} ELSE b{c} END AS y FROM q" for c in range(4))


@query("tr4_turn_fit", f"""WITH q AS (SELECT scan_id, cand_id, cand_id % 4 AS k, {_QUAD} FROM quads), t AS ({_TURNED}), f AS (SELECT *, first_value(i) OVER (PARTITION BY scan_id, cand_id ORDER BY x + y, i) AS first FROM t)
 SELECT scan_id, cand_id, ((i - first + 4) % 4)::int AS corner, x, y, CASE WHEN k % 2 = 1 THEN 1 / 1.4::double ELSE 1.4::double END AS aspect FROM f""")
def _(v):
    quad = F.array(*(F.struct((F.col(f"x{k}") / F.col("w_px")).alias("x"), (F.col(f"y{k}") / F.col("h_px")).alias("y")) for k in range(4)))
    f = frames.turn_fit(v("quads").select("scan_id", "cand_id", (F.col("cand_id") % 4).alias("k"), quad.alias("quad"), F.lit(1.4).alias("aspect")))
    return f.select("scan_id", "cand_id", "aspect", F.posexplode("quad").alias("corner", "p")).select("scan_id", "cand_id", "corner", "p.x", "p.y", "aspect")


@query("tr7_crop_box", f"""WITH {BOXES}, p AS (SELECT *, greatest(0, floor(x0 * width_px + 0.5)) AS l, greatest(0, floor(y0 * height_px + 0.5)) AS u FROM boxes)
 SELECT scan_id, cand_id, l::bigint AS left_px, u::bigint AS upper_px, least(width_px, greatest(floor(x1 * width_px + 0.5), l + 1))::bigint AS right_px, least(height_px, greatest(floor(y1 * height_px + 0.5), u + 1))::bigint AS lower_px FROM p""")
def _(v):
    return frames.crop_box(boxes(v)).select("scan_id", "cand_id", "left_px", "upper_px", "right_px", "lower_px")


_CORNERS = " UNION ALL ".join(f"SELECT scan_id, cand_id, {k} AS corner, {T6.format(f'cx + ({sx}) * w / 2 * cos(radians(angle)) - ({sy}) * h / 2 * sin(radians(angle))')} AS x, {T6.format(f'cy + ({sx}) * w / 2 * sin(radians(angle)) + ({sy}) * h / 2 * cos(radians(angle))')} AS y FROM candidates" for k, (sx, sy) in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1)]))


@query("tr11_rect_corners", _CORNERS)
def _(v):
    return frames.rect_corners(v("candidates")).select("scan_id", "cand_id", "corner", tidy("x").alias("x"), tidy("y").alias("y"))


@query("tr12_fold_angle", """WITH n AS (SELECT *, greatest(ceil((abs(angle) - 45) / 90), 0) AS n FROM candidates) SELECT scan_id, cand_id, angle - sign(angle) * 90 * n AS angle,
 CASE WHEN n % 2 = 1 THEN h ELSE w END AS w, CASE WHEN n % 2 = 1 THEN w ELSE h END AS h FROM n""")
def _(v):
    return frames.folded(v("candidates")).select("scan_id", "cand_id", "angle", "w", "h")


_LEN = {"top": (0, 1), "right_": (1, 2), "bottom": (3, 2), "left_": (0, 3)}
_SIDES = "sides AS (SELECT *, " + ", ".join(f"sqrt((x{j} - x{i}) * (x{j} - x{i}) + (y{j} - y{i}) * (y{j} - y{i})) AS {n}" for n, (i, j) in _LEN.items()) + " FROM quads)"


_MAP = """shifted AS (SELECT *, x0 - 2016 AS u0, x1 - 2016 AS u1, x2 - 2016 AS u2, x3 - 2016 AS u3, y0 - 1512 AS v0, y1 - 1512 AS v1, y2 - 1512 AS v2, y3 - 1512 AS v3 FROM sides),
 recede AS (SELECT *, ((u0 - u1 + u2 - u3) * (v3 - v2) - (u3 - u2) * (v0 - v1 + v2 - v3)) / nullif((u1 - u2) * (v3 - v2) - (u3 - u2) * (v1 - v2), 0) AS top_z,
  ((u1 - u2) * (v0 - v1 + v2 - v3) - (u0 - u1 + u2 - u3) * (v1 - v2)) / nullif((u1 - u2) * (v3 - v2) - (u3 - u2) * (v1 - v2), 0) AS left_z FROM shifted),
 n AS (SELECT *, u1 - u0 + top_z * u1 AS top_x, v1 - v0 + top_z * v1 AS top_y, u3 - u0 + left_z * u3 AS left_x, v3 - v0 + left_z * v3 AS left_y FROM recede)"""
_FOCAL = """e AS (SELECT *, -(top_x * left_x + top_y * left_y) / nullif(top_z * left_z, 0) AS f2 FROM n),
 g AS (SELECT *, CASE WHEN least(abs(top_z), abs(left_z)) >= 0.02 AND f2 > 0.09 * 25401600 AND f2 < 9 * 25401600 THEN sqrt(abs(f2)) END AS corner_focal FROM e)"""
_ASPECT = """a AS (SELECT *, coalesce(focal, corner_focal, 0.6 * 5040) AS f, (top + bottom) / greatest(1e-9, right_ + left_) AS apparent FROM g),
 b AS (SELECT *, sqrt(((top_x * top_x + top_y * top_y) / (f * f) + top_z * top_z) / nullif((left_x * left_x + left_y * left_y) / (f * f) + left_z * left_z, 0)) AS freed FROM a),
 p AS (SELECT *, CASE WHEN freed > 0 AND abs(ln(freed / apparent)) < 0.35 THEN freed ELSE apparent END AS aspect FROM b)"""
_KEY = "scan_id, cand_id"


@query("pf1_side_lengths", f"WITH {_SIDES} SELECT {_KEY}, {T6.format('top')} AS top, {T6.format('right_')} AS right_side, {T6.format('bottom')} AS bottom, {T6.format('left_')} AS left_side FROM sides")
def _(v):
    return frames.with_sides(v("quads")).select("scan_id", "cand_id", tidy("top").alias("top"), tidy("right").alias("right_side"), tidy("bottom").alias("bottom"), tidy("left_side").alias("left_side"))


_SPACE = ("top_x", "top_y", "top_z", "left_x", "left_y", "left_z")


@query("pf2_sides3d", f"WITH {_SIDES}, {_MAP} SELECT {_KEY}, " + ", ".join(f"{T6.format(c)} AS {c}" for c in _SPACE) + " FROM n")
def _(v):
    return frames.with_edges_in_space(v("quads")).select("scan_id", "cand_id", *(tidy(c).alias(c) for c in _SPACE))


@query("pf3_focal_from_corners", f"WITH {_SIDES}, {_MAP}, {_FOCAL} SELECT {_KEY}, floor(corner_focal * 1000 + 0.5) / 1000 AS corner_focal FROM g")
def _(v):
    return frames.focal_from_corners(v("quads")).select("scan_id", "cand_id", tidy("corner_focal", 3).alias("corner_focal"))


@query("pf4_aspect_at", f"WITH {_SIDES}, {_MAP}, {_FOCAL}, {_ASPECT} SELECT {_KEY}, {T6.format('aspect')} AS aspect FROM p")
def _(v):
    q = frames.aspect_at(frames.focal_from_corners(v("quads")), F.coalesce("focal", "corner_focal", F.lit(0.6 * 5040)))
    return q.select("scan_id", "cand_id", tidy("aspect").alias("aspect"))


_CARD = "(kind_min >= 2 AND abs(greatest(aspect, 1 / aspect) - 85.6::double / 54) / (85.6::double / 54) <= 0.04)"


@query("pf5_is_card", f"WITH {_SIDES}, {_MAP}, {_FOCAL}, {_ASPECT} SELECT {_KEY}, {_CARD} AS card FROM p")
def _(v):
    q = frames.aspect_at(frames.focal_from_corners(v("quads")), F.coalesce("focal", "corner_focal", F.lit(0.6 * 5040)))
    return q.select("scan_id", "cand_id", frames.is_card(F.col("aspect"), F.col("kind_min") >= 2).alias("card"))


_OFF = "greatest(abs(x0 - x3), abs(x1 - x2), abs(y0 - y1), abs(y2 - y3))"


@query("pf6_square_to_frame", f"SELECT {_KEY}, {_OFF} <= 1.5 AS square FROM quads")
def _(v):
    return v("quads").select("scan_id", "cand_id", frames.square_to_frame().alias("square"))


_FIT = f"fits AS (SELECT *, {_CARD} AS card, CASE WHEN {_CARD} THEN CASE WHEN aspect >= 1 THEN 85.6::double / 54 ELSE 1 / (85.6::double / 54) END ELSE aspect END AS ratio FROM p WHERE NOT whole AND ({_CARD} OR NOT ({_OFF} <= 1.5)))"


@query("pf7_fit_for", f"WITH {_SIDES}, {_MAP}, {_FOCAL}, {_ASPECT}, {_FIT} SELECT {_KEY}, card, {T6.format('ratio')} AS aspect FROM fits")
def _(v):
    return frames.fit_for(v("quads")).select("scan_id", "cand_id", "card", tidy("aspect").alias("aspect"))


@query("tr14_fit_output_size", f"""WITH {_SIDES}, {_MAP}, {_FOCAL}, {_ASPECT}, {_FIT}, z AS (SELECT *, greatest(top, bottom) AS lw, greatest(left_, right_) AS lh FROM fits), y AS (SELECT *,
 greatest(1, floor(CASE WHEN lw / lh > ratio THEN lw ELSE lh * ratio END + 0.5)) AS out_w, greatest(1, floor(CASE WHEN lw / lh > ratio THEN lw / ratio ELSE lh END + 0.5)) AS out_h FROM z)
 SELECT {_KEY}, out_w::bigint AS out_w, out_h::bigint AS out_h, {T6.format('CASE WHEN card THEN 3.18::double / 85.6 * greatest(out_w, out_h) ELSE 0 END')} AS radius FROM y""")
def _(v):
    return frames.fit_output_size(frames.fit_for(v("quads"))).select("scan_id", "cand_id", F.col("out_w").cast("long").alias("out_w"), F.col("out_h").cast("long").alias("out_h"), tidy("radius").alias("radius"))


@query("tr9_homography", f"""WITH d AS (SELECT *, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS den, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy FROM quads),
 h AS (SELECT *, (sx * (y3 - y2) - (x3 - x2) * sy) / nullif(den, 0) AS h6, ((x1 - x2) * sy - sx * (y1 - y2)) / nullif(den, 0) AS h7 FROM d)
 SELECT {_KEY}, {T6.format('x1 - x0 + h6 * x1')} AS h0, {T6.format('y3 - y0 + h7 * y3')} AS h4, {T6.format('h6')} AS h6, {T6.format('h7')} AS h7 FROM h""")
def _(v):
    return frames.homography(v("quads")).select("scan_id", "cand_id", *(tidy(c).alias(c) for c in ("h0", "h4", "h6", "h7")))
