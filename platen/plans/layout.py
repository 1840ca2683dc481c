"""Queries on layout and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from platen.functions.expr import tidy
from platen.operators import layout
from platen.plans.register import query

R1 = "floor(({}) * 10 + 0.5) / 10"
T6 = "floor(({}) * 1e6 + 0.5) / 1e6"


_TRAY = """tray AS (SELECT t.*, l.*, p.label, p.w_mm AS preset_a, p.h_mm AS preset_b, CASE WHEN l.landscape THEN s.h_mm ELSE s.w_mm END AS sheet_w, CASE WHEN l.landscape THEN s.w_mm ELSE s.h_mm END AS sheet_h
 FROM tray_items t JOIN layouts l ON l.layout_id = t.sheet_id % 5 LEFT JOIN sheets s ON s.sheet = l.sheet LEFT JOIN presets p ON p.preset = l.preset)"""


def tray(v, items="tray_items"):
    """Tray items with the layout of their sheet; dealt_items are the same rows with sheets dealt to tasks by the count of rows, for what sorts or groups whole sheets."""
    layouts = layout.with_sheet(v("layouts"), v("sheets"), v("presets"))
    return v(items).withColumn("layout_id", (F.col("sheet_id") % 5).cast("int")).join(F.broadcast(layouts), "layout_id")


@query("ly1_sheets", f"WITH {_TRAY} SELECT sheet, preset, count(*) AS items, max(sheet_w * sheet_h / (preset_a * preset_b)) AS times FROM tray GROUP BY 1, 2")
def _(v):
    times = F.col("sheet_w") * F.col("sheet_h") / (F.col("preset_a") * F.col("preset_b"))
    return tray(v).groupBy("sheet", "preset").agg(F.count("*").alias("items"), F.max(times).alias("times"))


def crops(v):
    return tray(v).withColumnsRenamed({"width_px": "w_px", "height_px": "h_px"})


@query("ly2_oriented_preset", f"""WITH {_TRAY} SELECT sheet_id, item_no, CASE WHEN (width_px >= height_px) = (preset_a >= preset_b) THEN preset_a ELSE preset_b END AS a,
 CASE WHEN (width_px >= height_px) = (preset_a >= preset_b) THEN preset_b ELSE preset_a END AS b FROM tray""")
def _(v):
    a, b = layout.oriented("width_px", "height_px", "preset_a", "preset_b")
    return tray(v).select("sheet_id", "item_no", a.alias("a"), b.alias("b"))


_REC = "abs(greatest({0}, {1})::double / greatest(1, least({0}, {1})) - 85.6::double / 54) / (85.6::double / 54) <= 0.03"


@query("ly3_recognised_preset", f"SELECT sheet_id, item_no, CASE WHEN {_REC.format('width_px', 'height_px')} THEN 'id-card' END AS preset FROM tray_items")
def _(v):
    return v("tray_items").select("sheet_id", "item_no", layout.recognised("width_px", "height_px").alias("preset"))


_PLAN = f"""c0 AS (SELECT *, width_px AS w_px, height_px AS h_px, height_px::double / width_px AS aspect, coalesce(mm_per_px > 0, false) AS known FROM tray),
 c1 AS (SELECT *, {{guess}} AS guessed FROM c0),
 c2 AS (SELECT *, CASE WHEN guessed THEN 'preset' ELSE fit END AS fit2, CASE WHEN guessed THEN 85.6::double ELSE preset_a END AS pa, CASE WHEN guessed THEN 54.0::double ELSE preset_b END AS pb, CASE WHEN guessed THEN 'ID or bank card' ELSE label END AS lab FROM c1),
 c3 AS (SELECT *, CASE WHEN (w_px >= h_px) = (pa >= pb) THEN pa ELSE pb END AS pw, CASE WHEN (w_px >= h_px) = (pa >= pb) THEN pb ELSE pa END AS ph,
  CASE WHEN fit2 = 'true' AND known THEN 0 WHEN fit2 = 'preset' THEN 1 WHEN sheet_w IS NOT NULL THEN 2 WHEN known THEN 0 ELSE 3 END AS note_code FROM c2),
 c4 AS (SELECT *, CASE note_code WHEN 0 THEN w_px * mm_per_px WHEN 1 THEN least(pw, ph / aspect) WHEN 2 THEN least(sheet_w - 2 * margin_mm, (sheet_h - 2 * margin_mm) / aspect) ELSE w_px END AS w0 FROM c3),
 c5 AS (SELECT *, {R1.format('w0')} AS w1, {R1.format('CASE note_code WHEN 0 THEN h_px * mm_per_px WHEN 3 THEN h_px ELSE w0 * aspect END')} AS h1 FROM c4),
 c6 AS (SELECT *, coalesce(least(1, sheet_w / w1, sheet_h / h1), 1) AS s FROM c5),
 planned AS (SELECT *, CASE WHEN sheet_w IS NULL OR s >= 1 THEN w1 ELSE {R1.format('w1 * s')} END AS content_w, CASE WHEN sheet_w IS NULL OR s >= 1 THEN h1 ELSE {R1.format('h1 * s')} END AS content_h FROM c6)"""


@query("ly4_plan_layout", f"WITH {_TRAY}, {_PLAN.format(guess='false')} SELECT sheet_id, item_no, note_code, content_w, content_h FROM planned")
def _(v):
    a, b = layout.oriented("w_px", "h_px", "preset_a", "preset_b")
    return layout.plan_layout(crops(v).withColumn("preset_w", a).withColumn("preset_h", b)).select("sheet_id", "item_no", "note_code", "content_w", "content_h")


_GUESS = "(fit = 'true' AND NOT known AND " + _REC.format("width_px", "height_px") + ")"


@query("ly5_plan", f"""WITH {_TRAY}, {_PLAN.format(guess=_GUESS)}, p AS (SELECT *, coalesce(sheet_w, content_w + 2 * margin_mm) AS page_w, coalesce(sheet_h, content_h + 2 * margin_mm) AS page_h FROM planned)
 SELECT sheet_id, item_no, content_w, content_h, page_w, page_h, (page_w - content_w) / 2 AS origin_x, (page_h - content_h) / 2 AS origin_y,
 CASE WHEN guessed THEN 'no scale, shaped like an ' || lab WHEN note_code = 0 THEN 'as measured' WHEN note_code = 1 THEN 'forced to ' || lab WHEN note_code = 2 THEN CASE WHEN fit = 'true' THEN 'no scale, fills the sheet' ELSE 'fills the sheet, not to scale' END ELSE 'no scale available' END AS note FROM p""")
def _(v):
    return layout.plan(crops(v)).select("sheet_id", "item_no", "content_w", "content_h", "page_w", "page_h", "origin_x", "origin_y", "note")


_PX = "floor(({}) / 25.4::double * 300 + 0.5)"


@query("ly6_place_on_page", f"""WITH {_TRAY}, a AS (SELECT *, width_px AS w_px, height_px AS h_px, coalesce(sheet_w, 210) AS pw_mm, coalesce(sheet_h, 297) AS ph_mm, CASE item_no % 4 WHEN 0 THEN 'real' WHEN 1 THEN 'none' WHEN 2 THEN 'fit' ELSE 'auto' END AS how,
 CASE WHEN item_no % 8 < 4 THEN 88.0::double END AS th FROM tray), b AS (SELECT *, {_PX.format('pw_mm')} AS pw, {_PX.format('ph_mm')} AS ph, {_PX.format('margin_mm')} AS m, greatest(1, {_PX.format('125')}) AS rw, greatest(1, {_PX.format('th')}) AS bh0 FROM a),
 c AS (SELECT *, CASE WHEN th IS NOT NULL THEN bh0 END AS bh, greatest(1, floor(h_px * rw / w_px + 0.5)) AS rh, least((pw - 2 * m) / w_px, (ph - 2 * m) / h_px) AS s FROM b),
 d AS (SELECT *, CASE WHEN how = 'real' THEN CASE WHEN rh > bh THEN greatest(1, floor(w_px * bh / h_px + 0.5)) ELSE rw END WHEN how = 'none' AND mm_per_px IS NOT NULL THEN greatest(1, {_PX.format('w_px * mm_per_px')}) WHEN how = 'fit' THEN greatest(1, floor(w_px * s)) ELSE w_px END AS w0,
 CASE WHEN how = 'real' THEN CASE WHEN rh > bh THEN bh ELSE rh END WHEN how = 'none' AND mm_per_px IS NOT NULL THEN greatest(1, {_PX.format('h_px * mm_per_px')}) WHEN how = 'fit' THEN greatest(1, floor(h_px * s)) ELSE h_px END AS h0 FROM c),
 e AS (SELECT *, least(pw / w0, ph / h0) AS k FROM d), f AS (SELECT *, CASE WHEN k < 1 THEN greatest(1, floor(w0 * k)) ELSE w0 END AS nw, CASE WHEN k < 1 THEN greatest(1, floor(h0 * k)) ELSE h0 END AS nh FROM e)
 SELECT sheet_id, item_no, nw::bigint AS new_w, nh::bigint AS new_h, floor((pw - nw) / 2)::bigint AS "left", floor((ph - nh) / 2)::bigint AS top FROM f""")
def _(v):
    k = F.col("item_no") % 4
    c = crops(v).withColumns({"sheet_w": F.coalesce("sheet_w", F.lit(210.0)), "sheet_h": F.coalesce("sheet_h", F.lit(297.0)), "fit": F.when(k == 0, "real").when(k == 1, "none").when(k == 2, "fit").otherwise("auto"), "target_w_mm": F.lit(125.0), "target_h_mm": F.when(F.col("item_no") % 8 < 4, 88.0), "src_mm_per_px": F.col("mm_per_px"), "dpi": F.lit(300)})
    return layout.place_on_page(c).select("sheet_id", "item_no", "new_w", "new_h", "left", "top")


_NAT = f"""n0 AS (SELECT *, height_px::double / width_px AS aspect, coalesce(mm_per_px > 0, false) AS known, {_REC.format('width_px', 'height_px')} AS card,
 CASE WHEN (width_px >= height_px) = (preset_a >= preset_b) THEN preset_a ELSE preset_b END AS pw, CASE WHEN (width_px >= height_px) = (preset_a >= preset_b) THEN preset_b ELSE preset_a END AS ph FROM tray),
 n1 AS (SELECT *, fit = 'fill' OR (fit = 'true' AND NOT bool_and(known OR card) OVER (PARTITION BY sheet_id)) AS fill FROM n0),
 nat AS (SELECT *, CASE WHEN fit = 'preset' THEN {R1.format('least(pw, ph / aspect)')} WHEN fill THEN width_px WHEN known THEN {R1.format('width_px * mm_per_px')} WHEN width_px >= height_px THEN 85.6 ELSE 54 END::double AS nat_w,
 CASE WHEN fit = 'preset' THEN {R1.format('CASE WHEN pw * aspect > ph THEN ph ELSE pw * aspect END')} WHEN fill THEN height_px WHEN known THEN {R1.format('height_px * mm_per_px')} WHEN width_px >= height_px THEN 54 ELSE 85.6 END::double AS nat_h FROM n1)"""


@query("ly7_natural_sizes", f"WITH {_TRAY}, {_NAT} SELECT sheet_id, item_no, nat_w, nat_h, fill FROM nat")
def _(v):
    return layout.natural_sizes(tray(v, "dealt_items")).select("sheet_id", "item_no", "nat_w", "nat_h", "fill")


_ARRANGE = f"""r0 AS (SELECT *, greatest(margin_mm, 4) AS gap, sheet_w - 2 * margin_mm AS aw, sheet_h - 2 * margin_mm AS ah FROM nat WHERE sheet_w IS NOT NULL), r1 AS (SELECT *, CASE WHEN fill THEN 1 ELSE least(1, aw / nat_w, ah / nat_h) END AS cap FROM r0),
 r2 AS (SELECT *, CASE WHEN cap < 1 THEN {R1.format('nat_w * cap')} ELSE nat_w END AS cw, CASE WHEN cap < 1 THEN {R1.format('nat_h * cap')} ELSE nat_h END AS ch FROM r1),
 r3 AS (SELECT *, least(aw / max(cw) OVER s, ah / (sum(ch) OVER s + gap * (count(*) OVER s - 1))) AS cs, least(ah / max(ch) OVER s, aw / (sum(cw) OVER s + gap * (count(*) OVER s - 1))) AS rs FROM r2 WINDOW s AS (PARTITION BY sheet_id)),
 r4 AS (SELECT *, CASE WHEN CASE WHEN fill THEN cs >= rs ELSE cs >= 1 END THEN 'column' ELSE 'row' END AS arrangement, CASE WHEN fill THEN {R1.format('cw * greatest(cs, rs)')} ELSE cw END AS w, CASE WHEN fill THEN {R1.format('ch * greatest(cs, rs)')} ELSE ch END AS h FROM r3 WHERE fill OR cs >= 1 OR rs >= 1),
 r5 AS (SELECT *, margin_mm + greatest(0, (aw - sum(w) OVER s - gap * (count(*) OVER s - 1)) / 2) + coalesce(sum(w + gap) OVER b, 0) AS ax, margin_mm + greatest(0, (ah - sum(h) OVER s - gap * (count(*) OVER s - 1)) / 2) + coalesce(sum(h + gap) OVER b, 0) AS ay
 FROM r4 WINDOW s AS (PARTITION BY sheet_id), b AS (PARTITION BY sheet_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("ly8_arrange", f"""WITH {_TRAY}, {_NAT}, {_ARRANGE} SELECT sheet_id, item_no, arrangement, w, h, {R1.format("CASE WHEN arrangement = 'column' THEN margin_mm + greatest(0, (aw - w) / 2) ELSE ax END")} AS x,
 {R1.format("CASE WHEN arrangement = 'column' THEN ay ELSE margin_mm + greatest(0, (ah - h) / 2) END")} AS y FROM r5""")
def _(v):
    return layout.arrange(layout.natural_sizes(tray(v, "dealt_items"))).drop("layout_id")


def shelf_items(v):
    return v("tray_items").select("sheet_id", "item_no", (20 + F.col("width_px") / 15).alias("w"), (20 + F.col("height_px") / 15).alias("h"), F.lit(200.0).alias("avail_w"), F.lit(287.0).alias("avail_h"), F.lit(5.0).alias("gap"))


@query("ly9_shelf_pack", """WITH RECURSIVE i AS (SELECT sheet_id, item_no, 20 + width_px / 15.0::double AS w, 20 + height_px / 15.0::double AS h, row_number() OVER (PARTITION BY sheet_id ORDER BY item_no) AS k FROM tray_items),
 f AS (SELECT sheet_id, item_no, k, 0 AS page, 0 AS shelf, w AS row_w, h AS row_h, 0.0::double AS used FROM i WHERE k = 1
 UNION ALL SELECT i.sheet_id, i.item_no, i.k, CASE WHEN f.row_w + 5 + i.w > 200 AND f.used + f.row_h + 5 + i.h > 287 THEN f.page + 1 ELSE f.page END,
 CASE WHEN f.row_w + 5 + i.w <= 200 THEN f.shelf WHEN f.used + f.row_h + 5 + i.h > 287 THEN 0 ELSE f.shelf + 1 END, CASE WHEN f.row_w + 5 + i.w <= 200 THEN f.row_w + 5 + i.w ELSE i.w END,
 CASE WHEN f.row_w + 5 + i.w <= 200 THEN greatest(f.row_h, i.h) ELSE i.h END, CASE WHEN f.row_w + 5 + i.w <= 200 THEN f.used WHEN f.used + f.row_h + 5 + i.h > 287 THEN 0 ELSE f.used + f.row_h + 5 END
 FROM f JOIN i ON i.sheet_id = f.sheet_id AND i.k = f.k + 1) SELECT sheet_id, item_no, page, shelf FROM f""")
def _(v):
    return layout.shelf_pack(shelf_items(v))


@query("ly10_sheet_facts", f"WITH {_TRAY}, {_NAT} SELECT sheet_id, count(*) AS items, count(DISTINCT (nat_w, nat_h)) AS sizes, count(DISTINCT (nat_w, nat_h)) = 1 AS each FROM nat GROUP BY sheet_id")
def _(v):
    return layout.sheet_facts(layout.natural_sizes(tray(v, "dealt_items")).withColumnsRenamed({"nat_w": "w", "nat_h": "h"}))


@query("ly11_describe_detection", """WITH d AS (SELECT scan_id, cand_id, kind_min = 3 AS card, whole, cand_id % 2 = 0 AS fitted, (kind_min + cand_id) % 5 AS n, (cand_id % 9 - 4) / 10.0::double AS skew FROM quads) SELECT scan_id, cand_id,
 CASE WHEN card THEN 'card, squared up' WHEN whole THEN 'whole photo kept' ELSE CASE WHEN fitted THEN 'document, squared up' ELSE 'document' END || ', ' || n || ' of 4 edges measured' END
 || CASE WHEN abs(skew) >= 0.05 THEN format(', turned {:.1f} degrees', abs(skew)) ELSE '' END AS text FROM d""")
def _(v):
    q = v("quads").select("scan_id", "cand_id", "whole", (F.col("kind_min") == 3).alias("card"), (F.col("cand_id") % 2 == 0).alias("fitted"), ((F.col("kind_min") + F.col("cand_id")) % 5).alias("n_measured"), ((F.col("cand_id") % 9 - 4) / 10.0).alias("skew"))
    return layout.describe_detection(q).select("scan_id", "cand_id", "text")


@query("ly12_preset_height", f"WITH {_TRAY} SELECT sheet_id, item_no, CASE WHEN fit = 'true' AND abs(preset_a + item_no % 3 * 0.04 - preset_a) < 0.05 THEN preset_b END AS height FROM tray")
def _(v):
    t = tray(v).withColumn("how", F.when(F.col("fit") == "true", "real").otherwise("fit"))
    return t.select("sheet_id", "item_no", layout.preset_height("how", F.col("preset_a") + F.col("item_no") % 3 * 0.04, "preset_a", "preset_b").alias("height"))


@query("ly13_trim_gate", "SELECT scan_id, cand_id, NOT (cand_id % 5 = 0) AND NOT whole AND kind_min > 0 AS trims FROM quads")
def _(v):
    return v("quads").select("scan_id", "cand_id", layout.trim_gate(F.col("cand_id") % 5 == 0, "whole", F.col("kind_min") > 0).alias("trims"))


@query("snk1_write_placements", f"""WITH {_TRAY}, {_NAT}, {_ARRANGE}, p AS (SELECT *, {R1.format("CASE WHEN arrangement = 'column' THEN margin_mm + greatest(0, (aw - w) / 2) ELSE ax END")} AS x, {R1.format("CASE WHEN arrangement = 'column' THEN ay ELSE margin_mm + greatest(0, (ah - h) / 2) END")} AS y FROM r5)
 SELECT sheet_id, item_no, {T6.format('x * 72 / 25.4::double')} AS x_pt, {T6.format('(297 - y - h) * 72 / 25.4::double')} AS y_pt, row_number() OVER (PARTITION BY sheet_id ORDER BY item_no)::int AS page_no FROM p""")
def _(v):
    p = layout.placements_pt(layout.arrange(layout.natural_sizes(tray(v, "dealt_items"))).withColumn("page_h", F.lit(297.0)))
    return p.select("sheet_id", "item_no", tidy("x_pt").alias("x_pt"), tidy("y_pt").alias("y_pt"), "page_no")


@query("snk2_export_name", r"""SELECT scan_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(name, '_', ' (') || ', page 3', ', page \d+$', ''), '\.[^.]+$', ''), '[^\p{L}\p{N}._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'scan')
 || CASE scan_id % 3 WHEN 0 THEN '-sheet' WHEN 1 THEN '-items' ELSE '' END || '.pdf' AS file FROM scans""")
def _(v):
    k = F.col("scan_id") % 3
    s = v("scans").withColumn("full", F.concat(F.replace("name", F.lit("_"), F.lit(" (")), F.lit(", page 3"))).withColumn("mode", F.when(k == 0, "sheet").when(k == 1, "items").otherwise("single"))
    return s.select("scan_id", layout.export_name("full", "mode").alias("file"))


@query("snk3_preview_scale", "SELECT scan_id, floor(width_px * least(1, 1000.0::double / greatest(width_px, height_px)))::bigint AS w, floor(height_px * least(1, 1000.0::double / greatest(width_px, height_px)))::bigint AS h FROM scans")
def _(v):
    w, h = layout.preview_scale("width_px", "height_px")
    return v("scans").select("scan_id", w.alias("w"), h.alias("h"))
