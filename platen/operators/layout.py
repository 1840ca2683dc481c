"""Layout of content on sheets: sizes, placement, several items on one sheet, and names of what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.functions.expr import col, round0, round1, settled
from platen.operators.frames import CARD_H, CARD_W

CARD_LABEL = "ID or bank card"


def oriented(w_px, h_px, a, b) -> tuple[Column, Column]:
    """A preset's sides turned the way the crop lies."""
    same = (col(w_px) >= col(h_px)) == (col(a) >= col(b))
    return F.when(same, col(a)).otherwise(col(b)), F.when(same, col(b)).otherwise(col(a))


def recognised(w_px, h_px) -> Column:
    """'id-card' for proportions within 3 percent of a card's, else null."""
    ratio = F.greatest(col(w_px), col(h_px)) / F.greatest(F.lit(1), F.least(col(w_px), col(h_px)))
    card = CARD_W / CARD_H
    return F.when(F.abs(ratio - card) / card <= 0.03, "id-card")


def with_sheet(layouts: DataFrame, sheets: DataFrame, presets: DataFrame) -> DataFrame:
    """Layouts with sheet_w, sheet_h (turned when landscape; null for no sheet) and their preset's sides and label."""
    s = layouts.join(F.broadcast(sheets.withColumnsRenamed({"w_mm": "sw", "h_mm": "sh"})), "sheet", "left").join(F.broadcast(presets.withColumnsRenamed({"w_mm": "preset_a", "h_mm": "preset_b"})), "preset", "left")
    return s.withColumn("sheet_w", F.when(F.col("landscape"), F.col("sh")).otherwise(F.col("sw"))).withColumn("sheet_h", F.when(F.col("landscape"), F.col("sw")).otherwise(F.col("sh"))).drop("sw", "sh")


def plan_layout(crops: DataFrame) -> DataFrame:
    """Adds note_code, content_w and content_h for crops (w_px, h_px, mm_per_px, fit, preset_w, preset_h, sheet_w, sheet_h, margin_mm).

    0: as measured; 1: forced into the preset's box; 2: fills the sheet less margins; 3: nothing known, so pixels. To 0.1 mm; shrunk, and rounded again, if larger than the sheet.
    """
    known, sheet = F.coalesce(F.col("mm_per_px") > 0, F.lit(False)), F.col("sheet_w").isNotNull()
    code = F.when((F.col("fit") == "true") & known, 0).when(F.col("fit") == "preset", 1).when(sheet, 2).when(known, 0).otherwise(3)
    c = settled(crops, note_code=code, aspect=F.col("h_px") / F.col("w_px"))
    width_for = lambda w, h: F.least(w, h / F.col("aspect"))
    n = F.col("note_code")
    w = F.when(n == 0, F.col("w_px") * F.col("mm_per_px")).when(n == 1, width_for(F.col("preset_w"), F.col("preset_h"))).when(n == 2, width_for(F.col("sheet_w") - 2 * F.col("margin_mm"), F.col("sheet_h") - 2 * F.col("margin_mm"))).otherwise(F.col("w_px").cast("double"))
    h = F.when(n == 0, F.col("h_px") * F.col("mm_per_px")).when(n == 3, F.col("h_px").cast("double")).otherwise(w * F.col("aspect"))
    c = settled(c, own_w=round1(w), own_h=round1(h))
    c = settled(c, shrink=F.when(sheet, F.least(F.lit(1.0), F.col("sheet_w") / F.col("own_w"), F.col("sheet_h") / F.col("own_h"))).otherwise(1.0))
    fits = F.col("shrink") >= 1
    return c.withColumn("content_w", F.when(fits, F.col("own_w")).otherwise(round1(F.col("own_w") * F.col("shrink")))).withColumn("content_h", F.when(fits, F.col("own_h")).otherwise(round1(F.col("own_h") * F.col("shrink")))).drop("aspect", "own_w", "own_h", "shrink")


def plan(crops: DataFrame) -> DataFrame:
    """plan_layout with the card guess for crops without a scale, the page around the content, its origin and a note."""
    guessed = (F.col("fit") == "true") & ~F.coalesce(F.col("mm_per_px") > 0, F.lit(False)) & recognised("w_px", "h_px").isNotNull()
    c = settled(crops, guessed=guessed)
    a, b = F.when(F.col("guessed"), CARD_W).otherwise(F.col("preset_a")), F.when(F.col("guessed"), CARD_H).otherwise(F.col("preset_b"))
    pw, ph = oriented("w_px", "h_px", a, b)
    c = settled(c, preset_w=pw, preset_h=ph, asked=F.col("fit"), label_=F.when(F.col("guessed"), CARD_LABEL).otherwise(F.col("label")))
    c = plan_layout(c.withColumn("fit", F.when(F.col("guessed"), "preset").otherwise(F.col("fit"))))
    n = F.col("note_code")
    note = F.when(F.col("guessed"), F.concat(F.lit("no scale, shaped like an "), F.col("label_"))).when(n == 0, "as measured").when(n == 1, F.concat(F.lit("forced to "), F.col("label_"))).when(n == 2, F.when(F.col("asked") == "true", "no scale, fills the sheet").otherwise("fills the sheet, not to scale")).otherwise("no scale available")
    page = lambda s, x: F.coalesce(F.col(s), F.col(x) + 2 * F.col("margin_mm"))
    c = c.withColumn("page_w", page("sheet_w", "content_w")).withColumn("page_h", page("sheet_h", "content_h")).withColumn("note", note)
    return c.withColumn("origin_x", (F.col("page_w") - F.col("content_w")) / 2).withColumn("origin_y", (F.col("page_h") - F.col("content_h")) / 2).drop("guessed", "asked", "label_")


def place_on_page(crops: DataFrame) -> DataFrame:
    """Adds new_w, new_h, left and top in pixels of a page (sheet_w, sheet_h, dpi) for crops (w_px, h_px, fit, target_w_mm, target_h_mm, src_mm_per_px, margin_mm)."""
    px = lambda mm: round0(col(mm) / 25.4 * F.col("dpi"))
    one = lambda x: F.greatest(F.lit(1), x).cast("long")
    c = settled(crops, page_px_w=px("sheet_w").cast("long"), page_px_h=px("sheet_h").cast("long"), m=px("margin_mm").cast("long"), real_w=one(px("target_w_mm")), box_h=F.when(F.col("target_h_mm").isNotNull(), one(px("target_h_mm"))))
    c = settled(c, real_h=one(round0(F.col("h_px") * F.col("real_w") / F.col("w_px"))), s=F.least((F.col("page_px_w") - 2 * F.col("m")) / F.col("w_px"), (F.col("page_px_h") - 2 * F.col("m")) / F.col("h_px")))
    capped = F.coalesce(F.col("real_h") > F.col("box_h"), F.lit(False))
    fit = F.col("fit")
    real, none = (fit == "real") & F.col("target_w_mm").isNotNull(), (fit == "none") & F.col("src_mm_per_px").isNotNull()
    w = F.when(real, F.when(capped, one(round0(F.col("w_px") * F.col("box_h") / F.col("h_px")))).otherwise(F.col("real_w"))).when(none, one(px(F.col("w_px") * F.col("src_mm_per_px")))).when(fit == "fit", one(F.floor(F.col("w_px") * F.col("s")))).otherwise(F.col("w_px"))
    h = F.when(real, F.when(capped, F.col("box_h")).otherwise(F.col("real_h"))).when(none, one(px(F.col("h_px") * F.col("src_mm_per_px")))).when(fit == "fit", one(F.floor(F.col("h_px") * F.col("s")))).otherwise(F.col("h_px"))
    c = settled(c, w0=w.cast("long"), h0=h.cast("long"))
    c = settled(c, shrink=F.least(F.col("page_px_w") / F.col("w0"), F.col("page_px_h") / F.col("h0")))
    large = F.col("shrink") < 1
    c = c.withColumn("new_w", F.when(large, one(F.floor(F.col("w0") * F.col("shrink")))).otherwise(F.col("w0"))).withColumn("new_h", F.when(large, one(F.floor(F.col("h0") * F.col("shrink")))).otherwise(F.col("h0")))
    return c.withColumn("left", F.floor((F.col("page_px_w") - F.col("new_w")) / 2)).withColumn("top", F.floor((F.col("page_px_h") - F.col("new_h")) / 2)).drop("m", "real_w", "box_h", "real_h", "s", "w0", "h0", "shrink")


def natural_sizes(items: DataFrame) -> DataFrame:
    """Adds nat_w, nat_h and fill to items (sheet_id, item_no, width_px, height_px, mm_per_px) of layouts: preset box, measured or card size; one item without any makes its whole sheet fill."""
    known = F.coalesce(F.col("mm_per_px") > 0, F.lit(False))
    card = recognised("width_px", "height_px").isNotNull()
    cw, ch = oriented("width_px", "height_px", F.lit(CARD_W), F.lit(CARD_H))
    pw, ph = oriented("width_px", "height_px", "preset_a", "preset_b")
    c = settled(items, card_w=cw, card_h=ch, pw=pw, ph=ph, aspect=F.col("height_px") / F.col("width_px"), sized=known | card)
    everyone = Window.partitionBy("sheet_id", "layout_id")
    c = c.withColumn("fill", (F.col("fit") == "fill") | ((F.col("fit") == "true") & ~F.bool_and("sized").over(everyone)))
    w = F.when(F.col("fit") == "preset", round1(F.least(F.col("pw"), F.col("ph") / F.col("aspect")))).when(F.col("fill"), F.col("width_px").cast("double")).when(known, round1(F.col("width_px") * F.col("mm_per_px"))).otherwise(F.col("card_w"))
    h = F.when(F.col("fit") == "preset", round1(F.when(F.col("pw") * F.col("aspect") > F.col("ph"), F.col("ph")).otherwise(F.col("pw") * F.col("aspect")))).when(F.col("fill"), F.col("height_px").cast("double")).when(known, round1(F.col("height_px") * F.col("mm_per_px"))).otherwise(F.col("card_h"))
    return settled(c, nat_w=w, nat_h=h).drop("card_w", "card_h", "pw", "ph", "aspect", "sized")


def arrange(items: DataFrame) -> DataFrame:
    """Sheets whose items fit in one column or row (or fill it): arrangement, x, y, w, h of each item. Items have nat_w, nat_h, fill and their layout's sheet_w, sheet_h, margin_mm."""
    sheet = Window.partitionBy("sheet_id", "layout_id")
    before = sheet.orderBy("item_no").rowsBetween(Window.unboundedPreceding, -1)
    # Sums run in the order of the items: a place half way between two tenths would else round either way. All windows have that order, and no generator stands between them, so one sort serves them.
    items_in_order = sheet.orderBy("item_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.greatest(F.col("margin_mm"), F.lit(4.0))
    c = settled(items.where("sheet_w is not null"), gap=gap, avail_w=F.col("sheet_w") - 2 * F.col("margin_mm"), avail_h=F.col("sheet_h") - 2 * F.col("margin_mm"))
    cap = F.when(F.col("fill"), 1.0).otherwise(F.least(F.lit(1.0), F.col("avail_w") / F.col("nat_w"), F.col("avail_h") / F.col("nat_h")))
    c = settled(c, cap=cap)
    c = settled(c, cw=F.when(F.col("cap") < 1, round1(F.col("nat_w") * F.col("cap"))).otherwise(F.col("nat_w")), ch=F.when(F.col("cap") < 1, round1(F.col("nat_h") * F.col("cap"))).otherwise(F.col("nat_h")))
    gaps = F.col("gap") * (F.count("*").over(items_in_order) - 1)
    c = c.withColumns({"col_s": F.least(F.col("avail_w") / F.max("cw").over(items_in_order), F.col("avail_h") / (F.sum("ch").over(items_in_order) + gaps)), "row_s": F.least(F.col("avail_h") / F.max("ch").over(items_in_order), F.col("avail_w") / (F.sum("cw").over(items_in_order) + gaps))})
    column = F.when(F.col("fill"), F.col("col_s") >= F.col("row_s")).otherwise(F.col("col_s") >= 1)
    c = c.where(F.col("fill") | (F.col("col_s") >= 1) | (F.col("row_s") >= 1))
    by = F.when(F.col("fill"), F.greatest("col_s", "row_s")).otherwise(1.0)
    c = c.withColumns({"arrangement": F.when(column, "column").otherwise("row"), "w": F.when(F.col("fill"), round1(F.col("cw") * by)).otherwise(F.col("cw")), "h": F.when(F.col("fill"), round1(F.col("ch") * by)).otherwise(F.col("ch"))})
    along = lambda own, avail: F.col("margin_mm") + F.greatest(F.lit(0.0), (F.col(avail) - F.sum(own).over(items_in_order) - F.col("gap") * (F.count("*").over(items_in_order) - 1)) / 2) + F.coalesce(F.sum(F.col(own) + F.col("gap")).over(before), F.lit(0.0))
    across = lambda own, avail: F.col("margin_mm") + F.greatest(F.lit(0.0), (F.col(avail) - F.col(own)) / 2)
    is_col = F.col("arrangement") == "column"
    c = c.withColumns({"ax": along("w", "avail_w"), "ay": along("h", "avail_h")})
    return c.select("sheet_id", "layout_id", "item_no", "arrangement", round1(F.when(is_col, across("w", "avail_w")).otherwise(F.col("ax"))).alias("x"), round1(F.when(is_col, F.col("ay")).otherwise(across("h", "avail_h"))).alias("y"), "w", "h")


def shelf_pack(items: DataFrame) -> DataFrame:
    """(sheet_id, item_no, page, shelf): next-fit shelves in item order, by one fold over each sheet's items (item_no, w, h; avail_w, avail_h, gap are the sheet's).

    An item goes on the current shelf if it fits beside the last; else a new shelf is opened under it, or on a new page.
    """
    start = F.struct(F.lit(0).alias("page"), F.lit(-1).alias("shelf"), F.lit(0.0).alias("row_w"), F.lit(0.0).alias("row_h"), F.lit(0.0).alias("used"), F.array().cast("array<struct<item_no:bigint,page:int,shelf:int>>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        first = s["shelf"] < 0
        beside = ~first & (s["row_w"] + F.col("gap") + i["w"] <= F.col("avail_w"))
        under = s["used"] + s["row_h"] + F.col("gap")
        flush = ~first & ~beside & (under + i["h"] > F.col("avail_h"))
        page = F.when(flush, s["page"] + 1).otherwise(s["page"])
        shelf = F.when(beside, s["shelf"]).when(flush | first, F.lit(0)).otherwise(s["shelf"] + 1)
        return F.struct(
            page.alias("page"), shelf.alias("shelf"), F.when(beside, s["row_w"] + F.col("gap") + i["w"]).otherwise(i["w"]).alias("row_w"), F.when(beside, F.greatest(s["row_h"], i["h"])).otherwise(i["h"]).alias("row_h"),
            F.when(beside, s["used"]).when(flush | first, F.lit(0.0)).otherwise(under).alias("used"), F.concat(s["out"], F.array(F.struct(i["item_no"].alias("item_no"), page.alias("page"), shelf.alias("shelf")))).alias("out"),
        )

    per = items.groupBy("sheet_id").agg(F.sort_array(F.collect_list(F.struct("item_no", "w", "h"))).alias("items"), F.first("avail_w").alias("avail_w"), F.first("avail_h").alias("avail_h"), F.first("gap").alias("gap"))
    return per.select("sheet_id", F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("o")).select("sheet_id", "o.*")


def sheet_facts(items: DataFrame) -> DataFrame:
    """Per sheet: items, distinct sizes, and whether all are of one size."""
    size = F.struct("w", "h")
    return items.groupBy("sheet_id").agg(F.count("*").alias("items"), F.count_distinct(size).alias("sizes")).withColumn("each", F.col("sizes") == 1)


def describe_detection(results: DataFrame) -> DataFrame:
    """Adds text of a detection: a card, the whole photo, or a document squared up or not with n_measured of its sides measured; and its skew from 0.05 degrees up."""
    sides = F.concat(F.lit(", "), F.col("n_measured").cast("string"), F.lit(" of 4 edges measured"))
    found = F.when(F.col("card"), "card, squared up").when(F.col("whole"), "whole photo kept").otherwise(F.concat(F.when(F.col("fitted"), "document, squared up").otherwise("document"), sides))
    return results.withColumn("text", F.concat(found, F.when(F.abs("skew") >= 0.05, F.format_string(", turned %.1f degrees", F.abs("skew"))).otherwise("")))


def preset_height(fit, typed_w, preset_w, preset_h) -> Column:
    """A preset's height counts only for real size while the typed width is the preset's, within 0.05."""
    return F.when((col(fit) == "real") & (F.abs(col(typed_w) - col(preset_w)) < 0.05), col(preset_h))


def trim_gate(has_items, has_fit, asked) -> Column:
    return ~col(has_items) & ~col(has_fit) & col(asked)


def placements_pt(placements: DataFrame) -> DataFrame:
    """Adds x_pt, y_pt, w_pt, h_pt with the origin at the lower left of a page page_h mm high, and the page's place in its file, by layout and item: the order that arrange leaves its rows in."""
    pt = lambda c: c * 72.0 / 25.4
    p = placements.withColumns({"x_pt": pt(F.col("x")), "y_pt": pt(F.col("page_h") - F.col("y") - F.col("h")), "w_pt": pt(F.col("w")), "h_pt": pt(F.col("h"))})
    return p.withColumn("page_no", F.row_number().over(Window.partitionBy("sheet_id").orderBy("layout_id", "item_no")))


def export_name(name, mode) -> Column:
    """A file's name for what is written from it: no page suffix, no extension, odd characters as '-'."""
    base = F.regexp_replace(F.regexp_replace(col(name), r", page \d+$", ""), r"\.[^.]+$", "")
    clean = F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}._-]+", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(clean, F.lit("")), F.lit("scan")), F.when(col(mode) == "sheet", "-sheet").when(col(mode) == "items", "-items").otherwise(""), F.lit(".pdf"))


def preview_scale(w, h, most: int = 1000) -> tuple[Column, Column]:
    s = F.least(F.lit(1.0), most / F.greatest(col(w), col(h)))
    return F.floor(col(w) * s), F.floor(col(h) * s)
