"""Physical scale and measurement: from page metadata and boxes to millimetres. Unknown scale is null throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.functions.expr import clamp, col, hypot, round0, round1

DEFAULT_DPI, DPI_FLOOR, DPI_CEILING, PIXEL_BUDGET = 300.0, 120.0, 900.0, 36e6
SCREEN_DPI, SCREEN_BUDGET = 300.0, 40e6
FRAME_DIAGONAL_MM = 43.27


def optical_dpi(images: DataFrame) -> DataFrame:
    """(scan_id, optical_dpi): of a page's images the one with most pixels (the first of equals) over the inches it is drawn on, along the poorer axis. Null if drawn under a point wide or high."""
    best = images.groupBy("scan_id").agg(F.max_by(F.struct("w", "h", "bbox_w_pt", "bbox_h_pt"), F.struct(F.col("w") * F.col("h"), -F.col("image_no"))).alias("b"))
    dpi = F.least(F.col("b.w") / (F.col("b.bbox_w_pt") / 72), F.col("b.h") / (F.col("b.bbox_h_pt") / 72))
    return best.select("scan_id", F.when((F.col("b.bbox_w_pt") >= 1) & (F.col("b.bbox_h_pt") >= 1), dpi).alias("optical_dpi"))


def render_dpi(scans: DataFrame, optical: DataFrame, default: float = DEFAULT_DPI) -> DataFrame:
    """(scan_id, render_dpi, reason): the optical resolution within bounds, or the default, under the pixel budget of the page's area."""
    o = F.col("optical_dpi")
    wanted = F.when(o.isNull(), default).otherwise(clamp(o, DPI_FLOOR, DPI_CEILING))
    budget = F.sqrt(PIXEL_BUDGET / F.greatest(F.col("page_w_pt") / 72 * (F.col("page_h_pt") / 72), F.lit(0.01)))
    reason = F.when(o.isNull(), "default").when(F.abs(F.col("wanted") - o) < 1, "matched").otherwise("clamped")
    joined = scans.join(optical, "scan_id", "left").withColumn("wanted", wanted).withColumn("budget", budget)
    return joined.select("scan_id", F.least("wanted", "budget").alias("render_dpi"), F.concat(reason, F.when(F.col("wanted") > F.col("budget"), "+capped").otherwise("")).alias("reason"))


def screen_dpi(scans: DataFrame) -> DataFrame:
    area = F.greatest(F.col("page_w_pt") / 72 * (F.col("page_h_pt") / 72), F.lit(1e-6))
    return scans.select("scan_id", F.least(F.lit(SCREEN_DPI), F.floor(F.sqrt(SCREEN_BUDGET / area)).cast("double")).alias("dpi"))


def raster_dpi() -> Column:
    """From header_dpi and its unit (3: per centimetre); null outside 30..4800."""
    dpi = F.when(F.col("header_dpi") > 0, F.col("header_dpi") * F.when(F.col("dpi_unit") == 3, 2.54).otherwise(1.0))
    return F.when(dpi.between(30, 4800), dpi)


def with_scale(scans: DataFrame) -> DataFrame:
    """Adds dpi, mm_per_px (null: unknown), page_w_mm and page_h_mm."""
    return scans.withColumn("dpi", raster_dpi()).withColumn("mm_per_px", 25.4 / F.col("dpi")).withColumn("page_w_mm", round1(F.col("page_w_pt") / 72 * 25.4)).withColumn("page_h_mm", round1(F.col("page_h_pt") / 72 * 25.4))


def measured_px(scans: DataFrame) -> DataFrame:
    s = with_scale(scans)
    return s.select("scan_id", round1(F.col("width_px") * F.col("mm_per_px")).alias("w_mm"), round1(F.col("height_px") * F.col("mm_per_px")).alias("h_mm"))


def measure_box(boxes: DataFrame) -> DataFrame:
    """Adds w_mm and h_mm of the box x0, y0, x1, y1 (shares of width_px and height_px); null without a positive scale."""
    side = lambda a, b, n: F.when(F.col("mm_per_px") > 0, round1((F.col(b) - F.col(a)) * F.col(n) * F.col("mm_per_px")))
    return boxes.withColumn("w_mm", side("x0", "x1", "width_px")).withColumn("h_mm", side("y0", "y1", "height_px"))


def focal_px(scans: DataFrame) -> DataFrame:
    """Focal length in pixels from its 35 mm equivalent; null when the header's frame is not the pixels' shape, whichever way up."""
    ratio = lambda a, b: F.greatest(a, b) / F.least(a, b)
    own, taken = ratio(F.col("width_px"), F.col("height_px")), ratio(F.col("taken_w"), F.col("taken_h"))
    focal = F.col("focal35") / FRAME_DIAGONAL_MM * hypot(F.col("width_px").cast("double"), F.col("height_px").cast("double"))
    return scans.select("scan_id", F.when(F.abs(own / taken - 1) <= 0.01, focal).alias("focal_px"))


def out_dpi(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(request_id, out_dpi): what a request asks for, else the highest of its pages, else the default."""
    highest = pages.groupBy("request_id").agg(F.max("render_dpi").alias("highest"))
    return requests.join(highest, "request_id", "left").select("request_id", F.coalesce("asked_dpi", "highest", F.lit(DEFAULT_DPI)).alias("out_dpi"))


def output_pixels(crops: DataFrame) -> DataFrame:
    """Adds out_w and out_h: the crop's own pixels when output_dpi is null, else its millimetres at that resolution; 1 at least."""
    own = lambda a, b, n: F.least(col(n), round0(F.col(b) * F.col(n))) - F.greatest(F.lit(0), round0(F.col(a) * F.col(n)))
    size = lambda a, b, n, mm: F.greatest(F.lit(1), F.when(F.col("output_dpi").isNull(), own(a, b, n)).otherwise(round0(F.col(mm) / 25.4 * F.col("output_dpi")))).cast("long")
    return crops.withColumn("out_w", size("x0", "x1", "width_px", "content_w_mm")).withColumn("out_h", size("y0", "y1", "height_px", "content_h_mm"))


def placed_size(requests: DataFrame) -> DataFrame:
    """Adds placed_w_mm and placed_h_mm. fit 'true': as measured; 'real': the width asked for, its height capped; otherwise as measured, or pixels at the render resolution."""
    aspect = F.col("height_px") / F.col("width_px")
    scale = F.coalesce(F.col("mm_per_px"), 25.4 / F.col("render_dpi"))
    full = F.col("target_w_mm") * aspect
    capped = F.col("target_h_mm").isNotNull() & (full > F.col("target_h_mm"))
    real = (F.col("fit") == "real") & F.col("target_w_mm").isNotNull()
    w = F.when(real, F.when(capped, F.col("target_h_mm") / aspect).otherwise(F.col("target_w_mm"))).when(F.col("fit") == "true", F.col("width_px") * F.col("mm_per_px")).otherwise(F.col("width_px") * scale)
    h = F.when(real, F.when(capped, F.col("target_h_mm")).otherwise(full)).when(F.col("fit") == "true", F.col("height_px") * F.col("mm_per_px")).otherwise(F.col("height_px") * scale)
    return requests.withColumn("placed_w_mm", round1(w)).withColumn("placed_h_mm", round1(h))


def clean_margin(margin) -> Column:
    """Within 0..40 mm; what is no number is 0."""
    m = col(margin)
    return clamp(F.when(m.isNull() | F.isnan(m) | (F.abs(m) == float("inf")), 0.0).otherwise(m), 0.0, 40.0)


def page_listing(scans: DataFrame, optical: DataFrame) -> DataFrame:
    s = with_scale(scans).join(render_dpi(scans, optical), "scan_id")
    return s.select("doc_id", "page", "width_px", "height_px", "mm_per_px", round0("render_dpi").cast("long").alias("dpi"), F.when(F.col("dpi").isNull(), "unknown").otherwise("header").alias("origin"), "page_w_mm", "page_h_mm")


def size_text(w_mm, h_mm, share_w=None, share_h=None) -> Column:
    """'w by h mm'; without a scale the percent of the frame when given, else 'scale unknown'."""
    mm = lambda c: F.when(col(c).isNotNull(), F.format_string("%.1f", col(c).cast("double")))
    other = F.lit("scale unknown") if share_w is None else F.concat(round0(col(share_w) * 100).cast("string"), F.lit("% by "), round0(col(share_h) * 100).cast("string"), F.lit("%"))
    return F.coalesce(F.concat(mm(w_mm), F.lit(" by "), mm(h_mm), F.lit(" mm")), other)


def default_box(box: str, inset: float = 0.05) -> Column:
    """A detected box, or the frame less an inset where nothing was found."""
    whole = F.struct(F.lit(inset).alias("x0"), F.lit(inset).alias("y0"), F.lit(1 - inset).alias("x1"), F.lit(1 - inset).alias("y1"))
    return F.coalesce(F.col(box), whole)


