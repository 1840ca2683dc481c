"""Sources of scans: page metadata, image files, golden corpora, and prompts for a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST_UPLOAD = 60 * 1024 * 1024
# Channel means and deviations of the model's input, red, green, blue.
MEANS, DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)

CORPUS = """version int, render_dpi int, model string, fixtures array<struct<id:string, visibility:string, file:string, raster_file:string, raster_sha256:string, source_name:string, sha256:string, page_mm:array<double>,
 expected:struct<skew_degrees:double,box:array<double>,measured_mm:array<double>,trim_changed_fraction:double>, tolerance:struct<skew_degrees:double,box_mm:double,measured_mm:double,trim_changed_fraction:double>, limits:struct<trim_changed_fraction:double>>>"""


def page_scan(scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages within their documents, with the kind their name tells, and the rejected ones."""
    s = scans.withColumn("kind", F.when(F.endswith(F.lower("name"), F.lit(".pdf")), "pdf").otherwise("raster"))
    inside = (F.col("page") >= 0) & (F.col("page") < F.col("page_count"))
    return s.where(inside), s.where(~F.coalesce(inside, F.lit(False)))


def within_size(files: DataFrame, most: int = LARGEST_UPLOAD) -> DataFrame:
    return files.where(F.col("length") <= most)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per golden fixture of the JSON file."""
    return spark.read.json(path, schema=CORPUS, multiLine=True).select("version", "render_dpi", F.explode("fixtures").alias("f")).select("version", "render_dpi", "f.*", F.col("f.page_mm")[0].alias("page_w_mm"), F.col("f.page_mm")[1].alias("page_h_mm"))


def prompt_grid(spark: SparkSession, g: int = 8) -> DataFrame:
    """Centres of g x g cells."""
    i = spark.range(g * g)
    return i.select(F.col("id").alias("prompt_id"), ((F.floor(F.col("id") / g) + 0.5) / g).alias("py"), ((F.col("id") % g + 0.5) / g).alias("px"))


def vote_prompts(spark: SparkSession) -> DataFrame:
    """Two inset boxes and nine points."""
    rows = [(0, "box", 0.1, 0.1, 0.9, 0.9), (1, "box", 0.2, 0.2, 0.8, 0.8)]
    rows += [(2 + i * 3 + j, "point", (j + 0.5) / 3, (i + 0.5) / 3, None, None) for i in range(3) for j in range(3)]
    return spark.createDataFrame(rows, "prompt_id int, kind string, x0 double, y0 double, x1 double, y1 double")


def with_prompts(scans: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every scan with each of a fixed, small set of prompts."""
    return scans.crossJoin(F.broadcast(prompts))


def proposals_scan(masks: DataFrame, cells: DataFrame) -> DataFrame:
    """Model output as rows: each mask with its cells as one array in order (null without any); a mask's cells are bounded by its frame."""
    own = cells.groupBy("mask_id").agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("cells"))
    return masks.join(own, "mask_id", "left")


def normalised(pixels: DataFrame) -> DataFrame:
    """Channels as the model takes them."""
    return pixels.withColumns({c: (F.col(c) / 255 - m) / d for c, m, d in zip("rgb", MEANS, DEVIATIONS, strict=True)})


def scaled_prompts(prompts: DataFrame, side: int = 1024) -> DataFrame:
    """Prompt points in the model's square frame: each axis is scaled by itself."""
    return prompts.withColumn("mx", F.col("px") * side).withColumn("my", F.col("py") * side)
