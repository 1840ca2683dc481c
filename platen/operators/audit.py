"""Audits of stored artifacts, sources and results: what is there, what is missing, what agrees with golden values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that may be stored (in either case), and the largest artifact.
ALLOWED_NAME, LARGEST = r"(?i)^[a-z0-9][a-z0-9_.-]*\.onnx(_data)?$", 512 * 1024 * 1024


def artifact_audit(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """(name, state) for every name in either table."""
    m, o = manifest.select("name", F.col("bytes").alias("expected")), observed.select("name", F.col("bytes").alias("found"))
    good = F.col("name").rlike(ALLOWED_NAME) & ~F.contains("name", F.lit(".."))
    state = F.when(F.col("expected").isNull() | ~good, "unexpected").when(F.col("found").isNull(), "missing").when(F.col("found") > LARGEST, "oversized").when(F.col("found") != F.col("expected"), "truncated").otherwise("ok")
    return m.join(o, "name", "full_outer").select("name", state.alias("state"))


def cached_count(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """(quality, precision_, have, of)."""
    seen = manifest.join(observed.select("name", F.lit(1).alias("there")).distinct(), "name", "left")
    return seen.groupBy("quality", "precision_").agg(F.count("there").alias("have"), F.count("*").alias("of"))


def missing_files(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    return manifest.join(observed, "name", "left_anti")


def prune(observed: DataFrame, current: DataFrame) -> DataFrame:
    """What no current name holds, to be deleted."""
    return observed.join(current, "name", "left_anti")


def download_bytes(manifest: DataFrame) -> DataFrame:
    """Bytes and files per quality and precision, with the totals above them."""
    return manifest.rollup("quality", "precision_").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


def model_status(counts: DataFrame, loaded: Column) -> DataFrame:
    status = F.when(loaded, "loaded").when(F.col("have") == F.col("of"), "cached").when(F.col("have") > 0, F.concat(F.col("have").cast("string"), F.lit(" of "), F.col("of").cast("string"), F.lit(" cached"))).otherwise("not downloaded")
    return counts.withColumn("status", status)


def digest_mismatches(contents: DataFrame, recorded: DataFrame) -> DataFrame:
    """(id, digest) of contents whose SHA-256 is not the recorded one."""
    own = contents.select("id", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    return own.join(recorded, "id").where(F.col("digest") != F.col("sha256")).select("id", "digest")


def corpus_check(expected: DataFrame, measured: DataFrame) -> DataFrame:
    """(id, off_w, off_h, ok): measured sizes within each row's tolerance."""
    j = expected.join(measured, "id")
    off = lambda a, b: F.floor(F.abs(F.col(a) - F.col(b)) * 1e6 + 0.5) / 1e6
    j = j.withColumn("off_w", off("w", "expected_w")).withColumn("off_h", off("h", "expected_h"))
    return j.select("id", "off_w", "off_h", ((F.col("off_w") <= F.col("tolerance")) & (F.col("off_h") <= F.col("tolerance"))).alias("ok"))


def page_geometry_check(pages: DataFrame, within: float = 0.2) -> DataFrame:
    return pages.withColumn("ok", (F.abs(F.col("w_mm") - F.col("expected_w")) <= within) & (F.abs(F.col("h_mm") - F.col("expected_h")) <= within))


def accuracy_summary(errors: DataFrame) -> DataFrame:
    """Median and worst error, and the share within 2."""
    return errors.agg(F.percentile("error", 0.5).alias("median_error"), F.max("error").alias("worst"), F.avg((F.col("error") <= 2).cast("double")).alias("share_within_2"))


def resolution_spread(sizes: DataFrame, most: float = 1.0) -> DataFrame:
    """(doc_id, spread, ok): the same document at several resolutions should measure the same."""
    return sizes.groupBy("doc_id").agg((F.max("w_mm") - F.min("w_mm")).alias("spread")).withColumn("ok", F.col("spread") < most)


def kind_matrix(sides: DataFrame) -> DataFrame:
    """Counts of each side and kind, with margins."""
    return sides.cube("side", "kind").agg(F.count("*").alias("n"))


def skip_missing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(id, outcome) of rows without a file: private ones are skipped, public ones are errors."""
    return expected.join(found, "id", "left_anti").select("id", F.when(F.col("visibility") == "private", "skipped").otherwise("error").alias("outcome"))
