"""State over event streams: sessions, latest values, rates, and what makes results stale. What is kept by key in order is in keyed.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.functions.expr import col, round0

TTL = "60 minutes"
DEBOUNCE = "120 milliseconds"


def sessions(touches: DataFrame, gap: str = TTL) -> DataFrame:
    """(doc_id, start, end, touches): a document lives for the gap after its last touch; a touch exactly at the end still counts.

    Works on a stream with a watermark on ts as well. Documents that time out are not held until another arrives.
    """
    return touches.groupBy("doc_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("touches"), F.max("ts").alias("last")).select("doc_id", F.col("w.start").alias("start"), "last", "touches")


def latest_state(writes: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last write of each key, by the given order columns."""
    rest = [c for c in writes.columns if c not in keys]
    return writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("last")).select(*keys, "last.*")


def upsert(stream: DataFrame, path: str, keys: list[str], by: list[str], checkpoint: str):
    """Keeps the latest state of a stream as a table at path: each batch is merged into the state before, in a version of its own."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/version={number - 1}") if number else batch.limit(0)
        latest_state(old.unionByName(batch), keys, by).select(batch.columns).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transfer_rate(loads: DataFrame, after: float = 0.8) -> DataFrame:
    """Adds rate and eta to (run_id, ts, loaded, total): since a run's first row, once more than `after` seconds have passed."""
    run = Window.partitionBy("run_id").orderBy("ts", "event_id")
    first = F.first(F.struct("ts", "loaded")).over(run)
    l = loads.withColumn("elapsed", (F.unix_micros(F.col("ts")) - F.unix_micros(first["ts"])) / 1e6).withColumn("moved", F.col("loaded") - first["loaded"])  # noqa: E741
    rate = F.when((F.col("elapsed") > after) & (F.col("moved") > 0), F.col("moved") / F.col("elapsed"))
    return l.withColumn("rate", rate).withColumn("eta", (F.col("total") - F.col("loaded")) / F.col("rate")).drop("moved")


def progress_fraction(ratio) -> Column:
    r = col(ratio)
    return F.when(r <= 1, 0.9 * r).otherwise(0.9 + 0.09 * (1 - F.exp(-(r - 1))))


def combined_bytes(files: DataFrame) -> DataFrame:
    return files.groupBy("run_id").agg(F.sum("loaded").alias("loaded"), F.sum("total").alias("total"), F.bool_and("from_cache").alias("all_cached"))


def drop_stale(results: DataFrame) -> DataFrame:
    """The results of each run's current, that is highest, generation."""
    current = results.groupBy("run_id").agg(F.max("generation").alias("generation"))
    return results.join(current, ["run_id", "generation"], "left_semi")


def debounce(events: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """Bursts within the gap collapse to their last event."""
    return events.groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("events")).select("run_id", "event_id", "events")


def signature_dedup(items: DataFrame, exact: list[str], rounded: dict[str, int], order: str) -> DataFrame:
    """The first item of each signature: exact columns, and numbers at so many decimals."""
    parts = [F.col(c) for c in exact] + [(F.floor(F.col(c) * 10**n + 0.5) / 10**n).alias(c) for c, n in rounded.items()]
    s = items.withColumn("signature", F.sha2(F.to_json(F.struct(*parts)), 256))
    return s.groupBy("signature").agg(F.min_by(F.struct(*items.columns), order).alias("i")).select("i.*")


def encode_once(images: DataFrame, encode) -> DataFrame:
    """Runs encode on each distinct digest once and joins its columns back to every image."""
    return images.join(encode(images.select("digest").distinct()), "digest")


def edit_invalidation(edits: DataFrame) -> DataFrame:
    """(page_id, fit_valid, items_valid): whether a page's last fit and item list are newer than what voids them. A crop voids the fit, a tilt both, a quarter turn the items."""
    last = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.struct("ts", "event_id")))
    e = edits.groupBy("page_id").agg(last("fit").alias("fit"), last("crop", "tilt").alias("no_fit"), last("items").alias("items"), last("tilt", "turn").alias("no_items"))
    valid = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) > F.col(b)))
    return e.select("page_id", valid("fit", "no_fit").alias("fit_valid"), valid("items", "no_items").alias("items_valid"))


def progress_text(ms, size) -> Column:
    """Whole seconds, and megabytes: whole from 10 up, else with one decimal."""
    mb = col(size) / 1e6
    return F.concat(F.format_string("%d s, ", F.greatest(F.lit(0), round0(col(ms) / 1000))), F.when(mb >= 10, F.format_string("%.0f MB", round0(mb).cast("double"))).otherwise(F.format_string("%.1f MB", round0(mb * 10) / 10.0)))
