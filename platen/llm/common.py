"""What the corpus operators share: reading tables, cutting lineage, linking components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids and marks (16 bytes each) that are broadcast at most.
MAX_BROADCAST = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """Uses the folder the cluster names in spark.checkpoint.dir. Where none is set, a local master gets one of its own, deleted at exit; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="platen-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and continues from there, so a lost executor costs no recomputation."""
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame) -> DataFrame:
    """df checkpointed, without its estimated size: each join multiplies the sizes of its sides, checkpoints keep that, and after tens of joins the numbers themselves take minutes."""
    spark, kept = df.sparkSession, cut(df)
    return type(df)(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)


def broadcast_if_small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """df, which is checkpointed and has a few short columns, marked for broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time, so that what is made of them stays small; an empty batch stays one."""
    for b in batches:
        for a in range(0, max(1, b.num_rows), rows):
            yield b.slice(a, rows)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Columns (node, root): the smallest node reachable from each node that has an edge.

    Alternates large-star and small-star steps, which join nothing but groups of one node's
    neighbours with their minimum. A node of any degree is fine: minima are partial aggregates, and as they are cut off
    before the join back to them, Spark can split that join. Each round is checkpointed; it ends when nothing changes.
    """
    e = cut(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u != v").distinct())
    seen = None
    while True:
        both = e.union(e.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        down = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        low = cut(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v")
        e = cut(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(e.select("v", F.col("v").alias("root")).distinct())


def without_rows(docs: DataFrame, marked: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """docs without the rows that are gone, and with one of each that stays and is repeated.

    marked (doc_id, mark, gone) has a row for each row of a group; a row of docs is known by its id, which may be null, and its
    mark, which is a function of its text. Of rows that repeat both, the one with the least hash of all its columns stays. Only rows of repeated marks are brought together. Lists of up to MAX_BROADCAST
    marks are broadcast, so that texts stay where they are read; longer ones are shuffled.
    """
    each = cut(marked.groupBy("doc_id", "mark").agg(F.first("gone").alias("gone"), F.count("*").alias("n")).where("gone or n > 1"))
    sizes = {r["gone"]: r["count"] for r in each.groupBy("gone").count().collect()}
    same = F.col(id_col).eqNullSafe(F.col("__marked_id")) & (mark == F.col("__marked"))

    def named(gone: bool) -> DataFrame:
        rows = each.where(F.col("gone") == gone).select(F.col("doc_id").alias("__marked_id"), F.col("mark").alias("__marked"))
        return F.broadcast(rows) if sizes.get(gone, 0) <= MAX_BROADCAST else rows

    kept = docs.join(named(True), same, "left_anti") if sizes.get(True) else docs
    if sizes.get(False):
        every = [F.col(f"`{c}`") for c in docs.columns]
        row = F.min_by(F.struct(*every), F.xxhash64(*every)).alias("__row")
        once = docs.join(named(False), same, "left_semi").groupBy(F.col(id_col).alias("__id"), mark.alias("__mark")).agg(row).select("__row.*")
        kept = kept.join(named(False), same, "left_anti").unionByName(once)
    return kept.select(docs.columns)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of what no DataFrame refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
