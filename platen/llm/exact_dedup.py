"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary (Spark's ``approx_top_k`` keeps such counters) names the digests that may be frequent.
Their exact counts are then taken over all rows, and those verified as frequent, at most ``max_heavy``
of them, are broadcast: their copies are settled where they are read. Every other digest goes through an
ordinary shuffle of partial aggregates, and only digests seen twice are joined back, in a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm.common import cut, table, without_rows

#: Counters of the Misra-Gries summary; it misses no digest with over rows / HEAVY_COUNTERS copies.
HEAVY_COUNTERS = 4096
#: Digests broadcast at most, those that the summary counts most; a frequent one beyond them is shuffled like others.
MAX_HEAVY = 1024
#: Groups of tasks whose summaries are merged first, so that no task merges one from every task.
MERGE_GROUPS = 64


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = HEAVY_COUNTERS, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """One row per input row: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    A null text equals the empty text. Rows that repeat an id with the same text all count in group_size and
    are all kept if the id is the one that stays. A group without any id has a null keep_id and each of its rows is kept. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256).alias("text_sha256")))
    merged = rows.groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("part")).agg(F.expr(f"approx_top_k_accumulate(text_sha256, {counters})").alias("seen"))
    top = merged.groupBy((F.col("part") * 0).alias("all")).agg(F.expr(f"approx_top_k_combine(seen, {counters})").alias("seen")).select(F.expr(f"approx_top_k_estimate(seen, {max_heavy})").alias("top"))
    named = top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"))
    sized = rows.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    heavy = cut(sized.where("group_size > 1"))
    frequent = rows.join(F.broadcast(heavy), "text_sha256")
    rest = rows.join(F.broadcast(heavy), "text_sha256", "left_anti")
    twice = cut(rest.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    rare = rest.join(twice, "text_sha256", "left").select("doc_id", "text_sha256", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    return frequent.select(rare.columns).unionByName(rare).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all its columns, whatever they are called.

    It is one with the largest id; of rows that repeat that id with the same text one stays, and so does one of a group without
    any id. Rows of one id with different texts are judged each by its own text. A null text equals the empty text. An empty table gives
    an empty result.
    """
    copies = duplicate_groups(docs, id_col, text_col).where("group_size > 1")
    marked = copies.select("doc_id", F.xxhash64("text_sha256").alias("mark"), (~F.col("kept")).alias("gone"))
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    return without_rows(docs, marked, id_col, F.xxhash64(digest))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
