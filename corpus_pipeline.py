"""Documents to training sequences: toxic ones out, exact and near copies out, repeated passages out, the rest packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents.
run() writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from platen.llm.common import shared_checkpoint_dir, table
from platen.llm.exact_dedup import drop_duplicates
from platen.llm.near_copies import drop_near_copies
from platen.llm.packing import pack
from platen.llm.suffix_dedup import without_repeats
from platen.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labels, rejects go. A null text is an empty one; repeated rows are judged alike; null ids are no reason to go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the row with the largest id stays, one if it is repeated; rows of one id with other texts are judged by their own text."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles 0.8 alike or more) the row with the smallest id stays, one if it is repeated. Texts without words are alike."""
    return drop_near_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that start earlier in the corpus go; the document keeps the rest, and its length follows. Null and short texts stay; no row goes."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences, and their ids. A null or empty text is one piece of the end id."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", suffix_dedup), ("best-fit packing", packing)]

#: SQL can express neither a trained model nor packing; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's Parquet goes once the next stage has read it; the last one's stays, as the result reads it. An empty table gives no piece."""
    folder = f"{shared_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
