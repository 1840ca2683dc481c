"""Bounded samples of labelled rows, and memories of words that stay bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of every FOLDS are held out: those whose crc32(id as text) is divisible by it.
FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """True for the held-out fold; a row without an id is held out, as it has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most per_class ids of label 0 and of 1, those with the smallest hashes; and how many ids have each label in all.

    Both tables have doc_id. Ids of the held-out fold and null labels are left out; an id labelled twice counts once, as 1 if either is.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where(f"doc_id is not null and label in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    return docs.select(F.col("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id"), counts


class BoundedMemory(dict):
    """word -> make(word); forgets all when full."""

    def __init__(self, make, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value
