"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to ORDER, built from a bounded sample of its documents and then frozen. A
byte costs the escapes from the contexts in which it was not seen plus its share in the longest one in which it was
(method C: a context seen n times with d distinct successors escapes with d / (n + d)); below order 0 all 256 bytes are alike.
The language with the shortest code for the whole text is predicted. Nothing of the trees is left out: their counts are taken
by the tasks that read the sample and added up by context and byte; one task a language turns them into its tree. As the statistics are frozen, the
cost of each byte seen after a context and each context's escape are tabled once, so a text is scored by searches in sorted tables. The model
grows with the languages that are labelled, at most PER_LANGUAGE documents each; a tree is as large as what its language has seen.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platen.llm.common import MAX_BROADCAST, cut, slices, table
from platen.llm.labelled import held_out

#: Documents of each language that its tree is built from, at most.
PER_LANGUAGE = 150
ORDER = 3
#: A byte is the digit byte + 1 of a code; 0 stands before a text. Digits are in the order of the text.
BASE = 257
#: Bytes counted or scored at once.
BLOCK = 1 << 20
#: Parts of a language from which the sample is taken first, so that no task sees a whole language.
PARTS = 64
#: Bytes of trees that are broadcast at once.
MODEL_BYTES = 1 << 28
UNKNOWN = "und"


def codes_of(text: bytes) -> Iterator[np.ndarray]:
    """Codes of each byte after the ORDER bytes before it, in blocks."""
    s = np.concatenate([np.zeros(ORDER, np.int64), np.frombuffer(text, np.uint8).astype(np.int64) + 1])
    for a in range(0, len(text), BLOCK):
        n = min(BLOCK, len(text) - a)
        code = np.zeros(n, np.int64)
        for k in range(ORDER + 1):
            code = code * BASE + s[a + k : a + k + n]
        yield code


@dataclass
class Tree:
    """One language's costs, by order: the codes and contexts it has seen, sorted, with nats."""

    codes: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def cost(self, order: int, codes: np.ndarray) -> np.ndarray:
        """Nats of codes of an order, whether seen or not."""
        if order < 0:
            return np.full(len(codes), np.log(256.0))
        at, hit = found(self.codes[order], codes)
        out = np.empty(len(codes))
        out[hit] = self.costs[order][at[hit]]
        rest = codes[~hit]
        out[~hit] = self.escape(order, rest) + self.cost(order - 1, rest % BASE**order)
        return out

    def escape(self, order: int, codes: np.ndarray) -> np.ndarray:
        """0 where the context hasn't been seen."""
        at, hit = found(self.contexts[order], codes // BASE)
        out = np.zeros(len(codes))
        out[hit] = self.escapes[order][at[hit]]
        return out


class Trees(dict):
    """Language -> Tree, languages in order."""

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(text, language) -> code length in nats. What BLOCK bytes of texts hold is looked up once for each code, not for each text."""
        total = np.zeros((len(texts), len(self)))

        def add(held: list[tuple[int, np.ndarray]]) -> None:
            codes, at = np.unique(np.concatenate([c for _, c in held]), return_inverse=True)
            starts = np.cumsum([0, *(len(c) for _, c in held[:-1])])
            for k, tree in enumerate(self.values()):
                np.add.at(total[:, k], [t for t, _ in held], np.add.reduceat(tree.cost(ORDER, codes)[at], starts))

        held, size = [], 0
        for t, text in enumerate(texts):
            for block in codes_of(text):
                if held and size + len(block) > BLOCK:
                    add(held)
                    held, size = [], 0
                held.append((t, block))
                size += len(block)
        if held:
            add(held)
        return total

    def best(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, its nats, what the others weigh beside it: the sum of e ** (nats - their nats), 1 for itself) of each text. UNKNOWN for one without a letter."""
        out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        some = [k for k, t in enumerate(texts) if self and t and any(map(str.isalpha, t))]
        names, nats = list(self), self.lengths([texts[k].encode("utf-8", "surrogatepass") for k in some])
        for k, own in zip(some, nats, strict=True):
            n = int(own.argmin())
            out[k] = names[n], float(own[n]), float(np.exp(own[n] - own).sum())
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its posterior probability among the learned ones; 'und' and 0 for a text without a letter."""
        ((name, _, weight),) = self.best([text])
        return name, 1 / weight if weight else 0.0


def found(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of each wanted value in ordered ones."""
    if not len(ordered):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return at, ordered[at] == wanted


def build(code: np.ndarray, n: np.ndarray) -> Tree:
    """A language's tree from counts n of distinct codes."""
    tree = Tree([], [], [], [])
    for order in range(ORDER + 1):
        codes, at = np.unique(code % BASE ** (order + 1), return_inverse=True)
        counts = np.bincount(at, n, len(codes))
        contexts, of = np.unique(codes // BASE, return_inverse=True)
        total, kinds = np.bincount(of, counts, len(contexts)), np.bincount(of, minlength=len(contexts))
        escapes = -np.log(kinds / (total + kinds))
        costs = -np.log(counts / (total + kinds)[of])
        for kept, made in zip((tree.codes, tree.costs, tree.contexts, tree.escapes), (codes, costs.astype(np.float32), contexts, escapes.astype(np.float32)), strict=True):
            kept.append(made)
    return tree


def grown(counts: pa.Table) -> pa.Table:
    """(lang, code, n) of one language -> (lang, tree)."""
    tree = build(counts["code"].to_numpy(), counts["n"].to_numpy())
    return pa.table([pa.array([counts["lang"][0].as_py()]), pa.array([pickle.dumps(tree)], pa.binary())], ["lang", "tree"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, code, n), added up within a batch."""
    for b in batches:
        seen: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen.setdefault(lang, []).extend(codes_of(text.encode("utf-8", "surrogatepass")))
        for lang, parts in seen.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n, pa.int64())], ["lang", "code", "n"])


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of the per_language documents of each language with the smallest hashes of their ids, outside the held-out fold.

    Null languages, null and empty texts and null ids are left out. Each task passes on no more than per_language of a language's part.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text != ''").where(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("k") <= per_language).drop("k")
    parts = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"))
    ids = cut(first(first(parts, "lang", "part"), "lang").select("doc_id", "lang").distinct())
    return known.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids, ["doc_id", "lang"]).select("lang", "text")


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, tree): a row for each language, its tree grown by a task from the counts of its sample."""
    counts = sample(docs, id_col, text_col, lang_col, per_language).mapInArrow(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return cut(counts.groupBy("lang").applyInArrow(grown, "lang string, tree binary"))


def portions(trees: DataFrame, most: int = MODEL_BYTES) -> Iterator[Trees]:
    """The trees in order of their languages, as many at a time as have `most` bytes together; a larger tree is a portion of its own."""
    sizes = trees.select("lang", F.length("tree").alias("n")).orderBy("lang").collect()
    names: list[str] = []
    held = 0
    for k, r in enumerate(sizes):
        names.append(r["lang"])
        held += r["n"]
        if k + 1 == len(sizes) or held + sizes[k + 1]["n"] > most:
            rows = trees.where(F.col("lang").isin(names)).collect()
            yield Trees(sorted((x["lang"], pickle.loads(x["tree"])) for x in rows))
            names, held = [], 0
    if not sizes:
        yield Trees()


def predictions(docs: DataFrame, trees: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MODEL_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Null, empty and letterless texts are 'und' with score 0; ties go to the first language by name. Repeated rows and null ids each
    keep their row (a null id is held out). An empty table gives no row. Other columns are not read. Trees of more than `most` bytes are
    broadcast a portion at a time: the texts are read once for each, and the best so far goes with them.
    """
    sc = docs.sparkSession.sparkContext
    kinds = "doc_id long, held_out boolean, text string, lang_pred string, nats double, weight double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("nats"), F.lit(0.0).alias("weight"))

    def scored(trees: Trees):
        shared = sc.broadcast(trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 2048):
                before = zip(*(c.to_pylist() for c in b.columns[3:]), strict=True)
                out = [merged(x, y) for x, y in zip(before, shared.value.best(b.column(2).to_pylist()), strict=True)]
                now = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, t) for c, t in zip(now, (pa.string(), pa.float64(), pa.float64()), strict=True))], [f.split()[0] for f in kinds.split(", ")])

        return run

    for k, some in enumerate(portions(trees, most)):
        rows = (cut(rows) if k else rows).mapInArrow(scored(some), kinds)
    return rows.select("doc_id", "held_out", "lang_pred", F.coalesce(F.try_divide(F.lit(1.0), "weight"), F.lit(0.0)).alias("score"))


def merged(a: tuple[str, float, float], b: tuple[str, float, float]) -> tuple[str, float, float]:
    """The better of two results of Trees.best, the first of equals, with the weight of both."""
    if not a[2] or not b[2]:
        return tuple(a if a[2] else b)
    one, two = (a, b) if a[1] <= b[1] else (b, a)
    return one[0], one[1], one[2] + two[2] * float(np.exp(one[1] - two[1]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predictions(docs, trained(docs))
