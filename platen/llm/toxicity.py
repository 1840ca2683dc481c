"""Toxicity by a factorization machine over hashed terms.

The score is sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the terms present in the text, so that two terms
together (an insult and a group, say) can weigh more or less than both alone. It learns in numpy from a bounded
sample of labelled rows; only hashed term ids of that sample reach the driver. All its terms learn, none is selected by what it
tells alone: sparse adaptive steps touch the terms of a batch, a proximal penalty keeps w sparse and shrinks v.
A part of the sample that it doesn't learn from makes z a probability. Documents are scored where they are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm.common import slices, table
from platen.llm.labelled import BoundedMemory, held_out, labelled_sample

#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 4000
#: A term of fewer documents of the sample has no weight: nothing can be told from it.
LEAST_SEEN = 3
FACTORS, BUCKETS = 4, 1 << 22
EPOCHS, BATCH, RATE, L1, L2, START = 25, 64, 0.05, 1e-3, 0.06, 1e-4
#: One in so many documents of the sample calibrates and isn't learned from.
CALIBRATE = 5
THRESHOLD = 0.5
_TERM = re.compile(r"\w+")


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def term_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (label, distinct hashed terms as little-endian 32-bit integers)."""
    memory = BoundedMemory(bucket)
    for b in slices(batches):
        ids = [np.unique(np.fromiter((memory[w] for w in set(_TERM.findall(t.lower()))), "<i4")).tobytes() for t in (x or "" for x in b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["label", "terms"])


@dataclass
class FactorizationMachine:
    terms: dict[int, int]  # hashed term -> row of w and v
    w0: float
    w: np.ndarray
    v: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, rows: list[int] | np.ndarray) -> float:
        z = self.w0
        if len(rows):
            v = self.v[rows]
            s = v.sum(axis=0)
            z += float(self.w[rows].sum() + (s @ s - (v * v).sum()) / 2)
        return float(z)

    def score(self, rows: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(rows) + self.shift, -30, 30))))


def fit(docs: list[np.ndarray], labels: list[int], prior: float, seed: int = 0) -> FactorizationMachine:
    """prior: share of label 1 among all labelled rows, to which the sample is weighted back. Without labels of both kinds nothing can be told apart, and no text is toxic."""
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return FactorizationMachine({}, -4.0, np.zeros(0), np.zeros((0, FACTORS)))
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share)).astype(np.float32)
    rng = np.random.default_rng(seed)
    check = rng.integers(CALIBRATE, size=len(y)) == 0
    if {0.0, 1.0} - set(y[check].tolist()) or {0.0, 1.0} - set(y[~check].tolist()):
        check = np.zeros(len(y), bool)
    ids, seen = np.unique(np.concatenate(docs), return_counts=True)
    ids = ids[seen >= LEAST_SEEN]
    places = [np.searchsorted(ids, d) for d in docs]
    rows = [at[np.append(ids, -1)[at] == d] for at, d in zip(places, docs, strict=True)]
    w0, w, v = float(np.log(prior / (1 - prior))), np.zeros(len(ids), np.float32), rng.normal(0, 0.05, (len(ids), FACTORS)).astype(np.float32)
    # Sums of squared gradients, by which steps are scaled.
    s0, sw, sv = START, np.full(len(ids), START, np.float32), np.full((len(ids), FACTORS), START, np.float32)
    learn = np.flatnonzero(~check)
    for _ in range(EPOCHS):
        order = rng.permutation(learn)
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            sizes = np.array([len(rows[k]) for k in pick])
            at, own = np.concatenate([rows[k] for k in pick]), np.repeat(np.arange(len(pick)), sizes)
            some, x = np.flatnonzero(sizes), v[at]
            first = (np.cumsum(sizes) - sizes)[some]
            s, z = np.zeros((len(pick), FACTORS), np.float32), np.full(len(pick), w0, np.float32)
            if len(some):
                s[some] = np.add.reduceat(x, first)
                z[some] += np.add.reduceat(w[at], first) + ((s[some] ** 2).sum(1) - np.add.reduceat((x * x).sum(1), first)) / 2
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            s0 += float(g.sum()) ** 2
            w0 -= RATE * float(g.sum()) / s0**0.5
            u, inverse = np.unique(at, return_inverse=True)
            if not len(u):
                continue
            gw = np.bincount(inverse, g[own], len(u)).astype(np.float32)
            gv = np.stack([np.bincount(inverse, g[own] * (s[own, f] - x[:, f]), len(u)) for f in range(FACTORS)], 1).astype(np.float32)
            sw[u] += gw * gw
            sv[u] += gv * gv
            step = RATE / np.sqrt(sw[u])
            w[u] = np.sign(new := w[u] - step * gw) * np.maximum(np.abs(new) - step * L1, 0)
            step = RATE / np.sqrt(sv[u])
            v[u] = (v[u] - step * gv) / (1 + step * L2)
    model = FactorizationMachine({int(t): k for k, t in enumerate(ids)}, w0, w, v)
    held = np.flatnonzero(check)
    model.slope, model.shift = calibrated(np.array([model.margin(rows[k]) for k in held]), y[held], weight[held])
    return model


def calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through labels y over z, by Newton steps of bounded length; (1, 0) for none."""
    slope, shift = 1.0, 0.0
    for _ in range(100 if len(z) else 0):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        # One pseudo-row holds both near their start, so that classes told apart wholly give a finite curve.
        step = np.linalg.solve([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.01]], [(g * z).sum() + 0.1 * (slope - 1), g.sum() + 0.01 * shift])
        step *= min(1.0, 1 / max(1e-9, np.abs(step).max()))
        slope, shift = slope - step[0], shift - step[1]
    return max(float(slope), 0.1), float(shift)


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> FactorizationMachine:
    sample, counts = labelled_sample(docs, labels, "toxic", per_class)
    rows = sample.orderBy("doc_id").select("label", "text").mapInArrow(term_ids, "label int, terms binary").collect()
    return fit([np.frombuffer(r["terms"], "<i4") for r in rows], [r["label"] for r in rows], counts.get(1, 0) / max(1, sum(counts.values())))


def scorer(model: FactorizationMachine):
    memory = BoundedMemory(lambda w: model.terms.get(bucket(w), -1))

    def score(text: str | None) -> float:
        found = {memory[w] for w in set(_TERM.findall((text or "").lower()))}
        found.discard(-1)
        return model.score(sorted(found))

    return score


def scores(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A null or empty text gets the score of no terms; repeated rows and null ids each keep their row (a null id is
    held out); an empty table gives no row. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([score(t) for t in b.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs scored below the threshold, with all their columns, whatever they are called.

    A null text is judged as an empty one and stays null. Repeated rows are judged alike. An empty table gives an empty
    result; without labels of both kinds no row goes.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for b in slices(batches):
            yield b.filter(pa.array([score(t) < THRESHOLD for t in b.column(b.schema.get_field_index(text_col)).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, trained(docs, table(spark, sf_dir, "labels")))
