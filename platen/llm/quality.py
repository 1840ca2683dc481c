"""Quality scores: random-indexing word vectors pooled per document, then a calibrated two-layer network.

Words are hashed into buckets. Each bucket has a sparse random index vector; its word vector is the sum of the index vectors
around it over the whole corpus, added up as partial sums per task and then by bucket, so its size never grows. A document is the mean
and spread of its words' vectors. The network learns in numpy from a bounded sample of labelled rows; a
temperature fitted on a part of the sample that it didn't learn from makes its outputs probabilities.
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

from platen.llm.common import table
from platen.llm.labelled import BoundedMemory, held_out, labelled_sample

#: Labelled rows of each class that the network is fitted on, at most.
PER_CLASS = 4000
BUCKETS, DIM, NONZERO, WINDOW = 8192, 32, 4, 2
HIDDEN, STEPS, RATE, L2, CALIBRATE = 32, 400, 0.01, 1e-4, 5
THRESHOLD = 0.3
#: Tokens whose contexts are added up at once.
BLOCK = 1 << 16
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


def token_buckets(text: str | None, memory: BoundedMemory) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, _TOKEN.findall(text or "")), np.int32)


def index_vectors() -> np.ndarray:
    """(BUCKETS + 1) x DIM: +-1 at NONZERO places of each bucket; the last row, between documents, is zero."""
    rng = np.random.default_rng(1)
    v = np.zeros((BUCKETS + 1, DIM), np.float32)
    for row in v[:-1]:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return v


def context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> for each bucket seen by this task: occurrences and the sum of the index vectors around it."""
    memory, index = BoundedMemory(bucket), index_vectors()
    total, seen = np.zeros((BUCKETS + 1, DIM)), np.zeros(BUCKETS + 1, np.int64)
    gap = np.full(WINDOW, BUCKETS, np.int32)

    def add(parts: list[np.ndarray]) -> None:
        ids = np.concatenate([gap, *parts])
        x = index[ids]
        c = np.zeros_like(x)
        for k in range(1, WINDOW + 1):
            c[k:] += x[:-k]
            c[:-k] += x[k:]
        for d in range(DIM):
            total[:, d] += np.bincount(ids, c[:, d], BUCKETS + 1)
        seen[:] += np.bincount(ids, minlength=BUCKETS + 1)

    held, n = [], 0
    for b in batches:
        for text in b.column(0).to_pylist():
            ids = token_buckets(text, memory)
            held += [ids, gap]
            n += len(ids)
            if n >= BLOCK:
                add(held)
                held, n = [], 0
    if held:
        add(held)
    rows = np.flatnonzero(seen[:-1])
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(seen[rows]), *(pa.array(total[rows, d].astype(np.int64)) for d in range(DIM))], ["bucket", "n", *(f"c{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIM unit vectors (zero for a bucket not seen) from all texts of docs."""
    kinds = "bucket int, n long, " + ", ".join(f"c{d} long" for d in range(DIM))
    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(context_sums, kinds).groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(f"c{d}").alias(f"c{d}") for d in range(DIM)))
    got = sums.toArrow()
    v, n = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    at = got["bucket"].to_numpy()
    n[at] = got["n"].to_numpy()
    for d in range(DIM):
        v[at, d] = got[f"c{d}"].to_numpy()
    # Without the corpus's own direction, which every vector shares, the rest tells words apart.
    common = v.sum(axis=0) / max(1.0, n.sum())
    v = np.where(n[:, None] > 0, v / np.maximum(n, 1)[:, None] - common, 0)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, memory: BoundedMemory) -> np.ndarray:
    """Mean and standard deviation of the word vectors, and the logarithm of the number of words; zeros for none."""
    ids = token_buckets(text, memory)
    out = np.zeros(2 * DIM + 1, np.float32)
    if len(ids):
        x = vectors[ids]
        out[:DIM], out[DIM : 2 * DIM], out[-1] = x.mean(axis=0), x.std(axis=0), np.log1p(len(ids)) / 10
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, prior: float, seed: int = 0) -> Network:
    """prior: share of label 1 among all labelled rows, to which the sample is weighted back."""
    n_in = x.shape[1]
    share = float(y.mean()) if len(y) else 1.0
    if share in (0.0, 1.0):
        return Network(np.zeros(n_in), np.ones(n_in), np.zeros((n_in, 1)), np.zeros(1), np.zeros(1), 4.0 if share else -4.0)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share)).astype(np.float32)
    rng = np.random.default_rng(seed)
    part = rng.integers(CALIBRATE, size=len(y))
    learn, check = part > 0, part == 0
    if not learn.any() or not check.any():
        learn = check = np.ones(len(y), bool)
    mean, scale = x[learn].mean(0), x[learn].std(0) + 1e-3
    z, t, m = (x[learn] - mean) / scale, y[learn].astype(np.float32), weight[learn] / weight[learn].sum()
    p = [rng.normal(0, (2 / n_in) ** 0.5, (n_in, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN).astype(np.float32), np.array([np.log(prior / (1 - prior))], np.float32)]
    first, second = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, STEPS + 1):
        a = z @ p[0] + p[1]
        h = np.maximum(a, 0)
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) * m
        back = g[:, None] * p[2] * (a > 0)
        for q, dq, u, v in zip(p, [z.T @ back + L2 * p[0], back.sum(0), h.T @ g + L2 * p[2], np.array([g.sum()])], first, second, strict=True):
            u += 0.1 * (dq - u)
            v += 0.001 * (dq * dq - v)
            q -= RATE * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    s, c, k = net.logits(x[check]), y[check], weight[check]
    loss = lambda t: float((k * np.logaddexp(0, np.where(c == 1, -s, s) / t)).sum())
    net.temperature = min(np.exp(np.linspace(-1, 3, 81)), key=loss)
    return net


def pooled_rows(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(key columns..., text) -> (key columns..., pooled): the text is the last column."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    keys = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = BoundedMemory(bucket)
        for b in batches:
            made = [pooled(t, shared.value, memory).tobytes() for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), pa.array(made, pa.binary())], [*keys, "pooled"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]) + ", pooled binary")


def trained(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, per_class: int = PER_CLASS) -> Network:
    sample, counts = labelled_sample(docs, labels, "quality", per_class)
    rows = pooled_rows(sample.select("doc_id", "label", "text"), vectors).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["pooled"])))
    x = np.array([np.frombuffer(r["pooled"], np.float32) for r in rows]).reshape(len(rows), 2 * DIM + 1)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit(x, np.array([r["label"] for r in rows]), prior)


def scores(docs: DataFrame, vectors: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. A null or empty text gets the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = BoundedMemory(bucket)
        v, net = shared.value
        for b in batches:
            x = np.array([pooled(t, v, memory) for t in b.column(2).to_pylist()]).reshape(b.num_rows, 2 * DIM + 1)
            p = net.probabilities(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p.astype(np.float64), pa.float64())], ["doc_id", "held_out", "score"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = word_vectors(docs)
    return scores(docs, vectors, trained(docs, table(spark, sf_dir, "labels"), vectors))
