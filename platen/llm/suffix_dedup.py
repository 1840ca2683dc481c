"""Removes every byte covered by a 100-byte string that starts earlier in the corpus, by prefix-free parsing.

1. Parse: rolling-hash triggers cut each text into phrases (phrases.py); a phrase stands for all the windows of its trigger.
   A trigger string seen once in the corpus has only windows seen once, and goes no further.
2. Dictionary: the distinct phrases, each with its first place in the corpus. Every later copy repeats all its windows.
3. Phrases that share a trigger but differ may share some windows. The windows of such dictionary phrases are grouped by the
   bytes they must share and by their ends, in hashes; of equal windows all but the first in corpus order are repeats.

A suffix array would bring equal windows side by side by sorting; only equality on WINDOW bytes and the first place matter here, so
windows are grouped and their least place taken, which Spark adds up in parts. No suffix array of dictionary or parse is made.

Everything is keyed by hashes of 128 bits in all (trigger and phrase; shared bytes and ends). Frequent keys are aggregated
before they are shuffled, and joins back to them are ones Spark can split.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm.common import cut, release, slices, table
from platen.llm.phrases import WINDOW, RollingHash, phrases

#: Windows are compared in classes by the number of bytes before their trigger: STEP numbers a class. Those of a class share CORE bytes.
CLASSES, STEP = 4, 20
CORE = WINDOW - STEP + 1
_ROWS = pa.schema([("key", pa.int64()), ("phrase", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])
_CLASS = pa.schema([("core", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("before", pa.int32()), ("ends", pa.binary())])


def tag(text: bytes) -> int:
    """Tells rows of one id with different texts apart."""
    return zlib.crc32(text) & 0x7FFF


def places(tag_: int, first: np.ndarray, n: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One number per run of n windows; numbers of a document's runs are in the order of their starts."""
    return (np.int64(tag_) << 48) | (first.astype(np.int64) << 14) | (n.astype(np.int64) << 7) | before.astype(np.int64)


def run_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tag, first window, windows, bytes before the trigger in the first window)."""
    return place >> 48, (place >> 14) & ((1 << 34) - 1), (place >> 7) & 127, place & 127


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) -> a row for each phrase."""
    for b in slices(batches):
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = as_bytes(text)
            key, phrase, first, n, trigger = phrases(raw)
            for c, x in zip(cols, (key.view(np.int64), phrase.view(np.int64), np.full(len(key), doc, np.int64), places(tag(raw), first, n, trigger - first)), strict=True):
                c.append(x)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], schema=_ROWS)


def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, places of phrases) -> a row for each class of a phrase's windows: hash of the bytes they share, their run, bytes before, and the STEP - 1 bytes on either side of the shared ones."""
    for b in slices(batches):
        out: list[list] = [[], [], [], [], []]
        for doc, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            raw = as_bytes(text)
            own, first, n, before = run_of(at.values.to_numpy(zero_copy_only=False))
            mine = own == tag(raw)
            first, n, trigger = first[mine], n[mine], (first + before)[mine]
            if not len(first):
                continue
            sums = RollingHash(np.frombuffer(raw, np.uint8), 1)
            padded = bytes(STEP) + raw + bytes(STEP)
            for c in range(CLASSES):
                low = np.maximum(first, trigger - (c + 1) * STEP + 1)
                count = np.minimum(first + n - 1, trigger - c * STEP) - low + 1
                use = count > 0
                low, count, t = low[use], count[use], trigger[use]
                start = t - c * STEP
                core = sums.of(start, start + CORE) + np.uint64(c)
                out[0].append(core.view(np.int64))
                out[1].append(np.full(len(low), doc, np.int64))
                out[2].append(places(tag(raw), low, count, t - low))
                out[3].append((start - low).astype(np.int32))
                out[4] += [padded[s + 1 : s + STEP] + padded[s + STEP + CORE : s + 2 * STEP + CORE - 1] for s in start.tolist()]
        if out[4]:
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out[:4]), pa.array(out[4], pa.binary())], schema=_CLASS)


def repeats(docs: DataFrame) -> DataFrame:
    """docs (doc, text) -> (doc, places): the runs of windows of each document that start earlier in the corpus."""
    spark = docs.sparkSession
    rows = docs.mapInArrow(parsed, "key long, phrase long, doc long, place long")
    # Counts are cut off before each join to them: only a join of two shuffles can be split where a key is frequent.
    often = cut(rows.groupBy("key").agg(F.count("*").alias("seen")).where("seen > 1"))
    release(spark)
    shared = cut(rows.join(often, "key"))
    del often
    release(spark)

    dictionary = cut(shared.groupBy("key", "phrase").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("copies"), F.max("seen").alias("seen")))
    whole = shared.join(dictionary.where("copies > 1").select("key", "phrase", "first"), ["key", "phrase"]).where(F.struct("doc", "place") != F.col("first"))
    whole = cut(whole.select("doc", "place"))
    differing = cut(dictionary.where("copies < seen").groupBy("first.doc").agg(F.collect_list("first.place").alias("at")))
    del shared, dictionary
    release(spark)

    classes = cut(docs.join(differing, "doc").select("doc", "text", "at").mapInArrow(classed, "core long, doc long, place long, before int, ends binary"))
    del differing
    release(spark)
    alike = cut(classes.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    classes = cut(classes.join(alike, "core"))
    del alike
    release(spark)
    # The window with k bytes before the shared ones differs from others of its class in STEP - 1 bytes of the ends alone.
    window = classes.select("core", "doc", "place", "ends", F.posexplode(F.sequence("before", F.col("before") - F.shiftright("place", 7).bitwiseAND(127).cast("int") + 1, F.lit(-1))).alias("k", "left"))
    start = F.col("place").bitwiseAND(F.lit((0x7FFF << 48) | (((1 << 34) - 1) << 14))) + F.shiftleft(F.col("k").cast("long"), 14)
    window = window.select("core", F.xxhash64(F.substring("ends", F.lit(STEP) - F.col("left"), F.lit(STEP - 1)), "left").alias("end"), "doc", start.alias("start"))
    order = window.groupBy("core", "end").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    order = cut(order.select("core", "end", F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start")))
    release(spark)
    part = window.join(order, ["core", "end"]).where("doc != first_doc OR start != first_start")
    part = part.select("doc", (F.col("start") + (1 << 7)).alias("place"))
    found = cut(whole.union(part).groupBy("doc").agg(F.collect_list("place").alias("places")))
    del classes, window, whole, order, part
    release(spark)
    return found


def removed_spans(raw: bytes, found: np.ndarray | None) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of bytes that the repeated windows cover."""
    if found is None or not len(found):
        return []
    own, first, n, _ = run_of(found)
    mine = own == tag(raw)
    start, end = first[mine], (first + n + WINDOW - 1)[mine]
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    if not len(start):
        return []
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return list(zip(start[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist(), strict=True))


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of raw without the spans."""
    edges = [0, *(e for span in spans for e in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with two more columns, the last: its id for joins and the places of its repeats. A null id is the smallest."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    found = repeats(docs.select(doc.alias("doc"), F.col(text_col).cast("string").alias("text")))
    keyed = docs.select(*docs.columns, doc.alias("__doc"))
    return keyed.join(found.withColumnsRenamed({"doc": "__doc", "places": "__places"}), "__doc", "left").select(*docs.columns, "__places")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end) and kept (the bytes left).

    Earlier is a smaller id, or an earlier start in the same text. A null text is an empty one, and a text of under 100 bytes stays
    whole. A null id comes before all ids. Rows that repeat an id and its text are one document read twice: each loses what
    is repeated elsewhere earlier, none loses what only they share. Rows of one id with different texts
    are told apart by a checksum. An empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                raw = as_bytes(text)
                spans = removed_spans(raw, found.values.to_numpy(zero_copy_only=False) if found.is_valid else None)
                kept = kept_bytes(raw, spans)
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans] if with_kept else None, kept if with_kept else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    read = _with_places(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text")
    return read.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with each text reduced to what is kept (a character cut in two goes), and its length; all else as it was."""
    text_at, size_at = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = list(b.columns[:-1])
            texts = []
            for text, found in zip(b.column(text_at).to_pylist(), b.columns[-1], strict=True):
                spans = removed_spans(raw := as_bytes(text), found.values.to_numpy(zero_copy_only=False)) if found.is_valid else []
                texts.append(kept_bytes(raw, spans).decode("utf-8", "ignore") if spans else text)
            cols[text_at] = pa.array(texts, cols[text_at].type)
            if size_at is not None:
                cols[size_at] = pa.array([None if t is None else len(t) for t in texts], cols[size_at].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return _with_places(docs, id_col, text_col).mapInArrow(run, docs.schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"), with_kept=False).drop("spans", "kept")
