"""Byte-level BPE encoding and decoding.

Distinct words are encoded by Spark higher-order functions: a word is an array of its bytes, and a fold merges, as often as there is
one, the pair of neighbours with the lowest rank, looked up in a literal rank map (in hash buckets, as Spark looks
through a map in order). The words are the most frequent of the whole corpus, MOST_WORDS at most, so what is sent to the tasks is
bounded. A text is encoded where it is read, word by word: from that table, and by the same ranked merges for a word that
isn't in it. So nothing but words and their counts is shuffled. Decoding is Spark's: each id's binary piece is looked up in a
literal array, and the pieces of a text are concatenated, in hex digits, as Spark joins arrays of strings in linear time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm.common import cut, table
from platen.llm.tokens import WordMemory, words

#: Words encoded ahead by the fold, at most, and the longest one in bytes.
MOST_WORDS, LONGEST = 200_000, 48
#: Words that a task counts at once before it passes the counts on.
COUNT_WORDS = 300_000
BUCKETS = 1 << 14
#: Counts of words are told apart to 1 / COUNT_STEPS of a doubling when the most frequent are found.
COUNT_STEPS = 16
NO_RANK = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank from a file of lines 'base64 rank' on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """Literal array of BUCKETS maps hex -> rank; a token is in the bucket of its hex digits' CRC-32."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        buckets[zlib.crc32(token.hex().upper().encode()) % BUCKETS][token.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def rank_of(piece: Column, literal: Column) -> Column:
    """Rank of a piece given in hex digits, NO_RANK if it has none."""
    return F.coalesce(F.try_element_at(F.get(literal, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int")), piece), F.lit(NO_RANK))


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merged(word: Column, literal: Column) -> Column:
    """Ids of a word given as binary: the fold of ranked merges over its bytes. A word with a rank of its own is that id.

    The state is the pieces and the rank of each pair of neighbours; a step replaces the first pair of the lowest
    rank by its concatenation and looks up the two pairs that it is in.
    """
    digits, n = F.hex(word), F.length(word)
    start = F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(digits, 2 * k - 1, F.lit(2)))
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda k: rank_of(F.substring(digits, 2 * k - 1, F.lit(4)), literal))

    def step(state: Column, _: Column) -> Column:
        pieces, ranks = state["pieces"], state["ranks"]
        at = lambda k: F.element_at(pieces, k)

        def merge(k: Column) -> Column:
            joined = F.concat(at(k), at(k + 1))
            left = F.when(k > 1, F.array(rank_of(F.concat(at(F.greatest(k - 1, F.lit(1))), joined), literal))).otherwise(F.array().cast("array<int>"))
            right = F.when(k + 1 < F.size(pieces), F.array(rank_of(F.concat(joined, F.get(pieces, k + 1)), literal))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(pieces, F.lit(1), k - 1), F.array(joined), F.slice(pieces, k + 2, F.size(pieces))).alias("pieces"),
                F.concat(F.slice(ranks, F.lit(1), F.greatest(k - 2, F.lit(0))), left, right, F.slice(ranks, k + 2, F.size(pieces))).alias("ranks"),
            )

        least = F.array_min(ranks)
        return F.when(F.coalesce(least, F.lit(NO_RANK)) == NO_RANK, state).otherwise(bound(F.array_position(ranks, least).cast("int"), merge))

    folded = F.aggregate(F.sequence(F.lit(1), n - 1), F.struct(start.alias("pieces"), pairs.alias("ranks")), step, lambda s: F.transform(s["pieces"], lambda p: rank_of(p, literal)))
    own = rank_of(digits, literal)
    return F.when(n == 0, F.array().cast("array<int>")).when((n == 1) | (own != NO_RANK), F.array(own)).otherwise(folded)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; each task adds up what it meets before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return b

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(words(text or ""))
                if len(seen) >= COUNT_WORDS:
                    yield out()
        if seen:
            yield out()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, ranks: dict[bytes, int], text_col: str = "text", most: int = MOST_WORDS) -> dict[str, bytes]:
    """The most frequent words, all from some count on and `most` at most -> their ids as little-endian unsigned 32-bit integers."""
    counts = cut(word_counts(docs, text_col).where(F.octet_length("word") <= LONGEST).withColumn("step", F.floor(F.log2("n") * COUNT_STEPS)))
    least, room = None, most
    for step, n in sorted((tuple(r) for r in counts.groupBy("step").count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        least = step
    if least is None:
        return {}
    top = counts.where(F.col("step") >= least).select("word").repartition(F.col("word"))
    folded = top.select("word", bound(rank_map(ranks), lambda literal: merged(F.col("word").cast("binary"), literal)).alias("ids")).toArrow()
    ids = folded["ids"].combine_chunks()
    at = ids.offsets.to_numpy() * 4
    packed = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    return {w: packed[a:b] for w, a, b in zip(folded["word"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ranked merges for one word of any length: a heap of pairs by rank and place over a linked list of pieces."""
    if word in ranks:
        return [ranks[word]]
    n, rank = len(word), ranks.get
    end = list(range(1, n + 1))  # where the piece that starts here ends
    before = list(range(-1, n))  # where the piece before this one starts
    now = [rank(word[k : k + 2], -1) for k in range(n - 1)] + [-1]  # rank of this piece with the next; -1 for none
    heap = [r * n + k for k, r in enumerate(now) if r >= 0]
    heapify(heap)
    while heap:
        r, k = divmod(heappop(heap), n)
        if now[k] != r:
            continue
        gone = end[k]
        stop = end[k] = end[gone]
        now[gone] = -1
        now[k] = -1
        if stop < n:
            before[stop] = k
            if (r := rank(word[k : end[stop]], -1)) >= 0:
                now[k] = r
                heappush(heap, r * n + k)
        if (p := before[k]) >= 0:
            now[p] = rank(word[p:stop], -1)
            if now[p] >= 0:
                heappush(heap, now[p] * n + p)
    out, k = [], 0
    while k < n:
        out.append(ranks[word[k : end[k]]])
        k = end[k]
    return out


class FoldedWords(dict):
    """word -> ids, from the folded words first, then from a bounded memory of others."""

    def __init__(self, folded: dict[str, bytes], ranks: dict[bytes, int]):
        super().__init__(folded)
        self.others = WordMemory(lambda w: merge_word(w.encode("utf-8", "surrogatepass"), ranks), most=100_000)

    def __missing__(self, word: str) -> bytes:
        return self.others[word]


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their pieces from a literal array, joined."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    literal = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
    return F.unhex(bound(literal, lambda p: F.array_join(F.transform(ids, lambda k: F.get(p, k)), "")))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, ids (array of int) and decoded (binary).

    A null text is an empty one, with no ids. Special tokens are ordinary text. Repeated rows and null ids
    each keep their row; an empty table gives no row. Other columns are not read.
    """
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((frequent_words(docs, ranks, text_col), ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = FoldedWords(*shared.value)
        for b in batches:
            # A few texts at a time, so that no batch of ids is much larger than its texts.
            for low in range(0, b.num_rows, 256):
                made = [b"".join(map(memory.__getitem__, words(t or ""))) for t in b.column(1)[low : low + 256].to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in made])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0)[low : low + 256], pa.array(np.diff(ends).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in made], pa.string()), ids], ["doc_id", "n_tokens", "ids_sha256", "ids"])

    read = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    made = read.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, ids array<int>").withColumn("decoded", decoded(F.col("ids"), ranks))
    return made.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "ids", "decoded")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).drop("ids", "decoded")
