"""Near copies against brute-force Jaccard of five-word shingles."""

import re
from collections import defaultdict

import numpy as np
import pytest

from platen.llm import near_copies

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def brute_kept(texts):
    """Ids that stay when all pairs of texts 0.8 alike or more are linked."""
    sets, root = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    at = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            at[x].append(d)
    for d in sorted(texts):
        for e in {e for x in sets[d] for e in at[x] if e < d}:
            both = len(sets[d] & sets[e])
            if both >= 0.8 * (len(sets[d]) + len(sets[e]) - both) and find(d) != find(e):
                root[max(find(d), find(e))] = min(find(d), find(e))
    return {d for d in texts if find(d) == d}


def edited(rng, words, share):
    """words with about `share` of their five-word shingles changed."""
    own = list(words)
    for k in rng.choice(len(own), int(share * len(own) / 5), replace=False):
        own[k] = f"new{rng.integers(10**6)}"
    return " ".join(own)


def corpus():
    rng, texts = np.random.default_rng(7), {}
    made = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    for g in range(40):
        words = made(rng.integers(20, 900))
        for share in (0, 0.05, 0.12, 0.19, 0.24, 0.4):
            texts[len(texts)] = edited(rng, words, share)
    hot, line = made(300), made(60)
    for k in range(60):
        texts[len(texts)] = edited(rng, hot, 0.08)
        texts[len(texts)] = " ".join(line + made(40))
    return texts


@pytest.mark.parametrize(("max_shard", "meeting"), [(near_copies.MAX_SHARD, near_copies.MEETING), (8, near_copies.MEETING), (2, 7), (1, 1)])
def test_near_copies_are_those_of_brute_force(spark, max_shard, meeting):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = [r.doc_id for r in near_copies.drop_near_copies(df, max_shard=max_shard, meeting=meeting).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_kept(texts)


def test_shards_of_long_texts_are_split_by_shingles(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(near_copies, "MAX_SHINGLES", 500)
    assert {r.doc_id for r in near_copies.drop_near_copies(df).collect()} == brute_kept(texts)


def test_texts_that_share_a_passage_are_told_apart(spark):
    """A passage of 52 words in every text, 19 words of its own and some near copies among them: the passage brings nothing together."""
    rng = np.random.default_rng(9)
    shared = [f"s{k}" for k in range(52)]
    texts = {k: " ".join([*(f"w{x}" for x in rng.integers(0, 10**6, 19)), *shared]) for k in range(1500)}
    texts |= {10_000 + k: texts[k] + " end" for k in range(0, 1500, 50)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in near_copies.drop_near_copies(df).collect()}
    assert got == set(range(1500)) == brute_kept({k: texts[k] for k in texts if k % 50 == 0}) | set(range(1500))


def test_the_rarest_shingles_are_enough(spark):
    """Whatever the order of rarity, two sets 0.8 alike share one of those kept."""
    rng = np.random.default_rng(10)
    for _ in range(500):
        n = int(rng.integers(1, 40))
        both, one, two = (np.unique(rng.integers(0, 2**63, k, np.uint64)) for k in (n, rng.integers(0, n // 4 + 1), rng.integers(0, n // 4 + 1)))
        a, b = np.union1d(both, one), np.union1d(both, two)
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            values = np.sort(rng.permutation(np.union1d(a, b))[: n // 2])
            frequent = values, rng.integers(2, 50, len(values))
            assert len(np.intersect1d(near_copies.rarest(a, frequent, 0.8), near_copies.rarest(b, frequent, 0.8)))


def test_the_stage_leaves_no_near_copy_in_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.exact_dedup(spark, docs, "")
    texts = {r.doc_id: r.text for r in kept.collect()}
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, kept, "").collect()}
    assert got == brute_kept(texts) and len(got) < len(texts)


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(1, text), (1, text), (None, text + " x"), (2, text + " y"), (1, "another text of its own"), (None, "no id"), (None, "no id"), (3, None), (None, "")]
    got = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, text), (1, "another text of its own"), (None, "no id"), (3, None)], key=str)
    assert near_copies.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
