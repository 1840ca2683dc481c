"""The pipeline against a plain version of its stages."""

import re

import pytest

from platen.llm import exact_dedup, packing, suffix_dedup, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def brute_kept(texts):
    """Ids that stay, the smallest of each group, when all pairs whose sets of five-word shingles are 0.8 alike or more are linked."""
    sets, root = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d for d in texts if find(d) == d}


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.scores(docs, toxicity.trained(docs, labels)).where("predicted = 1").collect()}
    kept = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    last = {t: d for d, t in sorted(kept.items())}
    kept = {d: t for t, d in last.items()}
    stays = brute_kept(kept)
    kept = {d: t for d, t in sorted(kept.items()) if d in stays}
    seen, bare = set(), {}
    for d, t in kept.items():
        raw = t.encode()
        covered = bytearray(len(raw))
        for j in range(len(raw) - 99):
            if raw[j : j + 100] in seen:
                covered[j : j + 100] = b"\1" * 100
            seen.add(raw[j : j + 100])
        bare[d] = bytes(x for x, c in zip(raw, covered, strict=True) if not c).decode("utf-8", "ignore")
    want = {(r.doc_id, r.piece): r.ids_crc32 for r in packing.pack(spark.createDataFrame(list(bare.items()), "doc_id long, text string"), corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got} == want and len(got) == len(want)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()
    assert exact_dedup.drop_duplicates(docs).count() < docs.count()
    assert suffix_dedup.without_repeats(docs).where("n_chars != length(text)").count() == 0
