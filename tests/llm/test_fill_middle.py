"""Fill-in-the-middle against a plain version and SQL, and the wavelet matrix against counting."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from platen.llm import fill_middle, registry

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def plain(doc_id, text, unit):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    ends = {"character": r"(?s).", "word": r"[^\t\x0b\x0c\r \n]+", "sentence": r"(?s).*?[.!?](?=[\t\x0b\x0c\r \n]|\Z)", "line": r".*?\n"}[unit]
    # A unit goes on to the end of its last character; what follows the last one is a unit if anything does.
    stops = [m.end() for m in re.finditer(ends, text)]
    if text and (not stops or stops[-1] < len(text)):
        stops.append(len(text))
    n, at = len(stops), [0, *stops]
    a, b = sorted((at[h1 % (n + 1)], at[h2 % (n + 1)]))
    form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, None if form == "plain" else a, None if form == "plain" else b - a, out, digest(out), digest(text))


TEXTS = [(k, t) for k, t in enumerate([None, "", "a", " ", "\n\n", "One two. Three! four?five \n six\n\nseven", "日本 語。 😀😀 x.", "has <S> in it", "<S", "ends <", "<M>", "word " * 400, "é" * 999 + "\n"] * 8)]


@pytest.mark.parametrize("unit", list(fill_middle.UNITS))
@pytest.mark.parametrize("block", [1, 40, fill_middle.BLOCK])
def test_op12_cuts_whole_units(spark, unit, block):
    rows = [*TEXTS, (None, "no id. At all."), (3, "twice here"), (3, "twice here")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("n", "form", "output")})
    got = sorted((tuple(r) for r in fill_middle.fill_in_middle(df, unit=unit, block=block).collect()), key=repr)
    assert got == sorted((plain(i, t, unit) for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_op12_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    theirs = con.sql(registry.ORACLES["op12_fill_in_middle"]).df()
    ours = registry.QUERIES["op12_fill_in_middle"](spark, SF).toPandas()[list(theirs.columns)]
    as_rows = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert [r.replace(".0", "") for r in as_rows(ours)] == [r.replace(".0", "") for r in as_rows(theirs)]


def test_op12_outputs_give_their_texts_back(spark):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for unit in fill_middle.UNITS:
        for r in fill_middle.fill_in_middle(spark.read.parquet(f"{SF}/documents.parquet"), unit=unit, seed=9).collect():
            assert fill_middle.restored(r.output, r.form) == text[r.doc_id]
            assert r.form == "plain" or sorted(r.output) == sorted("<P><S><M>" + text[r.doc_id])


def test_op12_empty_table_and_unknown_units(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA), unit="page")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_wavelet_matrix_counts(n):
    rng = np.random.default_rng(n)
    s = rng.integers(0, 8, n).astype(np.uint8)
    tree = fill_middle.WaveletMatrix(s)
    for wanted in [(0,), (7,), (1, 2, 5), (4, 5, 6, 7), tuple(range(8)), ()]:
        a = rng.integers(0, n + 1, 50)
        z = rng.integers(a, n + 1)
        assert tree.count(wanted, a, z).tolist() == [int(np.isin(s[i:j], wanted).sum()) for i, j in zip(a, z, strict=True)]
        k = rng.integers(0, 5, 50)
        places = [next((p for p in range(i, j + 1) if np.isin(s[i:p], wanted).sum() >= c), j) for i, j, c in zip(a, z, k, strict=True)]
        assert tree.after_unit(wanted, a, z, k).tolist() == places
