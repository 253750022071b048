"""Operator 12 beyond its SQL: collisions, small tiles, awkward rows, long texts."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tabscope.llm import _terms
from tabscope.llm import divergence as D
from tools.check import rows_of


def by_sql(df, folder_path, min_docs=30):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder_path}/documents.parquet/*.parquet')")
    res = con.execute(D.ORACLE.replace("HAVING count(DISTINCT r) >= 30", f"HAVING count(DISTINCT r) >= {min_docs}"))
    return rows_of([c[0] for c in res.description], res.fetchall())


def rows(out):
    return rows_of(out.columns, [tuple(r) for r in out.collect()])


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "日本"]
    data = []
    for i in range(400):
        lang, source = "ab"[i % 2], f"s{rng.integers(0, 9)}" if i % 3 else "hot"
        p = rng.random(len(words)) ** (2 + i % 3)
        data.append((i, " ".join(rng.choice(words, int(rng.integers(0, 60)), p=p / p.sum())).title(), lang, source))
    data += [(900, None, "a", "empty"), (901, "...", "c", None), (902, "", None, "s1"), (903, "x", None, "s2")]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("bits,tile", [(64, 256), (4, 3), (1, 1)])
def test_collisions_and_tiles_change_nothing(spark, mixed, folder, monkeypatch, bits, tile):
    monkeypatch.setattr(D, "TILE", tile)
    path = folder(documents=mixed)
    assert rows(D.audit(spark.read.parquet(f"{path}/documents.parquet"), min_docs=12, top=50, bits=bits)) == by_sql(mixed, path, 12)


def test_nasty_and_empty(spark, nasty, empty, folder):
    path = folder(documents=nasty)
    for n in (1, 30):
        assert rows(D.audit(nasty, min_docs=n)) == by_sql(nasty, path, n)
    assert D.audit(empty).collect() == []


def test_terms_of_long_texts_in_pieces():
    texts = ["Ab1é" * 3 + " " + "x y " * 40, None, "", "日本語" * 30, "a-b"]
    for table in (_terms.LETTERS, _terms.LETTERS_DIGITS):
        found = []
        for block in (1 << 20, 16, 1):
            count = {}
            for seg in _terms.segments(pa.array(texts), table, block):
                names = seg.terms.to_pylist()
                for r, c in zip(seg.row.tolist(), seg.code.tolist()):
                    count[r, names[c]] = count.get((r, names[c]), 0) + 1
            found.append(count)
        assert found[0] == found[1] == found[2]
        assert found[0][0, b"x"] == 40 and found[0][4, b"b"] == 1


def test_long_text_counts_once(spark, monkeypatch):
    monkeypatch.setattr(_terms, "BLOCK", 64)
    seg = list(_terms.segments(pa.array(["alpha beta " * 50]), _terms.LETTERS, 64))
    assert len(seg) > 3 and seg[0].first and not seg[0].last and seg[-1].last
    docs = spark.createDataFrame([(1, "alpha beta " * 500_000, "a", "s"), (2, "alpha", "a", "t")], "doc_id long, text string, lang string, source string")
    out = {(r["source"], r["part"], r["item"]): r["value"] for r in D.audit(docs, min_docs=2).collect()}
    assert out[("s", "pair", "t")] == 0  # one kept term, both shares are 1
