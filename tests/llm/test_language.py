"""Operator 11: PPM code lengths against a plain dictionary version, accuracy on
held-out rows, awkward rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabscope.llm import language as L

from ..conftest import SF01


def folded(text):
    data = re.sub(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]+", b" ", (text or "").encode())
    return data.lower().lstrip(b" ")


def plain_trees(texts):
    tree = defaultdict(Counter)
    for t in texts:
        s = b" " * L.ORDER + folded(t)
        for i in range(L.ORDER, len(s)):
            for o in range(L.ORDER + 1):
                tree[s[i - o:i]][s[i]] += 1
    return tree


def plain_length(tree, text):
    s, bits = b" " * L.ORDER + folded(text), 0
    for i in range(L.ORDER, len(s)):
        for o in range(L.ORDER, -2, -1):
            if o < 0:
                bits += 8 * L.BIT
                break
            seen = tree.get(s[i - o:i])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if s[i] in seen:
                bits += int(np.rint(-np.log2(seen[s[i]] / (total + kinds)) * L.BIT))
                break
            bits += int(np.rint(-np.log2(kinds / (total + kinds)) * L.BIT))
    return bits


TRAIN = {"en": ["the quick brown fox, the dog and the 3 hens", "of the thing that went there"],
         "de": ["der schnelle braune Fuchs über dem Hund", "ein Ding, das dort war; größer"],
         "日": ["日本語 の テキスト です"]}


def test_code_lengths_equal_a_plain_version(spark):
    rows = [(k, t, x) for x, ts in TRAIN.items() for k, t in enumerate(ts)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(TRAIN, key=lambda x: x.encode())
    texts = ["the thing", "über größere Dinge!!  so", "日本 テキ x", "zzz qqq", "", None, "  9 the", "A" * 50, "the fox " * 300]
    n = sum(map(len, TRAIN.values()))
    trees = [(plain_trees(TRAIN[x]), int(np.rint(-np.log2(len(TRAIN[x]) / n) * L.BIT))) for x in model.languages]
    want = [[plain_length(tree, t) + prior for tree, prior in trees] for t in texts]
    for segment in (1 << 20, 7, 1):
        assert model.lengths(pa.array(texts, pa.string()), segment).tolist() == want


def test_held_out_accuracy_and_split(spark):
    got = L.op11_language_id(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    out = [r for r in got if r["held_out"]]
    assert 0.2 < len(out) / len(got) < 0.3
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.99 * len(out)
    assert all(0 <= r["score"] <= 1 and math.isfinite(r["bits"]) for r in got)


def test_only_the_other_rows_are_learned(spark, folder):
    """Labels of held-out rows, sources and ids change nothing."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(300)
    wrong = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert "xx" not in L.train(wrong.where(~L.held_out(F.col("doc_id")))).languages
    dirs = [folder(documents=docs)]
    wrong.write.parquet(f"{dirs[0]}/other/documents.parquet")
    a, b = ({r["doc_id"]: (r["lang_pred"], r["held_out"]) for r in L.op11_language_id(spark, d).collect()} for d in (dirs[0], dirs[0] + "/other"))
    assert a == b


def test_nasty_and_empty(spark, nasty, empty):
    model = L.train(nasty)
    assert model.languages == ["en"]  # NULL languages are not learned
    out = L.identify(nasty, model).collect()
    assert len(out) == nasty.count()
    for r in out:
        blank = not any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"], r["score"]) == (("und", 0.0) if blank else ("en", 1.0))
    assert L.train(empty) is None and L.identify(empty, None).collect() == []
    assert {r["lang_pred"] for r in L.identify(nasty, None).collect()} == {"und"}


def test_letters_of_any_script():
    texts = ["", None, "12 ?", "١٢", "①", "—", "é", "日", "x", "9́"]
    assert L.has_letter(pa.array(texts)).tolist() == [False, False, False, False, False, False, True, True, True, False]


def test_long_text_needs_little_memory():
    import tracemalloc
    model = L.Model(["a"], np.zeros(1, np.int64), [[(np.array([97], np.uint32) if o == 0 else np.array([97 * sum(256 ** k for k in range(o + 1))], np.uint32),
                                                      np.array([3.0])) for o in range(L.ORDER + 1)]])
    text = pa.array(["ab " * 4_000_000])
    tracemalloc.start()
    model.lengths(text)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20  # 12 MB of text
    tracemalloc.stop()


@pytest.mark.parametrize("rows", [1, 50])
def test_sample_is_bounded(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_ROWS", 2 * rows)
    df = spark.createDataFrame([(i, f"text {i % 7}", "ab"[i % 2]) for i in range(400)] + [(1, "same", "a")] * 200, "doc_id long, text string, lang string")
    sample, per = L._sampled(df.withColumn("h", F.xxhash64("doc_id", "text", "lang")))
    assert max(r["count"] for r in sample.groupBy("lang").count().collect()) == rows
    assert {r["lang"]: r["n"] for r in per.collect()} == {"a": 400, "b": 200}
