"""The pipeline: stage by stage on a small corpus, and registration."""

import corpus_pipeline as C
from tabscope.llm import line_dedup, near_dup
from tabscope.session import materialize

from .conftest import COLUMNS, nasty_rows, prose


def corpus(spark, folder):
    rows = [(100 + k, prose(300 + k, 80), "en", f"s{k % 3}", 1) for k in range(40)]
    rows += [(200 + k, prose(300 + k, 80), "en", "s0", 1) for k in range(5)]  # exact copies
    rows += [(300 + k, prose(300 + k, 80, 80).rsplit(" ", 1)[0], "en", "s1", 1) for k in range(10, 15)]  # near copies
    rows += [(400 + k, "### $$$ %%% " * 20 + prose(500 + k, 10), "en", "s2", 1) for k in range(10)]  # junk
    rows += [(500, None, None, None, None), (501, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = [(r[0], 0 if 400 <= r[0] < 500 else 1, 0) for r in rows if r[0] < 500]
    return docs, folder(documents=docs, labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_stages(spark, folder):
    docs, sf = corpus(spark, folder)
    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "tokenize"]
    stage = dict(C.STAGES)
    kept = {}
    for name in names[:-1]:
        docs = materialize(stage[name](spark, docs, sf), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = [r["doc_id"] for r in docs.collect()]
        if name != "quality_rules":
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert not any(k >= 400 for k in kept["quality_rules"])
    assert set(range(100, 140)) <= set(kept["line_dedup"])
    assert not set(range(200, 205)) & set(kept["line_dedup"])  # exact copies
    assert not set(range(310, 315)) & set(kept["near_dedup"])  # near copies
    assert set(range(100, 140)) <= set(kept["near_dedup"])  # clean documents stay
    out = stage["tokenize"](spark, docs, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(kept["mix_sources"])
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)


def test_run_and_empty(spark, folder, tmp_path):
    docs, sf = corpus(spark, folder)
    assert C.run(spark, sf).count() > 0
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in C.STAGES:
        empty = materialize(stage(spark, empty, sf), "test")
        assert empty.count() == 0


def test_dedup_stages_on_nasty_rows(spark, nasty):
    cleaned = near_dup.keep_one(materialize(line_dedup.drop_later_copies(nasty), "test"))
    assert cleaned.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert cleaned.count() <= len(nasty_rows())


def test_short_lines_keep_one_copy(spark):
    rows = [(k, f"home\n{prose(700 + k, 24)}\nread more here\nhome", "en", "s", 1) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    texts = {r["doc_id"]: r["text"].split("\n") for r in C.line_dedup(spark, docs, "").collect()}
    assert texts[0] == rows[0][1].split("\n")[:-1]
    assert all(texts[k] == prose(700 + k, 24).split("\n") for k in range(1, 6))
