"""Operators 2 and 4 against plain versions, and on awkward rows."""

import random
import re

import numpy as np
import pyarrow as pa

from tabscope.llm import line_dedup as L
from tabscope.llm import substring_dedup as S
from tabscope.llm._text import Words, utf8

from .conftest import nasty_rows, prose


def later_lines(rows, least):
    """{(row, line): …} deleted lines by the definition: for each position the
    longest run that occurs at an earlier position."""
    seqs = []
    for _, t in rows:
        seqs.append([x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    where = [(d, i) for d, s in enumerate(seqs) for i in range(len(s))]
    gone = set()
    for a, (d, i) in enumerate(where):
        best = 0
        for e, j in where[:a]:
            n = 0
            while i + n < len(seqs[d]) and j + n < len(seqs[e]) and seqs[d][i + n] == seqs[e][j + n]:
                n += 1
            best = max(best, n)
        run = seqs[d][i:i + best]
        if sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run) >= least:
            gone |= {(d, i + k + 1) for k in range(best)}
    return gone


def test_line_runs_are_those_of_the_definition(spark):
    rng = random.Random(5)
    lines = ["a", "b c", "d e f g", "h " * 9, "i " * 12, "", "  ", "j k l"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    _, gone = L.later_copies(df)
    got = {(r["id0"], r["e"]) for r in gone.collect()}
    assert got == later_lines(rows, L.MIN_WORDS) and got


def test_line_dedup_nasty(spark, nasty):
    out = L.drop_later_copies(nasty)
    assert out.columns == nasty.columns
    rows = out.collect()
    texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] not in (None, 14, 15)}
    assert texts[1] == prose(1) and texts[4] == prose(2) and texts[10] == prose(3, 30_000)
    assert 2 not in texts and 11 not in texts  # nothing is left of exact copies
    assert texts[5] is None and texts[6] == "" and texts[7] == " \n\t " and texts[8] == texts[9] == "one"
    assert sum(r["doc_id"] == 14 for r in rows) == 2  # a repeated row is one document
    report = {r["doc_id"]: r for r in L.line_report(nasty).collect()}
    assert report[2]["n_deleted"] == report[2]["n_lines"] == 5 and report[2]["deleted"] == "1-5"
    assert L.line_report(nasty).count() == len(nasty_rows())


def test_line_dedup_empty(spark, empty):
    assert L.drop_later_copies(empty).count() == 0 and L.line_report(empty).count() == 0


def test_gear_is_a_rolling_hash_of_its_window():
    data, off = utf8(pa.array([prose(1, 200), "", "ab", prose(2, 50)]))
    got = S.gear_hashes(data, off)
    for a, b in zip(off[:-1], off[1:]):
        h = 0
        for k in range(a, b):
            h = (h << 1) + int(S._GEAR[data[k]]) & 0xFFFFFFFF
            if k - a < S.WINDOW:  # before that the whole history is in the window
                assert got[k] == h
    tail = data[:60]
    moved, moff = utf8(pa.array(["xyz " + bytes(tail).decode()]))
    assert (S.gear_hashes(moved, moff)[4 + S.WINDOW:64] == got[S.WINDOW:60]).all()


def test_chunks_cover_texts_and_resist_shifts():
    texts = [t for _, t, *_ in nasty_rows()]
    words = Words(*utf8(pa.array(texts)))
    row, at, n, digest = S.chunks(words)
    assert np.bincount(row, weights=n, minlength=len(texts)).tolist() == np.diff(words.first).tolist()
    a = prose(20, 400)
    b = "some words before " + a.replace(a.split()[200], "changed", 1)
    row, at, n, digest = S.chunks(Words(*utf8(pa.array([a, b]))))
    shared = set(digest[row == 0]) & set(digest[row == 1])
    assert len(shared) > 0.8 * (row == 0).sum() and n.max() <= S.LONGEST


def planted(n_texts=120, passage=51):
    rng = random.Random(9)
    rows, hit = [], set()
    for k in range(n_texts):
        body = prose(1000 + k, 90).split()
        if k % 3 == 0:
            cut = rng.randrange(len(body))
            body[cut:cut] = prose(7 + k % 2, passage).split()
            if k >= 6:
                hit.add(k)
        rows.append((k, " ".join(body)))
    return rows, hit


def test_passages_over_50_words_are_caught(spark):
    rows, hit = planted()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["id0"]: r for r in S.repeated_spans(df).collect()}
    assert set(got) == hit
    for k, r in got.items():
        assert r["n_removed"] >= S.MIN_WORDS and min(r["sources"]) < 6
    clean = {r["doc_id"]: r["text"] for r in S.drop_repeats(df).collect()}
    for k, t in rows:
        left = clean[k].split()
        if k in hit:
            assert len(t.split()) - len(left) == got[k]["n_removed"]
        else:
            assert clean[k] == t


def test_substring_nasty_and_empty(spark, nasty, empty):
    out = S.drop_repeats(nasty)
    assert out.columns == nasty.columns and out.count() == len(nasty_rows())
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[2] == "" and texts[1] == prose(1) and texts[5] is None and texts[6] == ""
    assert len(texts[16].split()) < 400  # one word over and over repeats itself
    assert S.drop_repeats(empty).count() == 0
