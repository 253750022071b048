"""Operator 7 against all pairs, and on awkward rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tabscope.llm import near_dup as N

from .conftest import nasty_rows, prose


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """{row number: (n, component's smallest id)} by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    best = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        best[r] = min((x for x in (best.get(r), key) if x is not None), default=None)
    return sorted((str(key), len(sets[i]), str(best[root(i)] if sets[i] else key)) for i, (key, _) in enumerate(rows))


def variants(n, seed, low, high):
    """Texts that differ from one base in a few words out of a small set."""
    rng = random.Random(seed)
    base = prose(seed, 120).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(low, high)):
            w[rng.randrange(len(w))] = rng.choice(("alpha", "beta", "gamma"))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("pivots, edges", [(1024, 1_000_000), (2, 20)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, pivots, edges):
    monkeypatch.setattr(N, "PIVOTS", pivots)
    monkeypatch.setattr(N, "EDGES", edges)
    texts = variants(120, 1, 0, 8) + variants(60, 2, 2, 5) + [prose(50 + k) for k in range(40)]
    texts += [t.upper() for t in texts[:20]] + texts[5:15]
    random.Random(3).shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = N.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(rows)


def test_shingles_that_many_share_do_not_bring_pairs(spark, monkeypatch):
    """Texts of one template with one of four passages and a tail of their own: none
    is linked with another but by a late edit, so few pairs need a comparison."""
    base, passages = prose(70, 100).split(), [prose(71 + k, 14).split() for k in range(4)]
    tails = [[f"t{k}x{i}" for i in range(16)] for k in range(80)]
    texts = [" ".join(base + passages[k % 4] + t) for k, t in enumerate(tails)]
    texts += [t.rsplit(" ", 1)[0] + " edited" for t in texts[:10]]
    rows, compared, verify = list(enumerate(texts)), [], N._verify

    def counted(pairs, *args, **kwargs):
        compared.append(pairs.count())
        return verify(pairs, *args, **kwargs)

    monkeypatch.setattr(N, "_verify", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = N.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(rows)
    assert len({r[2] for r in got}) == 80  # the edited ones are found, beside any pivot
    assert sum(compared[1:]) <= len(texts)  # after those with the pivots


def test_nasty(spark, nasty):
    got = N.near_duplicates(nasty).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute([r[:2] for r in nasty_rows()])


def test_keep_one(spark, nasty):
    kept = N.keep_one(nasty)
    assert kept.columns == nasty.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 9 not in ids  # one of each group
    assert {4, 5, 6, 7, 10, 13, 17, 18} <= set(ids)  # others and texts without words stay


def test_empty(spark, empty):
    assert N.near_duplicates(empty).count() == 0 and N.keep_one(empty).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for n, share in ((400, 0.9), (60, 0.5), (1, 1.0)):
        err = []
        for k in range(40):
            a = rng.choice(pool, 2 * n, replace=False)
            x, y = a[:n], np.r_[a[:round(n * share)], a[n:2 * n - round(n * share)]]
            h = np.r_[x, y]
            sig = N.superminhash(h, np.r_[np.zeros(len(x), int), np.ones(len(y), int)], 2)
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            err.append(float((sig[0] == sig[1]).mean()) - true)
        assert abs(np.mean(err)) < 0.04


def test_shingle_sets():
    texts = [t for _, t, *_ in nasty_rows()]
    h, row, rows = N.shingle_sets(pa.array(texts))
    assert np.bincount(row, minlength=rows).tolist() == [len(shingles(t)) for t in texts]


def test_bands_catch_pairs_at_the_threshold():
    assert N.band_count(85) == 16 and N.band_count(80) == 21  # 4 and 3 ranks each
    for percent in (50, 70, 80, 85, 95, 100):
        bands = N.band_count(percent)
        assert (1 - (percent / 100) ** (N.SLOTS // bands)) ** bands <= 1e-5


def test_keep_one_drops_copies_from_80_percent(spark):
    """Pairs of 56 shingles with 51 (0.836) and 49 (0.778) in common."""
    rows = []
    for k in range(30):
        w = prose(800 + k).split()
        rows += [(k, " ".join(w)), (100 + k, " ".join(w[:-5] + [f"x{i}" for i in range(5)])),
                 (200 + k, " ".join(["y1", "y2"] + w[2:-5] + [f"z{i}" for i in range(5)]))]
    sim = [[len(a & b) / len(a | b) for a, b in ((shingles(x), shingles(y)), (shingles(x), shingles(z)))]
           for (_, x), (_, y), (_, z) in zip(rows[::3], rows[1::3], rows[2::3])]
    assert all(0.8 <= a < 0.85 and b < 0.8 for a, b in sim)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(r["doc_id"] for r in N.keep_one(df).collect()) == [*range(30), *range(200, 230)]
    assert N.keep_one(df, percent=85).count() == 90


def test_keep_one_keeps_one_row_of_each_group(spark):
    a, b, c, d = (prose(900 + k) for k in range(4))
    near = [t.rsplit(" ", 1)[0] + " changed" for t in (a, b, c, d)]
    rows = [(1, a, "x")] * 40 + [(1, a, "w")]  # one row repeated, and its text with another column
    rows += [(2, b, "x"), (2, near[1], "x")]  # near texts under one id
    rows += [(None, c, "x"), (None, c, "x"), (None, near[2], "x")]  # a group of NULL ids
    rows += [(None, d, "x"), (7, near[3], "x")]
    rows += [(8, "", "x"), (8, "", "x"), (9, " \n", "x"), (None, None, "x")]  # no words: all stay
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    kept = [tuple(r) for r in N.keep_one(df).collect()]
    assert len(kept) == 8 and set(kept) <= set(rows)
    groups = [{a}, {b, near[1]}, {c, near[2]}, {d, near[3]}]
    assert [sum(t in g for _, t, _ in kept) for g in groups] == [1, 1, 1, 1]
    assert sorted(str(i) for i, t, _ in kept if t and t.strip()) == ["1", "2", "7", "None"]
    assert kept.count((8, "", "x")) == 2
