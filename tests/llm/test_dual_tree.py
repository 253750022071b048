"""Operator 13 against all pairs scored plainly: ties, hierarchies, pruning, awkward rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tabscope.llm import dual_tree as D

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = set()
    for item, text in items:
        found = []
        for i, c in tf:
            n, score = sum(c.values()), 0
            for t in terms(text):
                if t in c:
                    m = 25 + 75 * n * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out |= {(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(found[:k])}
    return out


def corpus(n_docs=700, n_items=90, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    def text(n):
        return " ".join(rng.choice(words, n, p=p / p.sum()))
    items = [(i, text(int(rng.integers(3, 25)))) for i in range(n_items)]
    docs = [(i, text(int(rng.integers(0, 80)))) for i in range(n_docs)]
    docs += [(5000 + i, items[i % n_items][1] + " " + text(9)) for i in range(200)]
    docs += [(7000 + i, docs[7][1]) for i in range(40)]  # a group of copies: ties
    return docs, items


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    return {tuple(r) for r in D.search(d, q, **kw).select("item_id", "rank", "doc_id", "score").collect()}


@pytest.mark.parametrize("cells,seed,exact", [(4 << 20, 64, 1 << 53), (600, 2, 1 << 53), (4 << 20, 64, 1)])
def test_equals_all_pairs(spark, monkeypatch, cells, seed, exact):
    """Also with small tiles of items, other seeds, and 64-bit integers."""
    monkeypatch.setattr(D, "CELLS", cells)
    monkeypatch.setattr(D, "SEED", seed)
    monkeypatch.setattr(D, "EXACT", exact)
    docs, items = corpus()
    assert run(spark, docs, items) == plain(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEM_BYTES", 1)
    docs, items = corpus(n_docs=60, n_items=20)
    many = [(i, items[i % 20][1] if i % 50 == 0 else "w1") for i in range(1100)]
    assert run(spark, docs, many, k=3) == plain(docs, many, k=3)


def test_nasty_and_empty(spark, nasty, empty):
    docs = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    items = [(1, docs[0][1]), (2, None), (3, ""), (4, "one ONE same x"), (None, "mail a.b@c"), (4, "one ONE same x")]
    q = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in D.search(nasty, q).select("item_id", "rank", "score").fillna(-1).collect())
    want = []
    for item, text in items:
        want += [(-1 if item is None else item, r, s) for _, r, _, s in plain(docs, [(item, text)])]
    assert got == sorted(want)
    assert D.search(empty, q).collect() == [] and D.search(nasty, q.limit(0)).collect() == []


def test_whole_batches_are_pruned():
    """With k-th scores known, pairs of nodes go without being scored."""
    rng = np.random.default_rng(1)
    vectors = [(np.arange(10 * i, 10 * i + 10), np.full(10, 1000)) for i in range(64)]
    tile, = D.make_tiles(vectors, 640)
    docs = [np.sort(rng.choice(np.arange(10 * i, 10 * i + 10), 6, False)) for i in np.repeat(np.arange(64), 40)]
    first = np.r_[0, np.cumsum([len(d) for d in docs])]
    best, count = D.Best(64, 10, np.full(64, 5000 * 600)), [0, 0]
    ids = np.arange(len(docs))
    D.search_batch(tile, first, np.concatenate(docs), np.full(first[-1], 600), ids, ids < 0, best, count)
    assert all(len(r[0]) == 10 and (r[0] == 6000 * 600).all() for r in best.rows)
    assert count[1] <= 0.3 * count[0]


def test_long_document(spark, monkeypatch):
    docs = [(1, "apple pear " * 400_000 + "plum"), (2, "plum"), (3, "pear plum")]
    items = [(1, "plum pear"), (2, "apple")]
    assert run(spark, docs, items) == plain(docs, items)
