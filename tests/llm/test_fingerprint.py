"""Operator 3: algebra of the fingerprints, edited texts, awkward rows."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tabscope.llm import fingerprint as P

from .conftest import nasty_rows, prose


def lanes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    return {r["k"]: r["lanes"] for r in P.fingerprints(df, ["k"], "t").collect()}


def test_order_independent_and_homomorphic(spark):
    paras = [prose(k, 30, 30) for k in range(6)]
    mixed = paras[:]
    random.Random(1).shuffle(mixed)
    got = lanes(spark, ["\n".join(paras), "\n".join(mixed), "\n".join(paras[:-1]), paras[-1],
                        "\n".join(paras + paras[-1:])])
    assert got[0] == got[1] and got[0] != got[2] and got[0] != got[4]  # a multiset, not a set
    row = spark.createDataFrame([(got[2], got[3], got[0], got[4])], "a array<bigint>, b array<bigint>, "
                                "c array<bigint>, d array<bigint>")
    r = row.select(P.combine(F.col("a"), F.col("b")), P.combine(F.col("c"), F.col("b"), -1),
                   P.combine(F.col("c"), F.col("b"))).first()
    assert r[0] == got[0] and r[1] == got[2] and r[2] == got[4]


def test_likeness_follows_shared_words(spark):
    words = prose(1, 600, 40).split("\n")
    texts = ["\n".join(words)] + ["\n".join(words[:k] + prose(90 + k, 600, 40).split("\n")[k:]) for k in (14, 10, 5, 0)]
    got = lanes(spark, texts)
    df = spark.createDataFrame([(got[0], got[k]) for k in range(5)], "a array<bigint>, b array<bigint>")
    like = [r[0] for r in df.select(P.likeness(F.col("a"), F.col("b"))).collect()]
    assert like[0] == 1.0 and like[1] > like[2] > like[4] and like[1] > 0.7 and like[4] < 0.5


def test_edited_texts_on_nasty_rows(spark, nasty):
    got = P.edited_fingerprints(nasty).collect()
    rows = sorted(((i, t or "") for i, t, *_ in nasty_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    # Ids with one text have a known next text where the next id has one, too.
    ids = Counter(i for i, _ in rows)
    sha = {r["doc_id"]: r["edited_sha256"] for r in got}
    for (i, t), (j, u) in zip(rows, rows[1:]):
        if ids[i] == ids[j] == 1:
            n = len(t)
            text = t[:n - n // 2] + u[:n // 2]
            assert sha[i] == hashlib.sha256(text.encode()).hexdigest()
    for r in got:
        assert 0.0 <= r["near_edited"] <= 1.0 and 0.0 <= r["near_next"] <= 1.0
    same = {r["doc_id"]: r["fingerprint"] for r in got}
    assert same[1] == same[2] != same[4] and same[5] == same[6]


def test_last_borrows_from_first(spark):
    df = spark.createDataFrame([(3, "cccc"), (1, "aaaa"), (2, "bb")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in P.edited_fingerprints(df).collect()}
    want = {1: "aabb", 2: "bc", 3: "ccaa"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_empty(spark, empty):
    assert P.edited_fingerprints(empty).count() == 0
