"""Operator 8: every cut against a plain k-d tree."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabscope.llm import sharding


def plain_tree(rows, n):
    """``rows``: (text, hash, crc32, source, lang); shard of each text."""
    groups = defaultdict(lambda: [0, None, None])
    for text, h, crc, source, lang in rows:
        g = groups[h, crc, len((text or "").encode()) + 1, text or ""]
        g[0] += len((text or "").encode()) + 1
        g[1] = min(x for x in (g[1], source or "") if x is not None)
        g[2] = min(x for x in (g[2], lang or "") if x is not None)
    place = [{v: i for i, v in enumerate(sorted({g[k] for g in groups.values()}))} for k in (1, 2)]
    total = sum(g[0] for g in groups.values())
    points = [{"text": t, "w": w, "x": (place[0][s], place[1][la], size), "tie": (h, crc), "light": w <= total / n / 64 * (1 + 1 / 64)}
              for (h, crc, size, t), (w, s, la) in groups.items()]
    extent = [max(p["x"][d] for p in points) - min(p["x"][d] for p in points) or 1 for d in range(3)]
    shard = {}

    def split(part, first, k):
        if k == 1 or not part:
            shard.update((p["text"], first) for p in part)
            return
        width = [(max(p["x"][d] for p in part) - min(p["x"][d] for p in part)) / extent[d] for d in range(3)]
        d = max(range(3), key=lambda d: (width[d], -d))
        part = sorted(part, key=lambda p: (p["light"], p["x"][d], p["tie"]))
        want, before = sum(p["w"] for p in part) * (k // 2) / k, 0
        for cut, p in enumerate(part):
            if before + p["w"] >= want:
                cut += before + p["w"] - want <= want - before
                break
            before += p["w"]
        split(part[:cut], first, k // 2)
        split(part[cut:], first + k // 2, k - k // 2)
    split(points, 0, n)
    return shard


@pytest.mark.parametrize("n,seed", [(8, 1), (5, 2)])
def test_cuts_equal_a_plain_tree(spark, n, seed):
    rng = random.Random(seed)
    sources = ["https://a.example/x", "https://a.example/y", "https://b", None, "s"]  # equal first bytes
    rows = [(i, " ".join(rng.choice("ab cd efg".split()) for _ in range(rng.choice((3, 8, 20, 60)))) + str(i % 180),
             rng.choice(["en", "de", None]), sources[0] if i % 3 == 0 else rng.choice(sources)) for i in range(400)]
    rows += [(400, None, "en", "s"), (401, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    text = F.coalesce("text", F.lit(""))
    want = plain_tree([tuple(r) for r in df.select("text", F.xxhash64(text), F.crc32(text), "source", "lang").collect()], n)
    got = sharding.kd_shards(df, n, carry=["text"]).select("row.text", "shard").collect()
    assert len(got) == len(rows)
    assert all(r["shard"] == want[r["text"] or ""] for r in got)
