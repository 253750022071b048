"""Mergeable profile states and exact quantiles by brackets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators import profile as P
from tabscope.operators import rank as R
from tabscope.operators import states as S
from tabscope.sources import store as ST


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(1e6 + rng.normal()), None if i % 4 else float(rng.integers(0, 9)), f"v{i % 700}" if i % 5 else None,
             float("nan") if i % 3 else -0.0) for i in range(6000)]
    return spark.createDataFrame(rows, "k long, far double, holes double, t string, odd double")


def as_dict(df):
    return {r["column"]: r for r in df.collect()}


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) <= 1e-9 * max(1.0, abs(b)))


def test_merged_parts_equal_one_shot(frame):
    one = as_dict(S.profile_of(S.column_states(frame)))
    parts = None
    for p in range(7):  # part 6 is empty
        s = S.column_states(frame.where(F.pmod(F.xxhash64("k"), F.lit(6)) == p)).withColumn("part", F.lit(str(p)))
        parts = s if parts is None else parts.unionByName(s)
    exact = as_dict(P.numeric_profile(frame))
    for merged in (as_dict(S.profile_of(S.merge_states(parts))), as_dict(S.profile_of(S.merge_states(parts, "part")))):
        assert set(merged) == set(one) == {"k", "far", "holes", "t", "odd"}
        for c, r in merged.items():
            assert (r["n"], r["min"], r["max"]) == (one[c]["n"], one[c]["min"], one[c]["max"])
            assert close(r["mean"], one[c]["mean"]) and close(r["std"], one[c]["std"])
            if c in exact:
                assert close(r["std"], exact[c]["std"]) and r["n"] == exact[c]["n"]
                assert abs(r["unique_values"] - exact[c]["unique_values"]) <= S.DISTINCT_ERROR * exact[c]["unique_values"]
    far = np.sort([r["far"] for r in frame.collect()])
    rank = np.searchsorted(far, merged["far"]["median"]) / len(far)
    assert abs(rank - 0.5) <= S.RANK_ERROR


def test_one_scan_profile_and_empty(spark, frame):
    got = P.numeric_profile(frame, exact=False)
    assert got.columns == P.numeric_profile(frame).columns
    assert got.where("column = 'odd'").first()["unique_values"] == 1  # -0.0 and no NaN
    none = as_dict(S.profile_of(S.merge_states(S.column_states(frame.limit(0)))))
    assert none["far"]["n"] == 0 and none["far"]["median"] is None and none["t"]["unique_values"] == 0
    assert S.column_states(spark.range(1).select()).collect() == []


def test_a_new_part_adds_to_the_profile(spark, frame, tmp_path):
    store = str(tmp_path)
    for p, name in enumerate(("2024-01", "2024/02 x", "3")):
        ST.add_part(frame.where(F.col("k") % 3 == p), store, "d", name)
    assert as_dict(ST.stored_profile(spark, store, "d"))["k"]["n"] == 6000
    ST.add_part(frame.where("k % 3 = 2 AND k < 3000"), store, "d", "3")  # replaces, does not add
    assert as_dict(ST.stored_profile(spark, store, "d"))["k"]["n"] == 5000
    ST.drop_part(spark, store, "d", "2024/02 x")
    assert as_dict(ST.stored_profile(spark, store, "d"))["k"]["n"] == 3000
    assert {r["part"] for r in ST.read_states(spark, store, "d").select("part").distinct().collect()} == {"2024-01", "3"}


@pytest.mark.parametrize("finish,error", [(20_000, 0.005), (0, 0.005), (20_000, 0.0), (0, 0.0)])
def test_bracketed_quantiles_equal_numpy(spark, monkeypatch, finish, error):
    """Counts held by the driver or kept in a table, brackets that hold the rank, and
    sketches that miss it."""
    monkeypatch.setattr(R, "FINISH_ROWS", finish)
    monkeypatch.setattr(R, "SKETCH_ERROR", error)
    monkeypatch.setattr(R, "SKETCH_ITEMS", 8 if error == 0 else 2048)
    rng = np.random.default_rng(2)
    n = 5001
    cols = {"skew": rng.normal(size=n) ** 5, "few": rng.integers(0, 3, n).astype(float), "one": np.full(n, 2.5),
            "inf": np.where(rng.random(n) < 0.3, np.inf, rng.random(n)), "hot": np.where(rng.random(n) < 0.4, 7.0, rng.random(n) * 14)}
    data = np.column_stack(list(cols.values()))
    gone = rng.random(data.shape) < 0.1
    df = spark.createDataFrame([tuple(None if g else float(v) for v, g in zip(r, m)) + (None,) for r, m in zip(data, gone)],
                               ", ".join(f"`{c}.x` double" for c in [*cols, "null"])).repartition(5)
    for q in (0.5, 0.0, 0.93):
        got = R.bracketed_quantiles(df, q)
        assert got["null.x"] is None
        for k, c in enumerate(cols):
            v = np.sort(data[~gone[:, k], k])
            p = (len(v) - 1) * q
            a, b = v[int(np.floor(p))], v[int(np.ceil(p))]
            assert got[f"{c}.x"] == (a if a == b else a + (p - np.floor(p)) * (b - a)), (c, q)
