"""Iterative fits get partitions sized by what they hold, not by the files' size."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from tabscope.operators import features as FT
from tabscope.operators import models as M


class Seen(Exception):
    pass


class Recorder:
    """Stands for an estimator; its fit ends with the number of partitions."""

    def __init__(self, **_):
        pass

    def fit(self, df):
        raise Seen(df.rdd.getNumPartitions(), df.count())


def given(call) -> tuple:
    try:
        call()
    except Seen as e:
        return e.args
    raise AssertionError("not fitted")


def one_file(spark, rows: int):
    df = spark.range(rows).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("label"))
    return FT.assemble(df, ["x"]).coalesce(1)


def test_partitions_grow_with_the_dense_rows():
    assert M.partitions(0, 0) == M.partitions(1000, 100) == 1
    assert M.partitions(16_000, 97) == 6
    for rows in (10**5, 10**6, 10**8, 10**10):
        n = M.partitions(rows, 97)
        assert rows * 97 * 8 / n <= M.PART_BYTES and n <= max(M.SIDE_BY_SIDE, rows * 97 * 8 / M.PART_BYTES + 1)


def test_kernel_regression_spreads_its_mapped_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "LinearRegression", Recorder)
    assert given(lambda: M.KernelRegression().fit(one_file(spark, 20_000))) == (8, 20_000)
    assert given(lambda: M.KernelRegression({"kernel": "linear"}).fit(one_file(spark, 20_000))) == (1, 20_000)


def test_route_models_get_spread_vectors(spark):
    from tabscope.plans import train as TR
    vectors = one_file(spark, 20_000)
    assert given(lambda: TR._fit(Recorder(), SimpleNamespace(size=100), vectors)) == (8, 20_000)
    assert given(lambda: TR._fit(Recorder(), SimpleNamespace(size=10), vectors)) == (1, 20_000)
