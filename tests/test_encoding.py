"""Text encoding by a distributed dictionary: F2, F3 and the fitted stage."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabscope.operators import encoding as EN
from tabscope.operators import features as FT
from tabscope.plans import train as TR


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(4)
    # A third of the rows share one value; names with dots, blanks and other scripts.
    rows = [(i, float(i % 13), rng.choice(["hot", "hot", "b c", "é", "日本", None, "z.9"]) if i % 3 else "hot",
             f"v{i % 250}" if i % 7 else None) for i in range(900)]
    return spark.createDataFrame(rows, "k bigint, x double, `a.b` string, w string").repartition(6)


def test_dictionary_is_numbered_by_column_and_value(spark, mixed):
    got = [(r["column"], r["value"], r["slot"]) for r in EN.dictionary(mixed, ["w", "a.b"], 3).orderBy("slot").collect()]
    data = mixed.collect()
    w = sorted({r["w"] for r in data if r["w"]}, key=lambda s: s.encode())
    ab = sorted({r["a.b"] for r in data if r["a.b"]}, key=lambda s: s.encode())
    assert got == [(c, v, 3 + i) for i, (c, v) in enumerate([("w", v) for v in w] + [("a.b", v) for v in ab])]
    assert EN.dictionary(mixed, []).collect() == []
    assert [(r["value"], r["code"]) for r in FT.label_codes(mixed, "a.b").orderBy("code").collect()] == list(zip(ab, range(len(ab))))


def test_cells_equal_get_dummies(spark, mixed):
    import pandas as pd
    data = mixed.toPandas()
    want = pd.get_dummies(data.set_index("k"), columns=["a.b", "w"]).astype(float)
    got = EN.one_hot_cells(mixed, "k", ["a.b", "w"]).toPandas()
    assert sorted(got["feature"].unique()) == sorted(want.columns)
    wide = got.pivot(index="k", columns="feature", values="x").fillna(0.0).sort_index()[list(want.columns)]
    assert (wide.to_numpy() == want.sort_index().to_numpy()).all()
    assert list(got.drop_duplicates("slot").sort_values("slot")["feature"]) == list(want.columns)


def test_stage_equals_the_cells_and_survives_saving(spark, mixed, tmp_path):
    data = mixed.withColumn("extra", F.lit("kept"))
    model = EN.TextEncoder(textCols=["a.b", "w"], numericCols=["x"]).fit(data)
    out = model.transform(data)
    assert out.columns == [*data.columns, "features"] and out.count() == data.count()
    cells = {}
    for r in EN.one_hot_cells(mixed, "k", ["a.b", "w"], ["x"]).collect():
        cells.setdefault(r["k"], {})[r["slot"]] = r["x"]
    for r in out.collect():
        assert r["features"].size == model.size
        assert {int(i): float(v) for i, v in zip(r["features"].indices, r["features"].values)} == cells[r["k"]]
    path = str(tmp_path / "m")
    PipelineModel(stages=[model]).write().save(path)
    again = PipelineModel.load(path)
    assert sorted(map(str, again.transform(data).collect())) == sorted(map(str, out.collect()))
    assert again.stages[0].names().collect() == model.names().collect()


def test_unseen_and_missing_values_have_no_slot(spark, mixed):
    model = EN.TextEncoder(textCols=["w"]).fit(mixed.where("w = 'v1'"))
    got = {r["w"]: r["features"].indices.tolist() for r in model.transform(mixed).collect()}
    assert got["v1"] == [0] and got["v2"] == [] and got[None] == []
    with pytest.raises(Exception, match="NULL or NaN"):
        EN.TextEncoder(numericCols=["x"]).fit(mixed).transform(mixed.withColumn("x", F.lit(None).cast("double"))).collect()


def test_no_label_reaches_the_driver(spark):
    """A column with as many values as rows: slots by joins, names from the table."""
    n = 60_000
    df = spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("u"), F.md5(F.col("id").cast("string"))).alias("u"),
                               F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("c"),
                               (F.col("id") % 3).cast("double").alias("y"))
    model = EN.TextEncoder(textCols=["u", "c"]).fit(df)
    assert model.size == n + 6 and model.names().count() == n + 6
    meta = model.transform(df).schema["features"].metadata
    assert meta == {"ml_attr": {"num_attrs": n + 6}}  # no name in the plan
    res = TR.train_route(df, "y", "k", "LinearRegression")
    assert res.names.count() > 40_000 and res.importances.count() == res.names.count()
    assert {r["metric"] for r in res.metrics.collect()} >= {"r2_score"}
