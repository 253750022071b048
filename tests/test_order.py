"""Row order of files, line breaks inside quotes, and the ingest path."""

import pytest
from pyspark.sql import functions as F

from tabscope.operators import browse as B
from tabscope.operators import features as FT
from tabscope.operators import insights as I
from tabscope.plans import ingest as IN
from tabscope.sources import csv as CSV
from tabscope.sources import order as O
from tabscope.sources import store as ST


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def files(tmp_path):
    """c.csv is split into blocks, b.csv has line breaks in quotes; order is a, b, c."""
    (tmp_path / "c.csv").write_text("n,t\n" + "".join(f"{i},w{(i * 7919) % 300}\n" for i in range(2000)))
    (tmp_path / "b.csv").write_text('n,t\n-3,"x\n""q"", y"\n-2,w5\n')
    (tmp_path / "a.csv").write_text("n,t\n-9,w299\n-8,w5\n")
    return str(tmp_path), [-9, -8, -3, -2, *range(2000)]


def test_numbers_follow_the_files(spark, tmp_path, small_blocks):
    path, order = files(tmp_path)
    assert spark.read.csv(path).rdd.getNumPartitions() > 5
    rows = CSV.load_csv(spark, path, row_order="_row").orderBy("_row").collect()
    assert [(r["_row"], r["n"]) for r in rows] == list(enumerate(order))
    assert rows[2]["t"] == 'x\n"q", y'


def test_operators_without_a_key(spark, tmp_path, small_blocks):
    (tmp_path / "c").mkdir()
    path, order = files(tmp_path / "c")
    (tmp_path / "c" / "b.csv").unlink()
    order = [n for n in order if n not in (-3, -2)]
    df = CSV.load_csv(spark, path, multi_line=False)
    assert [r["n"] for r in B.preview(df, n=10).collect()] == order[:10]
    assert [r["n"] for r in B.preview(df, n=2).collect()] == order[:2]
    texts = ["w299", "w5"] + [f"w{(i * 7919) % 300}" for i in range(2000)]
    first = list(dict.fromkeys(texts))
    got = FT.first_appearance_codes(df, columns=["t"], max_distinct=None).collect()
    assert {r["value"]: r["code"] for r in got} == {v: i for i, v in enumerate(first)}
    folds = {r["n"]: r["fold"] for r in FT.kfold(df, k=3).collect()}
    assert [folds[n] for n in order] == sorted(folds.values())
    big = spark.read.schema("n long, t string").option("header", True).csv(path).withColumn("x", F.when(F.col("n") % 400 == 7, 1e6 + F.col("n")).otherwise(F.col("n") % 3))
    assert [r["value"] for r in I.outlier_examples(big, columns=["x"]).orderBy("rank").collect()] == [1e6 + 7 + 400 * i for i in range(5)]


def test_parquet_filters_and_frames_without_files(spark, tmp_path):
    spark.range(1000, numPartitions=4).write.parquet(str(tmp_path / "p"))
    scan = spark.read.parquet(str(tmp_path / "p"))
    assert [r["id"] for r in O.with_row_order(scan).orderBy("_row").collect()] == list(range(1000))
    left = O.with_row_order(scan.where("id % 3 = 1")).orderBy("_row").collect()
    assert [(r["_row"], r["id"]) for r in left] == list(enumerate(range(1, 1000, 3)))
    assert O.with_row_order(scan.where("id < 0")).count() == 0
    with pytest.raises(ValueError, match="no file order"):
        O.with_row_order(spark.range(3).toDF("a"))


def test_quoted_line_breaks_by_default(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('a,b,c\n1,"x\ny",2\n3,z,4\n')
    assert [tuple(r) for r in CSV.load_csv(spark, str(p)).orderBy("a").collect()] == [(1, "x\ny", 2), (3, "z", 4)]
    assert CSV.verdict(CSV.validate_csv(spark, str(p))).first()["valid"]
    p.write_text('a,b\n1,"x\ny",2\n3,z\n')  # a row too long, behind a line break
    assert "more fields" in CSV.verdict(CSV.validate_csv(spark, str(p))).first()["message"]


def test_ingest(spark, tmp_path):
    p, store = tmp_path / "in.csv", str(tmp_path / "store")
    p.write_text('k,t,x\n3,b,1.5\n,,\n1,,NA\n2,"a\nc",2.5\n9,b,3.5\n')
    out = IN.ingest(spark, str(p), store, "d")
    assert (out.valid, out.message) == (True, "File validation successful.")
    rows = [tuple(r) for r in out.table.orderBy(IN.ROW).select("k", "t", "x").collect()]
    assert rows == [(3, "b", 1.5), (1, "Unknown", 2.5), (2, "a\nc", 2.5), (9, "b", 3.5)]
    assert {r["value"]: r["code"] for r in out.encoders.collect()} == {"b": 0, "Unknown": 1, "a\nc": 2}
    assert out.card.first()["rows"] == 4
    assert {r["column"]: r["median"] for r in out.profile["numeric"].collect()} == {"k": 2.5, "x": 2.5}
    p.write_text("k,t\n")
    bad = IN.ingest(spark, str(p), store, "d")
    assert not bad.valid and bad.table is None and "No data" in bad.message
    assert ST.read_frame(spark, store, "tables", "d").count() == 4  # an invalid file replaces nothing
    assert not IN.ingest(spark, str(tmp_path / "none.csv"), store, "d").valid
