"""Operator 8: sharding by a k-d tree with distributed weighted medians.

Points are the groups of equal texts (so copies stay together); a point weighs
the bytes of its rows and has metadata coordinates: source, language and size.
A node that has to become ``k`` shards is split along its widest dimension
(extent over the whole table's extent) at the weighted ``(k//2)/k`` quantile,
until every leaf is one shard of about ``total / n_shards`` bytes.

Coordinates. A source or language counts by its place among the distinct values
(dense rank of the whole string), a size by itself.

Balance. Coordinates repeat (a hot source holds a third of all rows), so along
each dimension points are put into one strict order: coordinate, then text
hash. Medians are taken on that order's ranks, so a split hits its target to
one point. The few points heavier than 1/64 of a shard (fewer than
``64 * n_shards``) stand first in every order, which leaves light points to
even out the cut. A group heavier than a whole shard cannot be kept together:
only such a group is cut, along the order of its rows' ids, into equal pieces of
1/64 of a shard or less; each piece is a light point, and a shard misses its target
by about one of them.

Defined results: NULL text is an empty text (size 1, crc32 0); NULL source or
language sorts first; equal rows are separate rows of one group; an empty table
gives no rows; the caller's columns travel in one struct.

Native: DataFrame operations only. The driver sees one row per tree node (at
most ``n_shards``); the groups heavier than a shard (fewer than ``n_shards``) are a
broadcast table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import row_index
from ..session import materialize

FAN = 1024  # buckets of one round of the median search
HEAVY = 64  # a point is heavy above 1/HEAVY of a shard
DIMS = 3


def text_codes(points: DataFrame, name: str, out: str) -> DataFrame:
    """Add the 0-based place of ``name`` among its distinct values."""
    codes = row_index(points.select(name).distinct(), [name], out)
    return points.join(codes, name)


def _rows(docs: DataFrame, cols, id_col, text_col, source_col, lang_col) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return materialize(docs.select(
        F.struct(*[docs[c] for c in cols]).alias("row"), docs[id_col].alias("__id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("__h"),
        F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("__source"),
        F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("__lang")), "shard-rows")


def _points(rows: DataFrame, n_shards: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their group's piece number, points)."""
    key = ["__h", "text_crc32", "size"]
    target = (rows.agg(F.sum("size")).first()[0] or 0) / n_shards
    # Each giant holds more than 1/n_shards of all bytes: fewer than n_shards.
    giants = materialize(rows.groupBy(*key).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
                         .where(F.col("w") > F.lit(target))
                         .select(*key, "n", F.ceil(F.col("w") * HEAVY / F.lit(max(target, 1.0))).alias("parts")), "giants")
    if giants.isEmpty():
        rows = rows.withColumn("__piece", F.lit(0))
    else:
        apart = rows.join(F.broadcast(giants), key)
        placed = row_index(apart, [*key, "__id"], "__i")
        first = placed.groupBy(*key).agg(F.min("__i").alias("__first"))
        piece = F.floor((F.col("__i") - F.col("__first")) * F.col("parts") / F.col("n")).cast("int")
        placed = placed.join(F.broadcast(first), key).withColumn("__piece", piece).select(*rows.columns, "__piece")
        rest = rows.join(F.broadcast(giants), key, "left_anti").withColumn("__piece", F.lit(0))
        rows = materialize(rest.unionByName(placed), "shard-pieces")
    points = materialize(rows.groupBy(*key, "__piece").agg(
        F.sum("size").alias("w"), F.min("__source").alias("__source"), F.min("__lang").alias("__lang")), "points")
    points = text_codes(text_codes(points, "__source", "x0"), "__lang", "x1").drop("__source", "__lang")
    points = points.withColumn("x2", F.col("size").cast("long")) \
                   .withColumn("light", F.col("w") <= F.lit(target / HEAVY) * (1 + 1 / HEAVY))
    return rows, points


def _ranked(points: DataFrame) -> DataFrame:
    """Add ``r0…``: each point's place in the strict order of each dimension."""
    for d in range(DIMS):
        points = row_index(points, ["light", f"x{d}", "__h", "text_crc32", "__piece"], f"r{d}",
                           stored=d > 0)
    return points


def _pick(prefix: str) -> Column:
    return F.coalesce(*[F.when(F.col("dim") == d, F.col(f"{prefix}{d}")) for d in range(DIMS)])


def _split(points: DataFrame, n: int) -> list[tuple]:
    """One split per open node: ``(first, k, dim, cut)``; points of rank below
    ``cut`` go to the left ``k // 2`` shards."""
    spark = points.sparkSession
    extent = points.agg(*[(F.max(f"x{d}") - F.min(f"x{d}")).alias(f"e{d}") for d in range(DIMS)]).first()
    width = [((F.max(f"x{d}") - F.min(f"x{d}")) / F.lit(float(extent[d] or 1))).alias(f"s{d}")
             for d in range(DIMS)]
    nodes = []
    for r in points.where(F.col("k") > 1).groupBy("first", "k").agg(F.sum("w").alias("w"), *width).collect():
        dim = max(range(DIMS), key=lambda d: (r[f"s{d}"], -d))
        nodes.append((r["first"], r["k"], dim, r["w"] * (r["k"] // 2) / r["k"], 0, n, 0))
    step = n
    found = {}
    while nodes:
        step = max(1, -(-step // FAN))
        table = spark.createDataFrame(nodes, "first int, k int, dim int, want double, lo bigint, "
                                             "hi bigint, before bigint")
        here = points.join(F.broadcast(table.drop("k")), "first").withColumn("r", _pick("r"))
        b = F.floor((F.col("r") - F.col("lo")) / F.lit(step))
        hist = (here.where((F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
                    .groupBy("first", b.alias("b"))
                    .agg(F.sum("w").alias("w"), F.first("want").alias("want"),
                         F.first("before").alias("before")))
        upto = Window.partitionBy("first").orderBy("b")
        hist = hist.withColumn("cum", F.col("before") + F.sum("w").over(upto))
        # The first bucket that reaches the wanted weight (or the last one).
        last = F.max("b").over(Window.partitionBy("first"))
        hit = (hist.withColumn("last", last)
                   .where((F.col("cum") >= F.col("want")) | (F.col("b") == F.col("last")))
                   .groupBy("first").agg(F.min_by(F.struct("b", "w", "cum"), "b").alias("x"))
                   .select("first", "x.*").collect())
        at = {r["first"]: r for r in hit}
        nxt = []
        for first, k, dim, want, lo, hi, _ in nodes:
            r = at[first]
            lo += r["b"] * step
            before = r["cum"] - r["w"]
            if step > 1:
                nxt.append((first, k, dim, want, lo, min(hi, lo + step), before))
            else:  # one point: it goes to the side that leaves the smaller error
                found[first] = (first, k, dim, lo + 1 if r["cum"] - want <= want - before else lo)
        nodes = nxt
    return list(found.values())


def kd_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source", lang_col: str = "lang",
              carry: list[str] | None = None) -> DataFrame:
    """``(row, size, text_crc32, shard, slot)``: every row's shard and its
    0-based place in it (by id, gapless)."""
    spark = docs.sparkSession
    cols = docs.columns if carry is None else carry
    rows = _rows(docs, cols, id_col, text_col, source_col, lang_col)
    rows, points = _points(rows, n_shards)
    points = materialize(_ranked(points).withColumn("first", F.lit(0))
                         .withColumn("k", F.lit(n_shards)), "points")
    n = points.count()
    for _ in range(max(0, (n_shards - 1).bit_length())):
        cuts = _split(points, n)
        if not cuts:
            break
        table = spark.createDataFrame(cuts, "first int, k int, dim int, cut bigint")
        left = F.col("dim").isNotNull() & (_pick("r") < F.col("cut"))
        half = F.floor(F.col("k") / 2).cast("int")
        cut = F.col("dim").isNotNull()
        points = materialize(points.join(F.broadcast(table), ["first", "k"], "left").select(
            "__h", "text_crc32", "size", "__piece", "w", "x0", "x1", "x2", "r0", "r1", "r2",
            F.when(~cut | left, F.col("first")).otherwise(F.col("first") + half).alias("first"),
            F.when(~cut, F.col("k")).when(left, half).otherwise(F.col("k") - half).alias("k")),
            "points")
    key = ["__h", "text_crc32", "size", "__piece"]
    placed = rows.join(points.select(*key, F.col("first").alias("shard")), key)
    placed = row_index(placed.select("row", "__id", "size", "text_crc32", "shard"),
                       ["shard", "__id"], "__i")
    start = placed.groupBy("shard").agg(F.min("__i").alias("__start"))  # ≤ n_shards rows
    return (placed.join(F.broadcast(start), "shard")
                  .select("row", "size", "text_crc32", "shard",
                          (F.col("__i") - F.col("__start")).alias("slot")))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, **kw) -> None:
    """Write the rows of ``docs`` as Parquet folders ``shard=<n>``, rows of a
    shard in slot order."""
    placed = kd_shards(docs, n_shards, **kw)
    (placed.select("row.*", F.col("shard").alias("shard"), F.col("slot").alias("__slot"))
           .repartitionByRange("shard", "__slot").sortWithinPartitions("shard", "__slot")
           .drop("__slot").write.partitionBy("shard").parquet(path))


def op8_kd_shards(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 8 shards of near-equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = kd_shards(docs, 8, carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "text_crc32",
                      F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_kd_shards": (op8_kd_shards, None)}
