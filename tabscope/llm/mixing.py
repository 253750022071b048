"""Operator 1: mixing sources to target weights by systematic sampling.

Every source gets a target number of words. Within a source all documents have
the same expected number of copies, ``rate = target / source words`` (≤ 2). The
documents are put in one order, the expected copies are prefix-summed
(``rank * rate``), one random offset per source is added, and a document is
emitted once per integer boundary its step crosses. So each document is taken
``floor(rate)`` or ``ceil(rate)`` times, and because the order is by size, the
taken words of a source miss its target by about one document at most.

Defined results: NULL text has size 0; a NULL source is a source of its own,
after all others; a source without words has target 0 and is not taken; equal
rows are separate rows; an empty table gives an empty mix. The caller's other
columns travel in one struct, so no name of theirs can clash.

Scale: the only shuffle of rows is the range exchange of
:func:`tabscope.operators.rank.row_index` on (source, size, hash, …), which
splits a hot source; all per-source figures are small aggregates joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import row_index
from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by source order, repeating; share of all words; most copies of a row.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_fraction(md5: Column) -> Column:
    """First 32 bits of an md5 as a number in [0, 1)."""
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """``(source, source_size, n, target)`` from ``(source, size)`` rows.

    Targets share ``share`` of all sizes by weight and stop at ``most`` times
    the source's size; what a stopped source leaves is shared again by weight
    until no target is above its stop. Every round is one aggregate over the
    sources; at most as many rounds as there are sources, in practice a few.
    """
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"),
                                                  F.count(F.lit(1)).alias("n")), "sources")
    order = per.select(F.col("source").isNull().alias("__null"), "source", "source_size", "n")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.col("__i") % len(weights) + 1).cast("int"))
    src = materialize(row_index(order, ["__null", "source"], "__i").withColumn("__w", w), "sources")
    stop = F.col("source_size") * F.lit(float(most))
    total = (src.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, held = None, -1
    while True:
        above = F.lit(False) if level is None else stop <= F.lit(level) * F.col("__w")
        r = src.agg(F.count_if(above), F.sum(F.when(above, stop).otherwise(0.0)),
                    F.sum(F.when(above, 0.0).otherwise(F.col("__w")))).first()
        if r[0] == held or not r[2]:
            break
        held, level = r[0], (total - (r[1] or 0.0)) / r[2]
    target = F.least(stop, F.lit(level) * F.col("__w")) if level is not None else stop
    return src.select("source", "source_size", "n", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", carry: list[str] | None = None,
             weights=WEIGHTS, share: float = SHARE, most: float = MOST,
             seed: int = SEED) -> DataFrame:
    """One row per document: ``(row, size, source_size, target, copies, taken)``.

    ``row`` is a struct of the ``carry`` columns (default: all). ``copies`` is
    how often the mix takes the document, ``taken = copies * size``.
    """
    cols = docs.columns if carry is None else carry
    text, key = docs[text_col], docs[id_col]
    work = docs.select(
        F.struct(*[docs[c] for c in cols]).alias("row"),
        docs[source_col].alias("source"), docs[source_col].isNull().alias("__null"),
        word_count(text).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))).alias("__h"),
        F.coalesce(F.md5(text), F.lit("")).alias("__t"))
    # Within a source: by size, then in random (hashed) order.
    placed = row_index(work, ["__null", "source", "size", "__h", "__t"], "__i", stored=False)
    targets = source_targets(placed.select("source", "size"), weights, share, most)
    first = placed.groupBy("source").agg(F.min("__i").alias("__first"))
    per = materialize(targets.join(first, targets["source"].eqNullSafe(first["source"]))
                      .select(targets["source"].alias("__s"), "source_size", "target", "__first"),
                      "targets")
    rate = F.when(F.col("source_size") > 0,
                  F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = hex_fraction(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("\x00")))))
    rank = (F.col("__i") - F.col("__first")).cast("double")
    copies = (F.floor((rank + 1) * rate + offset) - F.floor(rank * rate + offset)).cast("long")
    return (placed.join(per, F.col("source").eqNullSafe(F.col("__s")))
                  .select("row", "size", "source_size", "target", copies.alias("copies"),
                          (copies * F.col("size")).alias("taken")))


def mix_sources(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: the rows of ``docs`` with their columns, each as often as
    it is taken."""
    plan = mix_plan(docs, **kw)
    copies = F.array_repeat(F.lit(0).cast("tinyint"), F.col("copies").cast("int"))
    return plan.select("row", F.explode(copies).alias("__copy")).select("row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed: one row per document with the words taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mix_plan(docs, carry=["doc_id"])
    return plan.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
                       "taken", "copies")


def _mix_sql(docs: str) -> str:
    """CTE chain ``mixed(… , copies, size, source_size, target)`` over ``docs``."""
    return f"""
d AS (SELECT *, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
      FROM {docs}),
s0 AS (SELECT source, sum(size)::DOUBLE AS ss, count(*) AS n FROM d GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]
       ::DOUBLE AS w FROM s0),
s2 AS (SELECT *, sum(2 * ss) OVER p AS held, sum(w) OVER p AS wheld, sum(w) OVER () AS wall,
              1.5 * sum(ss) OVER () AS total
       FROM s1 WINDOW p AS (ORDER BY 2 * ss / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT max((total - (held - 2 * ss)) / (wall - (wheld - w))) FILTER (
              (total - (held - 2 * ss)) / (wall - (wheld - w)) < 2 * ss / w) AS level FROM s2),
s3 AS (SELECT source, ss, least(2 * ss, COALESCE(level, 1e300) * w) AS target,
              ('0x' || substr(md5('20/' || COALESCE(source, chr(0))), 1, 8))::BIGINT / 4294967296.0
              AS u FROM s2, lv),
r AS (SELECT d.*, s3.ss::BIGINT AS source_size, s3.target, s3.u,
             CASE WHEN s3.ss > 0 THEN s3.target / s3.ss ELSE 0.0 END AS rate,
             (row_number() OVER (PARTITION BY d.source ORDER BY size,
                md5('20:' || COALESCE(doc_id::VARCHAR, '')), COALESCE(md5(text), '')) - 1)::DOUBLE AS rk
      FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
mixed AS (SELECT *, (floor((rk + 1) * rate + u) - floor(rk * rate + u))::BIGINT AS copies FROM r)
"""


ORACLE = f"""
WITH {_mix_sql('documents')}
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM mixed
"""

QUERIES = {"op1_mix_sources": (op1_mix_sources, ORACLE)}
