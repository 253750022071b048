"""Order statistics without a single-task bottleneck.

``median``/``percentile``/``mode`` aggregates and un-partitioned windows keep a
whole column (all distinct values, or all rows) in one task. At 100 TB that is
the one reducer that never finishes. The helpers here do the same work
with bounded per-task and per-driver state:

* :func:`exact_quantiles` – exact, interpolated quantiles per group from a
  ``(group, value, cnt)`` histogram by distributed bucket selection: each round
  counts rows per value bucket (a partial aggregate), the driver picks the
  bucket holding the wanted rank (≤ ``buckets`` rows per search), and the next
  round looks only inside it. Typical data ends after 1–3 rounds.
* :func:`bracketed_quantiles` – the same quantiles straight from the rows of wide
  columns, with two scans.
* :func:`row_index` – 0-based global row numbers in a key order: the engine's
  range exchange, a sort inside each partition, and per-partition offsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._long import bounded_broadcast, col

# Width of one selection round and the largest slice finished on the driver.
SELECT_BUCKETS = 1024
FINISH_ROWS = 20_000
MAX_ROUNDS = 64


def _positions(n: int, q: float) -> tuple[int, int, float]:
    pos = (n - 1) * q
    k1 = int(math.floor(pos))
    k2 = int(math.ceil(pos))
    return k1, k2, pos - k1


def _bucket_round(h: DataFrame, plan_rows: list, spark) -> dict:
    """One selection round: per plan row ``(sid, g, lo, hi)`` count rows,
    distinct values and min/max per value bucket of [lo, hi]. Returns
    ``{sid: [bucket rows sorted by bucket]}`` (≤ SELECT_BUCKETS rows each)."""
    plan = spark.createDataFrame(plan_rows, "sid int, g string, lo double, hi double")
    # Halved operands keep (hi - lo) finite for any pair of finite doubles.
    width = (F.col("hi") / 2 - F.col("lo") / 2) / F.lit(SELECT_BUCKETS)
    finite = (F.col("lo") > F.lit(float("-inf"))) & (F.col("hi") < F.lit(float("inf")))
    # An infinite end splits off first: ±inf to the outer buckets, the finite
    # values to the middle one, whose min/max then bound the next round.
    bucket = (F.when(finite, F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width),
                                     F.lit(SELECT_BUCKETS - 1)))
              .when(F.col("v") == F.lit(float("-inf")), F.lit(0))
              .when(F.col("v") == F.lit(float("inf")), F.lit(SELECT_BUCKETS - 1))
              .otherwise(F.lit(SELECT_BUCKETS // 2)).cast("int"))
    rows = (h.join(bounded_broadcast(plan), "g")
             .where(F.col("v").between(F.col("lo"), F.col("hi")))
             .groupBy("sid", bucket.alias("b"))
             .agg(F.sum("c").alias("c"), F.min("v").alias("mn"),
                  F.max("v").alias("mx"), F.count(F.lit(1)).alias("nd"))
             .collect())
    per: dict[int, list] = {}
    for r in rows:
        per.setdefault(r["sid"], []).append(r)
    return {k: sorted(v, key=lambda r: r["b"]) for k, v in per.items()}


def exact_quantiles(hist: DataFrame, stats: dict, q: float = 0.5,
                    group_col: str = "column", value_col: str = "value",
                    count_col: str = "cnt", distinct: dict | None = None,
                    positions: dict | None = None) -> dict:
    """Exact linear-interpolated ``q``-quantile per group (pandas/Spark/DuckDB
    ``median`` semantics for q = 0.5).

    ``hist`` has rows (group, value, count) – a histogram, or the values
    themselves with count 1 – and is read once per round. ``stats`` maps each
    group to ``(n, min, max)`` of its non-null values (already computed by the
    caller's wide aggregate). Returns ``{group: quantile}``; groups with n = 0
    map to ``None``. When ``distinct`` is a dict it receives each group's
    number of rows of ``hist`` (distinct values, if it is a histogram), counted
    in the first round for free. ``positions`` gives, instead of ``q``, the 0-based
    ranks to find per group and the weight of the second: ``(k1, k2, frac)``.

    A search ends on the driver once its bucket holds at most ``FINISH_ROWS``
    rows, or when no bucket is smaller than its range: then the range holds
    fewer doubles than buckets, and only distinct values are gathered.
    """
    spark = hist.sparkSession
    h = hist.select(F.col(group_col).alias("g"), F.col(value_col).cast("double").alias("v"),
                    F.col(count_col).alias("c"))
    result: dict = {}
    wanted: dict = {}
    first_plan = []
    for g, (n, lo, hi) in stats.items():
        if not n:
            result[g] = None
            if distinct is not None:
                distinct[g] = 0
            continue
        k1, k2, frac = positions[g] if positions else _positions(int(n), q)
        wanted[g] = (k1, k2, frac)
        if lo == hi:
            result[(g, k1)] = result[(g, k2)] = float(lo)
            if distinct is not None:
                distinct[g] = 1
        else:
            first_plan.append((len(first_plan), g, float(lo), float(hi)))

    # search id -> [group, lo, hi, below, k]
    searches: dict[int, list] = {}
    finish: dict[int, list] = {}
    per = _bucket_round(h, first_plan, spark) if first_plan else {}
    seeds = []
    for gid, g, lo, hi in first_plan:
        if distinct is not None:
            distinct[g] = sum(r["nd"] for r in per.get(gid, []))
        k1, k2, _ = wanted[g]
        for k in sorted({k1, k2}):
            seeds.append((g, lo, hi, 0, k, per.get(gid, [])))
    rounds = 1
    while seeds:
        nxt = []
        for g, lo, hi, below, k, buckets in seeds:
            acc = below
            for r in buckets:
                if acc + r["c"] > k:
                    if r["mn"] == r["mx"]:
                        result[(g, k)] = float(r["mn"])
                    elif r["nd"] <= FINISH_ROWS or (r["mn"] == lo and r["mx"] == hi):
                        finish[len(finish)] = [g, r["mn"], r["mx"], acc, k]
                    else:
                        nxt.append([g, r["mn"], r["mx"], acc, k])
                    break
                acc += r["c"]
        seeds = []
        if nxt:
            rounds += 1
            if rounds > MAX_ROUNDS:
                raise RuntimeError("quantile selection did not converge")
            searches = {i: s for i, s in enumerate(nxt)}
            per = _bucket_round(h, [(i, s[0], float(s[1]), float(s[2])) for i, s in searches.items()],
                                spark)
            seeds = [(s[0], float(s[1]), float(s[2]), s[3], s[4], per.get(i, []))
                     for i, s in searches.items()]

    if finish:
        plan = spark.createDataFrame(
            [(i, s[0], float(s[1]), float(s[2])) for i, s in finish.items()],
            "sid int, g string, lo double, hi double")
        rows = (h.join(bounded_broadcast(plan), "g")
                 .where(F.col("v").between(F.col("lo"), F.col("hi")))
                 .groupBy("sid", "v").agg(F.sum("c").alias("c")).collect())
        vals: dict[int, list] = {}
        for r in rows:
            vals.setdefault(r["sid"], []).append((r["v"], r["c"]))
        for i, (g, _lo, _hi, below, k) in finish.items():
            acc = below
            for v, c in sorted(vals.get(i, [])):
                if acc + c > k:
                    result[(g, k)] = float(v)
                    break
                acc += c

    out = {}
    for g, (k1, k2, frac) in wanted.items():
        a, b = result[(g, k1)], result[(g, k2)]
        out[g] = a if k1 == k2 or a == b else a + frac * (b - a)
    for g, v in result.items():
        if not isinstance(g, tuple):
            out[g] = v
    return out


#: Items of the quantile sketch and its rank error (a chance far above 99 %).
SKETCH_ITEMS = 2048
SKETCH_ERROR = 0.005


def bracketed_quantiles(wide: DataFrame, q: float = 0.5) -> dict:
    """Exact linear-interpolated ``q``-quantile of every (double) column of ``wide``,
    NULLs apart, with two scans whatever the data. ``{column: quantile}``; None for a
    column without values.

    Scan 1 makes a mergeable quantile sketch per column, which brackets the wanted
    rank. Scan 2 counts, inside each task, the values below the bracket and each value
    in it (about one in a hundred), column by column; nothing is unpivoted and only
    these counts are kept. The counts prove that the wanted rank lies in the bracket;
    the search for it goes on in the kept counts alone. Should a sketch be off by more
    than its bound, the column is searched by :func:`exact_quantiles`.
    """
    spark, cols = wide.sparkSession, wide.columns
    wide = wide.select(*[col(c).alias(f"x{i}") for i, c in enumerate(cols)])
    sketch = [F.kll_sketch_agg_double(f"x{i}", F.lit(SKETCH_ITEMS)) for i in range(len(cols))]
    at = F.array(F.lit(max(0.0, q - SKETCH_ERROR)), F.lit(min(1.0, q + SKETCH_ERROR)))
    row = wide.agg(*[F.count(f"x{i}").alias(f"n{i}") for i in range(len(cols))],
                   *[s.alias(f"s{i}") for i, s in enumerate(sketch)])
    row = row.select(*[F.col(f"n{i}") for i in range(len(cols))],
                     *[F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", at)).alias(f"b{i}")
                       for i in range(len(cols))]).first()
    brackets = {i: tuple(row[f"b{i}"]) for i in range(len(cols)) if row[f"n{i}"]}
    if not brackets:
        return dict.fromkeys(cols)

    def count(batches):
        for batch in batches:
            out = []
            for i, (lo, hi) in brackets.items():  # a batch's counts are at most its rows
                v = batch.column(i).to_numpy(zero_copy_only=False).astype(float)  # NULL is NaN, which is nowhere
                value, n = np.unique(v[(v >= lo) & (v <= hi)], return_counts=True)
                out.append((np.full(len(value) + 1, i, np.int32), np.r_[value, np.nan], np.r_[n, int((v < lo).sum())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]), from_pandas=True),
                 pa.array(np.concatenate([o[2] for o in out]))], ["i", "v", "c"])
    kept = wide.mapInArrow(count, "i int, v double, c long")
    expected = sum(row[f"n{i}"] for i in brackets) * 2.5 * SKETCH_ERROR
    if expected <= FINISH_ROWS * 5:  # the bracket's values are few: all of them come here
        few = kept.toArrow()
        code, value, n = (few.column(c).to_numpy() for c in ("i", "v", "c"))
        sums, here = {}, {}
        for i in brackets:
            own = code == i
            order = np.argsort(value[own], kind="stable")  # NaN, the number below, last
            v, c = value[own][order], n[own][order]
            inside = ~np.isnan(v)
            here[i] = v[inside], np.cumsum(c[inside])
            sums[str(i)] = {"below": int(c[~inside].sum()), "inside": int(c[inside].sum())}
    else:
        here = None
        kept = materialize(kept.groupBy(F.col("i").cast("string").alias("i"), "v").agg(F.sum("c").alias("c")), "bracket")
        sums = {r["i"]: r.asDict() for r in kept.groupBy("i").agg(
            F.sum(F.when(F.col("v").isNull(), F.col("c"))).alias("below"), F.sum(F.when(F.col("v").isNotNull(), F.col("c"))).alias("inside"),
            F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    stats, places, missed, found = {}, {}, [], {}
    for i in brackets:
        r = sums[str(i)]
        k1, k2, frac = _positions(int(row[f"n{i}"]), q)
        if not r["below"] <= k1 <= k2 < r["below"] + (r["inside"] or 0):
            missed.append(i)
        elif here is not None:
            v, upto = here[i]
            a, b = (float(v[np.searchsorted(upto, k - r["below"], "right")]) for k in (k1, k2))
            found[str(i)] = a if a == b else a + frac * (b - a)
        else:
            stats[str(i)], places[str(i)] = (r["inside"], r["lo"], r["hi"]), (k1 - r["below"], k2 - r["below"], frac)
    if stats:
        found |= exact_quantiles(kept.where(F.col("v").isNotNull()), stats, q, "i", "v", "c", positions=places)
    if missed:
        long = wide.select(F.explode(F.array(*[F.struct(F.lit(str(i)).alias("i"), F.col(f"x{i}").alias("v")) for i in missed])).alias("s"))
        ends = wide.agg(*[f(f"x{i}").alias(f"{f.__name__}{i}") for i in missed for f in (F.min, F.max)]).first()
        found |= exact_quantiles(long.select("s.i", "s.v", F.lit(1).cast("long").alias("c")).where(F.col("v").isNotNull()),
                                 {str(i): (row[f"n{i}"], ends[f"min{i}"], ends[f"max{i}"]) for i in missed}, q, "i", "v", "c")
    return {c: found.get(str(i)) for i, c in enumerate(cols)}


def row_index(df: DataFrame, order_cols: Sequence[str], index_col: str = "_row",
              stored: bool = False) -> DataFrame:
    """Add a 0-based global row number in ``order_cols`` order (nulls first).

    Keys may be of any sortable type and any number. Ties on the key are broken
    by an ``xxhash64`` of the row, so the numbering does not depend on the
    physical layout; rows equal in every column are interchangeable.

    Plan: the input is written once with a salt per row; the engine's range
    exchange deals it on (key, row hash, salt), so a key value, or one repeated
    row, that fills a third of the table is still split over many tasks. Each
    task sorts its own range, ``monotonically_increasing_id`` gives
    (partition, position), and the counts per partition (one row per shuffle
    partition, the only thing the driver sees) turn that into global numbers.

    ``stored=True`` skips the first write: for an input that is already a plain
    scan and whose rows differ from each other.
    """
    hashed = df.withColumn("__tie", F.xxhash64(*[col(c) for c in df.columns]))
    salt = F.lit(0.0) if stored else F.rand(17)
    staged = hashed.withColumn("__salt", salt)
    if not stored:
        staged = materialize(staged, "rank-in")
    keys = [*[col(c) for c in order_cols], F.col("__tie"), F.col("__salt")]
    ranged = materialize(
        staged.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .drop("__tie", "__salt")
              .withColumn("__at", F.monotonically_increasing_id()), "rank")
    part = F.shiftright(F.col("__at"), 33)
    counts = sorted((r[0], r[1]) for r in
                    ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    offsets, acc = [], 0
    for p, c in counts:
        offsets.append((p, acc))
        acc += c
    off = df.sparkSession.createDataFrame(offsets, "__part bigint, __off bigint")
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranged.withColumn("__part", part)
                  .join(bounded_broadcast(off), "__part")
                  .withColumn(index_col, F.col("__off") + local)
                  .drop("__part", "__off", "__at"))
