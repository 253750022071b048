"""Operator 7: near-duplicates by SuperMinHash, banding, verification, union-find.

1. Every text becomes its set of distinct 5-word shingles (A-Z folded; a text of
   1 to 4 words is one shingle). SuperMinHash gives 64 ranks per set: element
   ``e`` walks through a random permutation of the slots, one slot per level
   ``j``, and offers ``j + r_j(e)``; because a set's elements fill slots in
   correlated order, a set with enough elements is done after level 0, and only
   small sets go on (early stopping).
2. Texts with equal sets are one class; everything below works on classes.
3. Bands of ranks: classes that agree on a band share a bucket. ``band_count``
   takes the longest bands that miss a pair at the threshold with a probability
   of at most 1e-5: 16 of 4 ranks at 85 percent (7e-6), 21 of 3 at 80 (3e-7).
4. Pairs are confirmed on their full sets. A bucket is never turned into all its
   pairs: every member is compared with one pivot, the member that shares most
   buckets with others (in a group of variants: the least edited one), and the
   links found are merged by union-find.
5. Members of one pivot's group that are then still in several components are
   compared exactly as far as a link is possible. Two of them can only be linked
   if their parts outside the pivot share enough shingles: ``inter >= percent /
   (100 + percent) * (n + m)``, of which at most ``min(inter_u, inter_v)`` lie in the pivot. So they
   share one of the first shingles of those parts (prefix filter, with sizes and
   positions; the shingles rarest in the group come first, those of one member
   count for nothing), or need none (both nearly inside the pivot). In each such bucket
   growing numbers of members serve as pivots, compared with members of other
   components only, until no bucket holds two components: no link is missed.
6. Components: union-find inside each partition, then star contraction.

Defined results: NULL, empty and white-space texts have an empty set, are linked
with nothing and are kept; equal texts are linked; a component is named by its
smallest id (NULL ids after all others; a component of NULL ids has NULL); rows
that repeat an id and its text are one document; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import row_index
from ..session import configure, materialize
from ._text import Words, blocks, mix, utf8, window_hashes

SHINGLE = 5
SLOTS = 64
PERCENT = 85  # op7's links: 100 * intersection >= PERCENT * union
KEEP_PERCENT = 80  # keep_one's
MISS = 1e-5  # probability that a pair at the threshold shares no band
PIVOTS = 8  # growth of the number of pivots per bucket and round
EDGES = 1_000_000  # edges that one task's union-find takes
DIGEST = ["n", "d1", "d2"]
_WORD = r"[^\x20\x09-\x0D]"

_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)
_STEP = _U(0xA24BAED4963EE407)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash, row, rows): the distinct shingle hashes of each text, by row."""
    data, off = utf8(column)
    words = Words(data, off)
    h = words.hashes(fold_case=True)
    sh, at = window_hashes(h, words.row, words.first, SHINGLE)
    row = words.row[at]
    count = np.diff(words.first)
    for n in range(1, SHINGLE):
        if (short := np.flatnonzero(count == n)).size:
            few, at = window_hashes(h, words.row, words.first, n)
            mine = np.isin(words.row[at], short)
            sh = np.r_[sh, mix(few[mine] + _U(n))]
            row = np.r_[row, words.row[at][mine]]
    # One of each (row, hash), in order of rows.
    tag = mix(sh ^ mix(row.astype(_U) + _STEP))
    order = np.argsort(tag)
    new = np.r_[True, tag[order][1:] != tag[order][:-1]] if len(tag) else np.zeros(0, bool)
    one = np.sort(order[new])
    one = one[np.argsort(row[one], kind="stable")]
    return sh[one], row[one], len(off) - 1


def superminhash(h: np.ndarray, row: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """(rows, slots) SuperMinHash ranks; the level is in the top 6 bits."""
    shift = _U(58)
    sig = np.full((rows, slots), _FULL, _U)
    flat = sig.reshape(-1)
    place = None  # each element's permutation, kept only beyond level 0
    for j in range(slots):
        draw = mix(h + _U(int(_STEP) * (2 * j + 1) & int(_FULL)))
        to = (j + (mix(draw ^ _STEP) % _U(slots - j)).astype(np.int64)).astype(np.int64)
        if j == 0:
            slot = to
        else:
            each = np.arange(len(h))
            slot = place[each, to].astype(np.int64)
            place[each, to] = place[each, j]
        np.minimum.at(flat, row * slots + slot, (_U(j) << shift) | (draw >> _U(6)))
        if j + 1 == slots:
            break
        going = sig.max(axis=1) >= (_U(j + 1) << shift)
        mine = going[row]
        if not mine.any():
            break
        h, row = h[mine], row[mine]
        if j == 0:
            place = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
            each = np.arange(len(h))
            place[each, to[mine]] = 0  # the swap of level 0
        else:
            place = place[mine]
    return sig


def band_count(percent: int, slots: int = SLOTS) -> int:
    """Number of bands for links at ``percent``: the longest bands that miss at
    most ``MISS`` of the pairs at the threshold."""
    for ranks in range(slots, 0, -1):
        if (1 - (percent / 100) ** ranks) ** (slots // ranks) <= MISS:
            return slots // ranks
    raise ValueError(f"{percent} percent: {slots} ranks do not find such pairs")


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    """(rows, bands) hash of each band's ranks."""
    rows, slots = sig.shape
    ranks = slots // bands
    parts = sig[:, :bands * ranks].reshape(rows, bands, ranks)
    out = np.zeros((rows, bands), _U)
    for k in range(parts.shape[2]):
        out = mix(out * _STEP + parts[:, :, k])
    return out


def _row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    c = np.r_[_U(0), np.cumsum(values, dtype=_U)]
    edge = np.searchsorted(row, np.arange(rows + 1))
    return c[edge[1:]] - c[edge[:-1]]


SIGNED = "id0 bigint, nul boolean, th bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"


def _sign(bands: int):
    def run(batches):
        for batch in blocks(batches):
            h, row, rows = shingle_sets(batch.column("text"))
            found = band_hashes(superminhash(h, row, rows), bands).view(np.int64)
            n = np.bincount(row, minlength=rows)
            d1 = _row_sums(mix(h), row, rows).view(np.int64)
            d2 = _row_sums(mix(h ^ _STEP), row, rows).view(np.int64)
            off = np.arange(0, rows * bands + 1, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id0"), batch.column("nul"), batch.column("th"), pa.array(n, pa.int64()),
                 pa.array(d1), pa.array(d2),
                 pa.ListArray.from_arrays(pa.array(off), pa.array(found.reshape(-1)))],
                names=["id0", "nul", "th", "n", "d1", "d2", "bands"])
    return run


def _sets(batches):
    for batch in blocks(batches):
        h, row, rows = shingle_sets(batch.column("text"))
        edge = np.searchsorted(row, np.arange(rows + 1))
        out = [np.sort(h[edge[i]:edge[i + 1]]).tobytes() for i in range(rows)]
        yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(out, pa.binary())],
                                         names=["c", "set"])


def _overlap(outside: bool):
    """Size of the intersection; with ``outside``, the shingles of ``y`` outside ``x``."""
    def run(batches):
        for batch in batches:
            a, b = batch.column("set_x"), batch.column("set_y")
            inter, rest = [], []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(s[i].as_buffer(), _U) for s in (a, b))
                at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
                both = x[at] == y if len(x) else np.zeros(len(y), bool)
                inter.append(int(np.count_nonzero(both)))
                rest.append(y[~both].view(np.int64) if outside else None)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("x", "y", "nx", "ny")], pa.array(inter, pa.int64()),
                 pa.array(rest, pa.list_(pa.int64()))], names=["x", "y", "nx", "ny", "inter", "rest"])
    return run


def _union_find(batches):
    """Edges of one partition to (node, root) of its forest, root < node."""
    up: dict[int, int] = {}

    def root(a: int) -> int:
        while (b := up.get(a, a)) != a:
            up[a] = a = up.get(b, b)
        return a

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [k for k in up if up[k] != k]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()),
                                      pa.array([root(k) for k in nodes], pa.int64())],
                                     names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``(c, comp)`` of every node that has an edge ``(u, v)`` and is not its
    component's smallest node. Forests of at most ``EDGES`` edges each; if there
    are several, large-star and small-star rounds (Kiveris et al.) join them,
    until every node has one parent and no parent has a parent."""
    parts = edges.count() // EDGES + 1
    forest = materialize(edges.coalesce(parts).mapInArrow(_union_find, "u bigint, v bigint"), "forest")
    while parts > 1:
        twice = forest.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        deep = forest.select("v").join(forest.select(F.col("u").alias("v")), "v", "left_semi")
        if twice.isEmpty() and deep.isEmpty():
            break
        both = forest.union(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        forest = materialize(small.where("u <> v").union(low.select("u", F.col("m").alias("v")))
                             .distinct(), "small-star")
    return forest.select(F.col("u").alias("c"), F.col("v").alias("comp"))


def _verify(pairs: DataFrame, sets: DataFrame, outside: bool = False) -> DataFrame:
    """``(x, y, nx, ny, inter, rest)`` of candidate pairs ``(x, y)``, on full sets."""
    size = (F.octet_length("set") / 8).cast("long")
    side = [sets.select(F.col("c").alias(k), size.alias(f"n{k}"), F.col("set").alias(f"set_{k}"))
            for k in ("x", "y")]
    full = pairs.join(side[1], "y").join(side[0], "x")
    return full.select("x", "y", "nx", "ny", "set_x", "set_y").mapInArrow(
        _overlap(outside), "x bigint, y bigint, nx bigint, ny bigint, inter bigint, rest array<bigint>")


def _labels(tested: DataFrame, percent: int) -> DataFrame:
    linked = F.col("inter") * 100 >= (F.col("nx") + F.col("ny") - F.col("inter")) * percent
    return components(tested.where(linked).select(F.col("y").alias("u"), F.col("x").alias("v")))


def _several(rows: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with their component, of those groups that hold several."""
    rows = rows.join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    mixed = (rows.groupBy(*by).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"))
                 .where("lo < hi").drop("lo", "hi"))
    return rows.drop("least").join(mixed, by)


def _links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Component labels ``(c, comp)`` from buckets ``(b, h, c, k)`` of ``k``
    members."""
    score = buckets.groupBy("c").agg(F.sum("k").alias("score"))
    pivot = (buckets.join(score, "c").groupBy("b", "h")
                    .agg(F.max(F.struct("score", (-F.col("c")).alias("c"))).alias("x"))
                    .select("b", "h", (-F.col("x.c")).alias("p")))
    pairs = (buckets.join(pivot, ["b", "h"]).where("c <> p")
                    .select(F.col("p").alias("x"), F.col("c").alias("y")).distinct())
    tested = materialize(_verify(pairs, sets, outside=True), "tested")
    labels = _labels(tested, percent)

    # Groups of a pivot that hold several components; ``i`` is the part of a
    # member inside the pivot.
    members = tested.select(F.col("x").alias("p"), F.col("y").alias("c"), F.col("ny").alias("n"),
                            F.col("inter").alias("i"), "rest")
    members = materialize(_several(members, labels, ["p"]), "groups")
    tested = tested.drop("rest")

    def need(n, m):  # least intersection of linked sets, times (100 + percent)
        return (n + m) * percent

    whole = 100 + percent
    # The partner is at least as large as the group's smallest, and percent of n.
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    free = (members.where(F.col("i") * whole >= need(F.col("n"), partner))
                   .select("p", F.lit(0).cast("long").alias("t"), F.lit(True).alias("b"),
                           F.lit(0).alias("left"), "c", "n", "i"))
    # Shingles outside the pivot that several members have, the rarest of the group
    # first; ``left`` is their number from this one on. Those of one member link nothing.
    outside = members.select("p", "c", "n", "i", "least", F.explode("rest").alias("t"))
    common = outside.groupBy("p", "t").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    last = Window.partitionBy("p", "c").orderBy(F.desc("f"), F.desc("t"))
    shared = (outside.join(common, ["p", "t"]).withColumn("left", F.row_number().over(last))
                     .where((F.col("i") + F.col("left")) * whole >= need(F.col("n"), partner))
                     .select("p", "t", F.lit(False).alias("b"), "left", "c", "n", "i"))
    rows, key, pivots = materialize(free.union(shared), "shared"), ["p", "t", "b"], 1
    while True:
        rows = materialize(_several(rows.drop("comp", "least"), labels, key), "open")
        if rows.isEmpty():
            return labels
        pivots *= PIVOTS
        part = F.pmod(F.xxhash64("c", F.lit(pivots)), F.lit(pivots)).alias("s")
        chosen = (rows.groupBy(*key, part).agg(F.max(F.struct("left", "c", "comp", "n", "i")).alias("v"))
                      .select(*key, "v"))
        n, m = F.col("n"), F.col("v.n")
        inside = F.least(F.col("i"), F.col("v.i"))
        outside = F.least(F.col("left"), F.col("v.left"))
        possible = ((F.col("comp") != F.col("v.comp")) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
                    & ((inside + outside) * whole >= need(n, m)))
        pairs = (rows.join(chosen, key).where(possible)
                     .select(F.least("c", "v.c").alias("x"), F.greatest("c", "v.c").alias("y")).distinct())
        known = tested.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        more = materialize(_verify(pairs.join(known, ["x", "y"], "left_anti"), sets).drop("rest"), "tested")
        if not more.isEmpty():
            tested = tested.unionByName(more)
            labels = _labels(tested, percent)
        rows = rows.join(chosen.select(*key, F.col("v.c").alias("c")), [*key, "c"], "left_anti")


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(signed, classes, labels)``: each row's digest, the classes of equal
    sets with their first row ``(nul, id0, th)``, and ``(c, comp)`` of those
    classes that are not their component's first."""
    configure(docs.sparkSession)
    key, text = docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(F.coalesce(key, F.lit(0)).alias("id0"), key.isNull().alias("nul"),
                       F.xxhash64(text).alias("th"), text.alias("text"))
    signed = materialize(base.mapInArrow(_sign(band_count(percent)), SIGNED), "signatures")
    first = F.min(F.struct("nul", "id0", "th")).alias("rep")
    classes = (signed.where("n > 0").groupBy(*DIGEST)
                     .agg(first, F.first("bands").alias("bands")).select(*DIGEST, "rep.*", "bands"))
    classes = materialize(row_index(classes, ["nul", "id0", "th"], "c"), "classes")

    banded = classes.select("c", F.posexplode("bands").alias("b", "h"))
    shared = banded.groupBy("b", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    buckets = materialize(banded.join(shared, ["b", "h"]), "buckets")
    wanted = classes.join(buckets.select("c").distinct(), "c", "left_semi").select("id0", "nul", "th", "c")
    once = Window.partitionBy("id0", "nul", "th").orderBy("th")
    texts = base.withColumn("k", F.row_number().over(once)).where("k = 1").drop("k")
    sets = materialize(texts.join(wanted, ["id0", "nul", "th"]).select("c", "text")
                       .mapInArrow(_sets, "c bigint, set binary"), "sets")
    return signed, classes, _links(buckets, sets, percent)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """``(id0, nul, th, n_shingles, component_id)`` per row: ``id0``/``nul`` the
    id, ``th`` the text's hash. Sets are linked at ``percent`` (of 100)."""
    signed, classes, labels = _components(docs, id_col, text_col, percent)
    ids = classes.join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    name = classes.select(F.col("c").alias("comp"),
                          F.when(~F.col("nul"), F.col("id0")).alias("component_id"))
    named = ids.join(name, "comp").select(*DIGEST, "component_id")
    own = F.when(~F.col("nul"), F.col("id0"))
    rows = signed.drop("bands").join(named, DIGEST, "left")
    return rows.select("id0", "nul", "th", own.alias(id_col), F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("component_id")).otherwise(own).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             percent: int = KEEP_PERCENT) -> DataFrame:
    """One row of ``docs`` per group of near duplicates, whatever its ids, and
    every text without words. The row is one with the group's smallest id (NULL
    ids last) and text hash; of rows equal in both, the one with the smallest row
    hash. Repeated rows are reduced in each task before the exchange."""
    _, classes, labels = _components(docs, id_col, text_col, percent)
    at = ["__id0", "__nul", "__th"]
    first = (classes.join(labels, "c", "left_anti")
                    .select(*[F.col(c[2:]).alias(c) for c in at]))
    key, text = docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"),
                       F.coalesce(key, F.lit(0)).alias("__id0"), key.isNull().alias("__nul"),
                       F.xxhash64(text).alias("__th"), text.rlike(_WORD).alias("__words"))
    one = rows.where("__words").groupBy(*at).agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    kept = one.join(first, at, "left_semi").select("__row.*")
    return kept.unionByName(rows.where("not __words").select("__row.*"))


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components over all ``documents``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=PERCENT)
    return found.select("doc_id", "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END AS g
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2)))::INT AS i) WHERE len(ws) > 0),
g AS (SELECT hash(g) AS h, g, doc_id FROM s),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b
      ON a.h = b.h AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
e2 AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e2.y FROM r JOIN e2 ON e2.x = r.reach)
SELECT w.doc_id, COALESCE(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1) m
USING (doc_id)
"""

QUERIES = {"op7_near_duplicates": (op7_near_duplicates, ORACLE)}
