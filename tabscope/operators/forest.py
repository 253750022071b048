"""Random forests (M2, M7) whose trees are grown in the tasks and kept as a table.

Spark's forest holds all nodes of all trees on the driver and shuffles the counts
of every open node once per partition; a forest of unlimited depth has some 50
nodes a row, so both grow with the table. Here each task grows some of the trees on
the binned rows (one byte a slot) and writes their nodes as rows of a table:

* bins: at most ``MAX_BINS`` a slot, from all rows (:func:`~tabscope.operators.models.bin_edges`);
* bootstrap: Poisson(1) weights per tree, drawn over the rows in the order of
  their contents, so a forest depends on the rows and the seed, not on their files;
* splits: variance or Gini decrease over all slots, or over ``ceil(sqrt(slots))``
  drawn for each node; the smallest bin of the first best slot wins ties;
* a node is a leaf if it is pure, at ``max_depth``, would fall below ``min_leaf``
  rows (counted with their weights) or has no split with a gain; two leaves with one
  prediction become their parent (as in Spark's forests);
* predictions: the mean over the trees, or the class with the largest sum of the
  leaves' class shares; importances as in Spark's forests.

Scale: the driver holds the thresholds and one number per slot. A task holds the
training rows as bins (slots + 8 bytes a row) and the working arrays of one tree.
The rows are shuffled once per group of trees. NULL, NaN or infinite inputs are errors.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MAX_BINS = 32
GROUPS = 25  # tasks that the trees are dealt to, at most
ROWS_OUT = 50_000  # nodes of one Arrow batch

NODES = "key int, tree int, node int, slot int, cut int, left int, value double, gain double, share array<double>"
PACKED = "key int, n int, bins binary, more binary"


def _packed(edges: list[list[float]], keys: list[int], more: str):
    """Per Arrow batch and group of trees one row: the bins and the column ``more``."""
    cuts = [np.array(e) for e in edges]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = batch.column("x"), batch.num_rows
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
            bins = np.empty((n, len(cuts)), np.uint8)
            for s, own in enumerate(cuts):
                bins[:, s] = np.searchsorted(own, flat[:, s], "left")
            block, rest = bins.tobytes(), batch.column(more).to_numpy(zero_copy_only=False).tobytes()
            for key in keys:
                yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int32()), "n": pa.array([n], pa.int32()),
                                                  "bins": [block], "more": [rest]})
    return run


def _unpacked(blocks: list[tuple], slots: int, kind) -> tuple[np.ndarray, np.ndarray]:
    bins = [np.frombuffer(b, np.uint8).reshape(n, slots) for n, b, _ in blocks]
    return np.concatenate(bins), np.concatenate([np.frombuffer(m, kind) for *_, m in blocks])


def _by_content(bins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The order of the rows by a hash of their contents: the same for any layout."""
    odd = np.random.default_rng(7).integers(0, 1 << 63, bins.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.array(y, np.float64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for s in range(bins.shape[1]):
        h += (bins[:, s] + np.uint64(1)) * odd[s]
        h ^= h >> np.uint64(29)
    return np.lexsort((y, h))


class _Tree:
    """Grows one tree, level by level, all open nodes of a level at once."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, classes: int, subset: int | None, depth: int, least: int):
        self.bins, self.classes, self.subset, self.depth, self.least = bins, classes, subset, depth, least
        self.mean = 0.0 if classes or not len(y) else float(y.mean())
        self.y = y.astype(np.int64) if classes else y - self.mean
        top = bins.max(axis=0, initial=0) if len(bins) else np.zeros(bins.shape[1], np.uint8)
        self.numeric = np.flatnonzero(top > 1) if subset is None else np.arange(bins.shape[1])
        self.binary = np.flatnonzero(top == 1) if subset is None else np.zeros(0, np.int64)
        self.ones = np.nonzero(bins[:, self.binary])  # rows and places of the ones
        self.columns = {s: np.ascontiguousarray(bins[:, s]) for s in self.numeric} if subset is None else {}

    def _sums(self, key: np.ndarray, size: int, w: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums of weights per key: by class, or of 1 and of the label."""
        if self.classes:
            return np.bincount(key * self.classes + y, w, size * self.classes).reshape(size, self.classes)
        return np.column_stack([np.bincount(key, w, size), np.bincount(key, w * y, size)])

    def _cells(self, key: np.ndarray, size: int, w: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys that occur, ascending, and their sums."""
        if size * max(1, self.classes) <= 8 * len(key) + 1024:
            sums = self._sums(key, size, w, y)
            ids = np.flatnonzero(np.bincount(key, minlength=size))
            return ids, sums[ids]
        ids, place = np.unique(key, return_inverse=True)
        return ids, self._sums(place, len(ids), w, y)

    def _count(self, sums: np.ndarray) -> np.ndarray:
        return sums.sum(axis=1) if self.classes else sums[:, 0]

    def _score(self, sums: np.ndarray) -> np.ndarray:
        part = (sums * sums).sum(axis=1) if self.classes else sums[:, 1] ** 2
        return part / np.maximum(self._count(sums), 1e-300)

    def _better(self, best, node, slot, cut, left, total) -> None:
        """Takes over the first best candidate of each node (``node`` ascending)."""
        if not len(node):
            return
        right = total[node] - left
        fits = (self._count(left) >= self.least) & (self._count(right) >= self.least)
        score = np.where(fits, self._score(left) + self._score(right), -np.inf)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        high = np.maximum.reduceat(score, first)
        hits = np.flatnonzero(score == np.repeat(high, np.diff(np.r_[first, len(node)])))
        own, at = np.unique(node[hits], return_index=True)
        at = hits[at]
        new = score[at] > best[0][own]
        for kept, found in zip(best, (score, slot, cut)):
            kept[own[new]] = found[at][new]

    def _best(self, rows, node, w, y, ones, total, rng):
        """Score, slot and bin of the best split of each open node."""
        n = len(total)
        best = (np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64))
        if self.subset is None:
            drawn = self.numeric
        else:
            drawn = np.sort(np.argsort(rng.random((n, self.bins.shape[1])), axis=1)[:, :self.subset], axis=1)
        for j in range(drawn.shape[-1]):
            slot = np.full(n, drawn[j]) if self.subset is None else drawn[:, j]
            own = self.columns[drawn[j]][rows] if self.subset is None else self.bins[rows, slot[node]]
            ids, sums = self._cells(node * MAX_BINS + own, n * MAX_BINS, w, y)
            at, cut = ids // MAX_BINS, ids % MAX_BINS
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            upto = np.cumsum(sums, axis=0)
            left = upto - np.repeat(upto[first] - sums[first], np.diff(np.r_[first, len(at)]), axis=0)
            left[np.r_[first[1:] - 1, len(at) - 1]] = total[at[first]]  # the last bin leaves nothing on the right
            self._better(best, at, slot[at], cut, left, total)
        if len(self.binary):
            row, place = ones
            wide = len(self.binary)
            ids, sums = self._cells(node[row] * wide + place, n * wide, w[row], y[row])
            at = ids // wide
            self._better(best, at, self.binary[ids % wide], np.zeros(len(ids), np.int64), total[at] - sums, total)
        return best

    def grow(self, weight: np.ndarray, rng) -> dict[str, np.ndarray]:
        rows = np.flatnonzero(weight)
        w, y, node = weight[rows].astype(float), self.y[rows], np.zeros(len(rows), np.int64)
        place = np.full(len(weight), -1)
        place[rows] = np.arange(len(rows))
        row, spot = self.ones
        ones = (place[row][place[row] >= 0], spot[place[row] >= 0])
        out, base, n = [], 0, 1 if len(rows) else 0
        while n:
            total = self._sums(node, n, w, y)
            count = self._count(total)
            slot, cut, left, gain = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
            if self.classes:
                value, pure = total.argmax(axis=1).astype(float), total.max(axis=1) == count
                size = count
            else:
                value, size = self.mean + total[:, 1] / count, np.bincount(node, w * y * y, n)
                low, high = np.full(n, np.inf), np.full(n, -np.inf)
                np.minimum.at(low, node, y)
                np.maximum.at(high, node, y)
                pure = low == high
                value[pure] = self.mean + low[pure]
            level = {"slot": slot, "cut": cut, "left": left, "value": value, "gain": gain, "sums": total if self.classes else total[:, :0]}
            out.append(level)
            is_open = ~pure & (count >= 2 * self.least)
            if len(out) > self.depth or not is_open.any():
                break
            rows, w, y, node, ones = self._kept(is_open, rows, w, y, node, ones)
            at = np.flatnonzero(is_open)
            score, where, bin_ = self._best(rows, node, w, y, ones, total[at], rng)
            more = score - self._score(total[at])
            split = np.isfinite(score) & (more > 1e-12 * size[at])
            slot[at[split]], cut[at[split]], gain[at[split]] = where[split], bin_[split], more[split]
            left[at[split]] = base + n + 2 * np.arange(split.sum())
            rows, w, y, node, ones = self._kept(split, rows, w, y, node, ones)
            right = self.bins[rows, where[split][node]] > bin_[split][node]
            node = 2 * node + right
            base, n = base + n, 2 * int(split.sum())
        return self._pruned(out)

    @staticmethod
    def _kept(keep, rows, w, y, node, ones):
        """The rows of the nodes that are kept, nodes and rows numbered anew."""
        stay = keep[node]
        to = np.cumsum(stay) - 1
        row, spot = ones
        own = stay[row]
        return (rows[stay], w[stay], y[stay], (np.cumsum(keep) - 1)[node[stay]], (to[row[own]], spot[own]))

    @staticmethod
    def _pruned(levels: list[dict]) -> dict[str, np.ndarray]:
        if not levels:
            raise ValueError("a tree without rows")
        ends = np.cumsum([len(x["slot"]) for x in levels])
        t = {c: np.concatenate([x[c] for x in levels]) for c in levels[0]}
        for a, b in zip(np.r_[0, ends[:-1]][::-1], ends[::-1]):
            inner = a + np.flatnonzero(t["slot"][a:b] >= 0)
            kids = t["left"][inner]
            same = (t["slot"][kids] < 0) & (t["slot"][kids + 1] < 0) & (t["value"][kids] == t["value"][kids + 1])
            for c, v in (("slot", -1), ("left", -1), ("gain", 0.0)):
                t[c][inner[same]] = v
        reach = np.zeros(len(t["slot"]), bool)
        reach[0] = True
        for a, b in zip(np.r_[0, ends[:-1]], ends):
            kids = t["left"][a:b][reach[a:b] & (t["slot"][a:b] >= 0)]
            reach[kids] = reach[kids + 1] = True
        number = np.cumsum(reach) - 1
        t = {c: v[reach] for c, v in t.items()}
        t["left"] = np.where(t["slot"] >= 0, number[t["left"]], -1)
        return t


def _node_batches(key: int, tree: int, t: dict[str, np.ndarray], classes: int):
    sums = t["sums"]
    mixed = (t["slot"] < 0) & ((sums > 0).sum(axis=1) > 1) if classes else np.zeros(len(t["slot"]), bool)
    for a in range(0, len(t["slot"]), ROWS_OUT):
        s = slice(a, a + ROWS_OUT)
        n = len(t["slot"][s])
        own = sums[s][mixed[s]]
        share = own / own.sum(axis=1, keepdims=True) if len(own) else own
        offsets = np.r_[0, np.cumsum(np.where(mixed[s], classes, 0))].astype(np.int32)
        ints = {"key": np.full(n, key), "tree": np.full(n, tree), "node": np.arange(a, a + n), "slot": t["slot"][s],
                "cut": t["cut"][s], "left": t["left"][s]}
        yield pa.RecordBatch.from_pydict({
            **{c: pa.array(v.astype(np.int32)) for c, v in ints.items()}, "value": t["value"][s], "gain": t["gain"][s],
            "share": pa.ListArray.from_arrays(pa.array(offsets), pa.array(share.ravel(), pa.float64()))})


def _grown(slots: int, dealt: dict[int, list[int]], classes: int, subset: int | None, depth: int, least: int, seed: int):
    def run(batches):
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for key, n, bins, more in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "bins", "more"))):
                held.setdefault(key, []).append((n, bins, more))
        while held:
            key, blocks = held.popitem()
            bins, y = _unpacked(blocks, slots, np.float64)
            del blocks
            order = _by_content(bins, y)
            plan = _Tree(bins[order], y[order], classes, subset, depth, least)
            for tree in dealt[key]:
                rng = np.random.default_rng([seed, tree])
                weight = rng.poisson(1.0, len(y)).astype(np.uint8)
                if not weight.any():  # a handful of rows, none of them drawn
                    weight[:] = 1
                yield from _node_batches(key, tree, plan.grow(weight, rng), classes)
    return run


def _scored(slots: int, classes: int):
    def run(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        blocks = list(zip(*(rows.column(c).to_pylist() for c in ("n", "bins", "more"))))
        bins, ids = _unpacked(blocks, slots, np.int64) if blocks else (np.zeros((0, slots), np.uint8), np.zeros(0, np.int64))
        sums = np.zeros((len(ids), max(classes, 1)))
        part = nodes.column("tree").to_numpy()
        every = np.arange(len(ids))
        for tree in np.unique(part):
            own = nodes.filter(pa.array(part == tree)).sort_by("node").combine_chunks()
            slot, cut, left, value = (own.column(c).to_numpy() for c in ("slot", "cut", "left", "value"))
            at, go = np.zeros(len(ids), np.int64), every
            while len(go):
                go = go[slot[at[go]] >= 0]
                here = at[go]
                at[go] = left[here] + (bins[go, slot[here]] > cut[here])
            if not classes:
                sums[:, 0] += value[at]
                continue
            share = own.column("share").combine_chunks()
            size = np.diff(share.offsets.to_numpy()) if len(share) else np.zeros(0)
            table = np.zeros((len(slot), classes))
            table[np.arange(len(slot)), value.astype(np.int64)] = 1.0
            table[size > 0] = share.flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
            sums += table[at]
        at, k = np.nonzero(sums) if classes else (every, np.zeros(len(ids), np.int64))
        return pa.table({"_row": ids[at], "k": k.astype(np.int32), "v": sums[at, k]})
    return run


def _keys(spark, n: int) -> list[int]:
    """``n`` keys that a hash exchange over ``n`` partitions puts one into each."""
    ids = spark.range(40 * n).select(F.col("id").cast("int").alias("k"))
    first = {r["p"]: r["k"] for r in ids.groupBy(F.expr(f"pmod(hash(k), {n})").alias("p")).agg(F.min("k").alias("k")).collect()}
    rest = (k for k in range(40 * n) if k not in set(first.values()))
    return [first[p] if p in first else next(rest) for p in range(n)]


class Forest(Estimator):
    """Random forest for regression, or for classes 0, 1, …"""

    def __init__(self, task: str, trees: int = 100, max_depth: int = 30, min_leaf: int = 1, subset: str = "all",
                 seed: int = 42, features="features", label="label", prediction="prediction"):
        super().__init__()
        self.task, self.trees, self.max_depth, self.min_leaf, self.subset = task, trees, max_depth, min_leaf, subset
        self.seed, self.features, self.label, self.prediction = seed, features, label, prediction

    def _fit(self, df: DataFrame) -> ForestModel:
        from .models import BIN_VALUES, bin_edges
        spark = df.sparkSession
        x, y = vector_to_array(F.col(self.features)), F.col(self.label).cast("double")
        wrong = y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
        if self.task == "classification":
            wrong = wrong | (y < 0) | (y != F.floor(y))
        told = "Labels MUST be " + ("whole numbers from 0" if self.task == "classification" else "numbers, not NULL, NaN or Infinity")
        y = F.when(wrong, F.raise_error(F.lit(told)).cast("double")).otherwise(y)
        first = df.select(F.size(x).alias("d")).first()
        if first is None:
            raise ValueError("no rows to grow a forest on")
        slots = int(first["d"])
        classes = int(df.agg(F.max(y).alias("y")).first()["y"]) + 1 if self.task == "classification" else 0
        edges = bin_edges(df, self.features, slots, MAX_BINS, max(MAX_BINS, BIN_VALUES // max(slots, 1)))
        n = min(self.trees, GROUPS)
        keys = _keys(spark, n)
        dealt = {key: list(range(k, self.trees, n)) for k, key in enumerate(keys)}
        subset = None if self.subset == "all" else math.ceil(math.sqrt(slots))
        packed = df.select(x.alias("x"), y.alias("y")).mapInArrow(_packed(edges, keys, "y"), PACKED)
        grown = packed.repartition(n, "key").mapInArrow(
            _grown(slots, dealt, classes, subset, self.max_depth, self.min_leaf, self.seed), NODES)
        return ForestModel(materialize(grown, "trees", keep=True), edges, keys, self.trees, classes, self.features, self.prediction)


class ForestModel(Model, MLReadable, MLWritable):
    """Fitted forest: ``nodes`` is the table of all trees' nodes."""

    def __init__(self, nodes: DataFrame | None = None, edges=(), keys=(), trees: int = 0, classes: int = 0,
                 features="features", prediction="prediction"):
        super().__init__()
        self.nodes, self.edges, self.keys, self.trees, self.classes = nodes, list(edges), list(keys), trees, classes
        self.features, self.prediction = features, prediction

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - Spark's name
        """Per tree the gains by slot as shares of all, then the mean over the trees that split."""
        gains = self.nodes.where("slot >= 0").groupBy("tree", "slot").agg(F.sum("gain").alias("g"))
        whole = gains.groupBy("tree").agg(F.sum("g").alias("all"))
        shares = gains.join(whole, "tree").groupBy("slot").agg(F.sum(F.col("g") / F.col("all")).alias("s"))
        out = np.zeros(len(self.edges))
        for r in shares.collect():
            out[r["slot"]] = r["s"]
        return DenseVector(out / out.sum() if out.sum() else out)

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "unscored")
        packed = rows.select("_row", vector_to_array(F.col(self.features)).alias("x")).mapInArrow(
            _packed(self.edges, self.keys, "_row"), PACKED).repartition(len(self.keys), "key")
        nodes = self.nodes.drop("gain").repartition(len(self.keys), "key")
        votes = packed.groupBy("key").cogroup(nodes.groupBy("key")).applyInArrow(
            _scored(len(self.edges), self.classes), "_row long, k int, v double")
        sums = votes.groupBy("_row", "k").agg(F.sum("v").alias("v"))
        if self.classes:
            found = sums.groupBy("_row").agg((-F.max(F.struct("v", (-F.col("k")).alias("k")))["k"]).cast("double").alias(self.prediction))
        else:
            found = sums.select("_row", (F.col("v") / self.trees).alias(self.prediction))
        return rows.join(found, "_row").drop("_row")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        kept = {"edges": json.dumps(m.edges), "keys": m.keys, "trees": m.trees, "classes": m.classes,
                "features": m.features, "prediction": m.prediction}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, {"forest": kept})
        m.nodes.write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        kept = meta["forest"]
        model = ForestModel(self.sparkSession.read.parquet(f"{path}/nodes"), json.loads(kept["edges"]), kept["keys"],
                            kept["trees"], kept["classes"], kept["features"], kept["prediction"])
        model._resetUid(meta["uid"])
        return model
