"""Operator 13: ranked lexical search by dual-tree bounds.

Every item (query text) gets its ``k`` best documents under an integer BM25-like
score: the sum over the item's terms of ``w * impact``, where ``w`` falls with
the term's document count and ``impact`` grows with its occurrences in the
document and falls with the document's length.

1. One scan cuts the documents into terms and keeps, of each, its length and the
   occurrences of terms that some item has; each task adds a row of its term
   statistics. The weights come from the sums of these rows.
2. Items form a hierarchy: sorted by their heaviest terms, halved down to
   ``ITEM_LEAF`` items. Documents form one per batch, sorted by the terms that
   count most in them, halved down to ``DOC_LEAF`` documents. Every node holds
   the maximum of each coordinate over what is below it: of ``w`` times the
   occurrences in items, of ``impact`` in documents.
3. The product of two nodes' maxima is at least the score of any pair below
   them. A pair of nodes is dropped when it is less than the weakest k-th best
   score so far among the node's items; the rest goes down a level in both
   hierarchies. Pairs of leaves that are left are scored exactly.
4. The search runs twice, first over one document in ``SEED`` by hash of the id.
   An item's k-th best there is a lower bound that all tasks of the second run,
   over all documents, start from; so late tasks return few candidates.

Bounds and scores are whole numbers in doubles below 2**53 (or in 64-bit
integers, for items whose scores might be larger), so pruning loses nothing.

Defined results: NULL or term-less items have no rows; NULL or term-less
documents have score 0 and are not returned; equal scores are ordered by id,
NULL ids last; repeated rows are separate documents; repeated items are separate
items; an empty table gives no rows; only the named columns are read. Very long
texts are counted piece by piece. Ids are integers.

Scale: documents are scanned once per block of items (at least 1,024 items or
``ITEM_BYTES`` of their text, which is all that the driver and the tasks hold);
nothing of the documents is shuffled but each task's candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import row_index
from ..session import materialize
from . import _terms

K = 10
SEED = 64
DOC_LEAF = 32
ITEM_LEAF = 8
#: Item text searched with one scan; cells of one dense matrix; leaves of a batch.
ITEM_BYTES = 16 << 20
CELLS = 4 << 20
MOST_LEAVES = 128
#: The score: unit of impact, weight of length in percent.
UNIT, SLOPE = 1_000_000_000, 75
EXACT = 1 << 53


# ---------------------------------------------------------------- documents

_VECTOR = "id long, n long, term array<int>, tf array<int>, stats boolean"


def _lists(first: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))


def _vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """One row ``(id, n, term, tf)`` per document that has a term of the
    vocabulary, and one row per task with its documents (``id``), terms (``n``)
    and the document counts of the vocabulary."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())

    def run(batches):
        vocab = pa.array(words.value, pa.binary())
        size = len(vocab)
        n_docs, n_terms, df = 0, 0, np.zeros(size, np.int64)
        open_tf, open_n = np.zeros(size, np.int64), 0

        def out(ids, n, first, term, tf, stats=False):
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(n), _lists(first, term), _lists(first, tf), pa.array([stats] * len(n))],
                ["id", "n", "term", "tf", "stats"])

        for batch in batches:
            ids = batch.column("id")
            for seg in _terms.segments(batch.column("text"), _terms.LETTERS_DIGITS):
                to = pc.fill_null(pc.index_in(seg.terms, value_set=vocab), -1).to_numpy(zero_copy_only=False)
                at = to[seg.code].astype(np.int64)
                if not seg.whole:  # a piece of a long text
                    open_n += len(seg.code)
                    open_tf += np.bincount(at[at >= 0], minlength=size)
                    if not seg.last:
                        continue
                    rows, n = np.array([seg.rows[0]]), np.array([open_n])
                    term = np.flatnonzero(open_tf)
                    tf, first = open_tf[term], np.array([0, len(term)])
                    open_tf, open_n = np.zeros(size, np.int64), 0
                else:
                    rows = np.arange(seg.rows.start, seg.rows.stop)
                    n = np.bincount(seg.row - seg.rows.start, minlength=len(rows))
                    ok = at >= 0
                    key, tf = np.unique((seg.row[ok] - seg.rows.start) * size + at[ok], return_counts=True)
                    term = key % size if size else key
                    first = np.searchsorted(key, np.arange(len(rows) + 1) * size)
                n_docs += int((n > 0).sum())
                n_terms += int(n.sum())
                df += np.bincount(term, minlength=size)
                has = np.flatnonzero(np.diff(first))
                if len(has):
                    yield out(ids.take(pa.array(rows[has])), n[has], np.r_[first[has], first[-1]], term, tf)
        seen = np.flatnonzero(df)
        yield out(pa.array([n_docs]), np.array([n_terms]), np.array([0, len(seen)]), seen, df[seen], True)
    return materialize(docs.mapInArrow(run, _VECTOR), "tree-docs")


def _weights(vectors: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(N, L, weight of each term of the vocabulary)."""
    stats = vectors.where("stats")
    n_docs, n_terms = stats.agg(F.sum("id"), F.sum("n")).first()
    df = np.zeros(size, np.int64)
    for r in (stats.select(F.explode(F.arrays_zip("term", "tf")).alias("x"))
              .groupBy("x.term").agg(F.sum("x.tf").alias("df")).collect()):
        df[r["term"]] = r["df"]
    n_docs, n_terms = n_docs or 0, n_terms or 0
    return n_docs, n_terms, np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


# -------------------------------------------------------------------- trees

def _levels(leaf_max: np.ndarray, pick) -> list[np.ndarray]:
    """From the root's row to the leaves' rows (a power of two): ``pick`` of the
    two children in each coordinate."""
    out = [leaf_max]
    while len(out[0]) > 1:
        out.insert(0, pick(out[0][0::2], out[0][1::2]))
    return out


def _order(first: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rows of a sparse matrix sorted by their two terms of highest value."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    by = np.lexsort((term, -value, row))
    keys = []
    for nth in (0, 1):
        at = first[:-1] + nth
        has = at < first[1:]
        key = np.full(n, -1, np.int64)
        key[has] = term[by[at[has]]]
        keys.append(key)
    return np.lexsort((keys[1], keys[0]))


def _power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


class Tile:
    """A run of items, small enough for dense matrices, with its hierarchy."""

    def __init__(self, items: np.ndarray, vectors: list, vocabulary: int):
        self.items = items  # item numbers in tree order
        self.terms = np.unique(np.concatenate([vectors[i][0] for i in items]))
        self.local = np.full(vocabulary, -1, np.int64)
        self.local[self.terms] = np.arange(len(self.terms))
        exact = max(int(vectors[i][1].sum()) for i in items) * (UNIT // 1000) < EXACT
        self.kind = np.float64 if exact else np.int64
        self.n_leaves = _power(-(-len(items) // ITEM_LEAF))
        w = np.zeros((self.n_leaves * ITEM_LEAF, len(self.terms)), self.kind)
        for x, i in enumerate(items):
            w[x, self.local[vectors[i][0]]] = vectors[i][1]
        self.weights = w[:len(items)]
        self.levels = _levels(w.reshape(self.n_leaves, ITEM_LEAF, -1).max(1), np.maximum)

    def weakest(self, kth: np.ndarray) -> list[np.ndarray]:
        """The lowest k-th score below each node, by level."""
        full = np.full(self.n_leaves * ITEM_LEAF, np.iinfo(np.int64).max)
        full[:len(self.items)] = kth[self.items]
        return _levels(full.reshape(self.n_leaves, ITEM_LEAF).min(1), np.minimum)


def make_tiles(vectors: list, vocabulary: int) -> list[Tile]:
    """``vectors[i] = (terms, weights)`` of item ``i``; items without terms are
    in no tile."""
    some = [i for i, v in enumerate(vectors) if len(v[0]) and v[1].any()]
    if not some:
        return []
    first = np.cumsum([0, *[len(vectors[i][0]) for i in some]])
    order = _order(first, np.concatenate([vectors[i][0] for i in some]), np.concatenate([vectors[i][1] for i in some]))
    tiles, run, terms = [], [], set()
    for i in (some[x] for x in order):
        more = terms | set(vectors[i][0].tolist())
        if run and (len(run) + 1) * len(more) > CELLS:
            tiles.append(Tile(np.array(run), vectors, vocabulary))
            run, more = [], set(vectors[i][0].tolist())
        run.append(i)
        terms = more
    return [*tiles, Tile(np.array(run), vectors, vocabulary)]


class Best:
    """The ``k`` best (score, id) of each item; ``floor``: known lower bounds."""

    def __init__(self, n_items: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, np.maximum(floor, 1)  # only scores above 0 count
        self.kth = self.floor.copy()
        self.rows: list = [None] * n_items

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if self.rows[item] is not None:
            old = self.rows[item]
            score, ids, null = np.r_[old[0], score], np.r_[old[1], ids], np.r_[old[2], null]
        best = np.lexsort((ids, null, -score))[:self.k]
        self.rows[item] = score[best], ids[best], null[best]
        if len(best) == self.k:
            self.kth[item] = max(self.floor[item], score[best[-1]])


def search_batch(tile: Tile, first, term, impact, ids, null, best: Best, count=None) -> None:
    """Search one batch of documents (rows of a sparse matrix: ``first``,
    ``term``, ``impact``) for the items of ``tile``."""
    local = tile.local[term]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = local >= 0
    row, local, impact = row[ok], local[ok], impact[ok]
    has = np.unique(row)  # documents with a term of the tile
    if not len(has):
        return
    row = np.searchsorted(has, row)
    ids, null = ids[has], null[has]
    start = np.searchsorted(row, np.arange(len(has) + 1))
    order = _order(start, local, impact)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by = np.argsort(place[row], kind="stable")
    row, local, impact = place[row][by], local[by], impact[by].astype(tile.kind)
    ids, null = ids[order], null[order]
    start = np.searchsorted(row, np.arange(len(has) + 1))

    leaves = _power(-(-len(has) // DOC_LEAF))
    top = np.zeros((leaves, len(tile.terms)), tile.kind)
    np.maximum.at(top, (row // DOC_LEAF, local), impact)
    levels = _levels(top, np.maximum)

    # Down both hierarchies, level by level; a finished one stays at its leaves.
    alive = np.ones((1, 1), bool)
    for step in range(max(len(levels), len(tile.levels))):
        a, b = levels[min(step, len(levels) - 1)], tile.levels[min(step, len(tile.levels) - 1)]
        alive = alive.repeat(len(a) // alive.shape[0], 0).repeat(len(b) // alive.shape[1], 1)
        weakest = tile.weakest(best.kth)[min(step, len(tile.levels) - 1)]
        live = np.flatnonzero(alive.any(1))
        bound = np.zeros(alive.shape, tile.kind)
        bound[live] = a[live] @ b.T
        alive &= bound >= weakest
        if not alive.any():
            break
    if count is not None:
        count[0] += alive.size
    for leaf in np.argsort(-bound.max(1), kind="stable"):
        go = np.flatnonzero(alive[leaf] & (bound[leaf] >= tile.weakest(best.kth)[-1]))
        if not len(go):
            continue
        if count is not None:
            count[1] += len(go)
        x = (go[:, None] * ITEM_LEAF + np.arange(ITEM_LEAF)).ravel()
        x = x[x < len(tile.items)]
        s, e = start[min(len(has), leaf * DOC_LEAF)], start[min(len(has), (leaf + 1) * DOC_LEAF)]
        cols = np.unique(local[s:e])
        dense = np.zeros((min(len(has), (leaf + 1) * DOC_LEAF) - leaf * DOC_LEAF, len(cols)), tile.kind)
        dense[row[s:e] - leaf * DOC_LEAF, np.searchsorted(cols, local[s:e])] = impact[s:e]
        score = (dense @ tile.weights[np.ix_(x, cols)].T).astype(np.int64)
        good = score >= best.kth[tile.items[x]]
        for y in np.flatnonzero(good.any(0)):
            d = np.flatnonzero(good[:, y])
            best.add(int(tile.items[x[y]]), score[d, y], ids[leaf * DOC_LEAF + d], null[leaf * DOC_LEAF + d])


def _candidates(vectors: DataFrame, payload, k: int) -> DataFrame:
    """Each task's best ``(item, id, score)``; ``payload`` is a broadcast
    ``(N, L, item vectors, size of the vocabulary, lower bounds)``."""
    def run(batches):
        n_docs, n_terms, items, size, floor = payload.value
        tiles = make_tiles(items, size)
        best = Best(len(items), k, floor)
        for batch in batches:
            id_, null = pc.fill_null(batch.column("id"), 0).to_numpy(), batch.column("id").is_null().to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy()
            lists = batch.column("term"), batch.column("tf")
            first = lists[0].offsets.to_numpy().astype(np.int64)
            term, tf = (x.values.to_numpy()[first[0]:first[-1]] for x in lists)
            first, tf = first - first[0], tf.astype(np.int64)
            m = 100 - SLOPE + SLOPE * n * n_docs // n_terms
            impact = UNIT * tf // (1000 * tf + 8 * np.repeat(m, np.diff(first)))
            for tile in tiles:
                step = DOC_LEAF * max(1, min(MOST_LEAVES, _power(CELLS // len(tile.terms) // 2 + 1)))
                for a in range(0, len(n), step):
                    b = min(len(n), a + step)
                    s, e = first[a], first[b]
                    search_batch(tile, first[a:b + 1] - s, term[s:e], impact[s:e], id_[a:b], null[a:b], best)
        found = [(i, r) for i, r in enumerate(best.rows) if r is not None]
        if found:
            ids = np.concatenate([r[1] for _, r in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([i for i, _ in found], [len(r[0]) for _, r in found]), pa.int32()),
                 pa.array(ids, mask=np.concatenate([r[2] for _, r in found])),
                 pa.array(np.concatenate([r[0] for _, r in found]))], ["item", "id", "score"])
    return vectors.where(~F.col("stats")).select("id", "n", "term", "tf").mapInArrow(run, "item int, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: pa.ChunkedArray, k: int) -> DataFrame:
    """``(item, id, score, rank)`` for items numbered by their place in ``texts``."""
    spark = docs.sparkSession
    counts: list[dict] = [{} for _ in range(len(texts))]
    at: dict[bytes, int] = {}
    for seg in _terms.segments(texts.combine_chunks(), _terms.LETTERS_DIGITS):
        names = [at.setdefault(t, len(at)) for t in seg.terms.to_pylist()]
        for r, c in zip(seg.row.tolist(), seg.code.tolist()):
            counts[r][names[c]] = counts[r].get(names[c], 0) + 1
    vectors = _vectors(docs, pa.array(list(at), pa.binary()))
    n_docs, n_terms, weight = _weights(vectors, len(at))
    items = []
    for c in counts:
        term = np.fromiter(c, np.int64, len(c))
        items.append((term, np.fromiter(c.values(), np.int64, len(c)) * weight[term]))

    def run(part: DataFrame, floor: np.ndarray) -> DataFrame:
        payload = spark.sparkContext.broadcast((n_docs, max(1, n_terms), items, len(at), floor))
        return materialize(_ranked(_candidates(part, payload, k), k), "tree-best")
    floor = np.zeros(len(items), np.int64)
    seeds = run(vectors.where(F.col("stats") | (F.pmod(F.xxhash64("id"), F.lit(SEED)) == 0)), floor)
    for r in seeds.where(F.col("rank") == k).select("item", "score").collect():  # a row per item
        floor[r["item"]] = r["score"]
    return run(vectors, floor)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(<item_col>, rank, <id_col>, score)``: each item's ``k`` best documents."""
    queries = row_index(items.select(items[item_col].alias("item_id"), items[item_text_col].alias("text")), ["item_id"], "i")
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    runs = queries.groupBy((F.floor(F.col("i") / 1024)).alias("g")).agg(F.sum(size).alias("b")).orderBy("g").collect()
    blocks: list[list] = []  # [first 1,024 items, last ones, bytes]
    for r in runs:
        if blocks and blocks[-1][2] + r["b"] <= ITEM_BYTES:
            blocks[-1][1:] = [r["g"], blocks[-1][2] + r["b"]]
        else:
            blocks.append([r["g"], r["g"], r["b"]])
    out = None
    for lo, hi, _ in blocks:
        texts = queries.where(F.col("i").between(lo * 1024, hi * 1024 + 1023)).orderBy("i").select("text").toArrow().column("text")
        found = _search_block(docs, texts, k).withColumn("i", F.col("item") + F.lit(lo * 1024).cast("long"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.select("i", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out.join(queries.select("i", "item_id"), "i").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The 10 best of all ``documents`` for each ``benchmark`` item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) AS term
           FROM (SELECT row_number() OVER () AS r, * FROM documents)),
f AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY r, term),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM f GROUP BY r),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * s.docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM f, s GROUP BY term, s.docs),
q AS (SELECT i, item_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) AS term
      FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
c AS (SELECT i, any_value(item_id) AS item_id, term, count(*) AS times FROM q GROUP BY i, term),
x AS (SELECT c.i, any_value(c.item_id) AS item_id, f.r, any_value(f.doc_id) AS doc_id,
             sum(c.times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (100 - 75 + ((75 * n.n * s.docs) // s.terms)))))::BIGINT AS score
      FROM c JOIN w ON w.term = c.term JOIN f ON f.term = c.term JOIN n ON n.r = f.r, s GROUP BY c.i, f.r),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""

QUERIES = {"op13_ranked_search": (op13_ranked_search, ORACLE)}
