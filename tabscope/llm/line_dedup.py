"""Operator 2: line dedup by a suffix array over line ids.

Every text is its sequence of lines that hold a word; all texts together are
one string over line ids, in the order of ids. A run of lines with at least
``MIN_WORDS`` words that occurred before (in an earlier text or earlier in the
same one) is a later copy and is deleted; its first occurrence stays.

1. Line ids: ranks of the repeated lines (128-bit hashes). A line that occurs
   once ends every run, so only repeated lines go on.
2. Prefix doubling: ``rank_{k+1}(i)`` is the rank of the pair ``(rank_k(i),
   rank_k(i + 2**k))`` among the pairs that occur twice or more. That is the
   suffix array sorted to depth ``2**(k+1)``, without its unique suffixes. Ranks
   are distributed row numbers over the distinct pairs.
   The doubling ends when no pair occurs twice, so at the longest repeated run.
3. LCP intervals: the suffixes that agree on their first ``n`` lines are one
   interval with longest common prefix ``>= n``. Looked up are, at every depth,
   the runs of ``2**k`` lines with enough words and, for each line, the shortest
   run that begins (and the shortest that ends) there with ``MIN_WORDS`` words:
   its ``n`` lines are named by two overlapping ranks of depth
   ``2**floor(log2 n)``. All occurrences but the interval's first are deleted.

Every maximal repeated run of enough words is a union of such runs, and each of
them lies in one, so the deleted lines are exactly those of the later copies of
all maximal runs.

Defined results: NULL and empty texts have no lines; lines without a word are
kept and interrupt nothing; rows that repeat an id and its text are one
document; NULL ids come last; an empty table gives no rows. A text of which
every line with a word is deleted is dropped from the cleaned documents.

Scale: hot lines are aggregated before the exchange and joined back by a
sort-merge join, which the engine splits when skewed. No group is collected; the
list of deleted lines of one document is bounded by the document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import row_index
from ..session import configure, materialize
from ._text import Words, blocks, span_hashes, utf8

MIN_WORDS = 10
DOC = ["nul", "id0", "th"]
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def _shortest(count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line of one text: number of lines of the shortest run of ``least``
    words that begins here, and that ends here (0: none)."""
    upto = np.r_[0, np.cumsum(count)]
    n = len(count)
    stop = np.searchsorted(upto, upto[:-1] + least, "left")
    start = np.searchsorted(upto, upto[1:] - least, "right") - 1
    at = np.arange(n)
    return np.where(stop <= n, stop - at, 0), np.where(start >= 0, at - start + 1, 0)


LINES = ("nul boolean, id0 bigint, th bigint, e int, h1 bigint, h2 bigint, forward int, backward int")


def _lines(least: int):
    def run(batches):
        for batch in blocks(batches):
            data, off = utf8(batch.column("text"))
            words = Words(data, off)
            cuts = np.flatnonzero(data == 10)
            start = np.sort(np.r_[off[:-1], cuts + 1])
            stop = np.sort(np.r_[off[1:], cuts])
            per = np.searchsorted(cuts, off[1:]) - np.searchsorted(cuts, off[:-1]) + 1
            row = np.repeat(np.arange(len(off) - 1), per)
            count = np.searchsorted(words.start, stop) - np.searchsorted(words.start, start)
            start, stop, row, count = (x[count > 0] for x in (start, stop, row, count))
            edge = np.searchsorted(row, np.arange(len(off)))
            forward, backward = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
            for a, b in zip(edge[:-1], edge[1:]):
                if b > a:
                    forward[a:b], backward[a:b] = _shortest(count[a:b], least)
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(own) for c in DOC],
                 pa.array((np.arange(len(row)) - edge[row] + 1).astype(np.int32)),
                 pa.array(span_hashes(data, start, stop).view(np.int64)),
                 pa.array(span_hashes(data, start, stop, seed=2).view(np.int64)),
                 pa.array(forward), pa.array(backward)],
                names=[f.split()[0] for f in LINES.split(", ")])
    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key, text = docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit(""))
    return docs.select(key.isNull().alias("nul"), F.coalesce(key, F.lit(0)).alias("id0"),
                       F.xxhash64(text).alias("th"), text.alias("text"))


def _ranks(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, r)``: ranks of the values of ``by`` that occur twice or more."""
    several = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return row_index(several, by, "r", stored=False)


def _intervals(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """``(lines, named)``: all lines with words, and every repeated run that is
    looked up: where it begins ``(nul, id0, th, e)``, its ``n`` lines and its
    name ``(n, a, b)``, which is the same for equal runs only."""
    configure(docs.sparkSession)
    lines = materialize(_keyed(docs, id_col, text_col).mapInArrow(_lines(min_words), LINES), "lines")
    at = [*DOC, "e"]
    rank = lines.join(_ranks(lines, ["h1", "h2"]), ["h1", "h2"]).drop("h1", "h2")
    rank = materialize(rank.dropDuplicates(at), "rank")
    whole = [*at, F.lit(1).alias("n"), F.col("r").alias("a"), F.col("r").alias("b")]
    named = rank.where("forward = 1").select(*whole)
    runs = rank.where("forward > 1").select(*at, F.col("forward").alias("n")).union(
        rank.where("backward > 1").select(*DOC, (F.col("e") - F.col("backward") + 1).alias("e"),
                                          F.col("backward").alias("n"))).distinct()
    runs = materialize(runs, "runs")
    rank, depth = rank.select(*at, "forward", "r"), 1
    while True:
        ahead = rank.select(*DOC, (F.col("e") - depth).alias("e"), F.col("r").alias("r2"))
        pairs = materialize(rank.withColumnRenamed("r", "r1").join(ahead, at), "pairs")
        rank = pairs.join(_ranks(pairs, ["r1", "r2"]), ["r1", "r2"]).select(*at, "forward", "r")
        rank = materialize(rank, "rank")
        depth *= 2
        if rank.isEmpty():  # no run of this many lines occurs twice
            break
        whole[-3] = F.lit(depth).alias("n")
        named = named.union(rank.where(F.col("forward").between(1, depth)).select(*whole))
        if depth < min_words:
            # Shortest runs of more than depth, to 2 * depth - 1 lines: first and last ``depth`` lines.
            mine = runs.where((F.col("n") > depth) & (F.col("n") < 2 * depth))
            first = rank.select(*at, F.col("r").alias("a"))
            tail = rank.select(*DOC, F.col("e").alias("t"), F.col("r").alias("b"))
            named = named.union(
                mine.join(first, at).withColumn("t", F.col("e") + F.col("n") - depth)
                    .join(tail, [*DOC, "t"]).select(*at, "n", "a", "b"))
    return lines, materialize(named, "named")


def _places(named: DataFrame) -> DataFrame:
    """``(n, a, b, first, copies)``: the runs that occur twice or more."""
    first = F.min(F.struct(*DOC, "e")).alias("first")
    return named.groupBy("n", "a", "b").agg(first, F.count(F.lit(1)).alias("copies")).where("copies > 1")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """``(n, copies, first)``: the LCP intervals of :func:`later_copies`: lines of the
    run, its occurrences, and the place ``(nul, id0, th, e)`` of the first one."""
    return _places(_intervals(docs, id_col, text_col, min_words)[1]).select("n", "copies", "first")


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(lines, deleted)``: all lines with words ``(nul, id0, th, e, …)`` and
    the deleted ones ``(nul, id0, th, e)``; ``e`` counts a text's lines that
    hold a word, from 1."""
    lines, named = _intervals(docs, id_col, text_col, min_words)
    at = [*DOC, "e"]
    later = named.join(_places(named), ["n", "a", "b"]).where(F.struct(*at) > F.col("first"))
    # The runs of one document overlap: each adds the lines behind those before it.
    far = later.groupBy(*at).agg(F.max(F.col("e") + F.col("n")).alias("stop"))
    before = Window.partitionBy(*DOC).orderBy("e").rowsBetween(Window.unboundedPreceding, -1)
    gone = (far.withColumn("start", F.greatest("e", F.max("stop").over(before))).where("start < stop")
               .select(*DOC, F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("e")))
    return lines, materialize(gone, "deleted")


def _per_document(gone: DataFrame) -> DataFrame:
    return gone.groupBy(*DOC).agg(F.sort_array(F.collect_list("e")).alias("gone"))


def _rebuild(batches):
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            if gone is None:
                texts.append(text)
                continue
            drop, e, out = set(gone), 0, []
            for line in text.split("\n"):
                if _WORD.search(line):
                    e += 1
                    if e in drop:
                        continue
                out.append(line)
            texts.append("\n".join(out) if e > len(drop) else None)
        keep = pa.array([t is not None or g is None for t, g in
                         zip(texts, batch.column("gone").to_pylist())])
        yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string())],
                                         names=["__row", "__text"]).filter(keep)


def drop_later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines that are later copies (same columns; the text
    column holds the cleaned text). Texts with no line left are dropped."""
    _, gone = later_copies(docs, id_col, text_col, min_words)
    gone = _per_document(gone)
    key, text = docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit(""))
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[docs[c] for c in rest]).alias("__row"), docs[text_col].alias("text"),
                       key.isNull().alias("nul"), F.coalesce(key, F.lit(0)).alias("id0"),
                       F.xxhash64(text).alias("th"))
    joined = rows.join(gone, DOC, "left").select("__row", "text", "gone")
    row = joined.schema["__row"].dataType.simpleString()
    clean = joined.mapInArrow(_rebuild, f"__row {row}, __text string")
    out = [F.col("__text").alias(c) if c == text_col else F.col("__row").getField(c).alias(c)
           for c in docs.columns]
    return clean.select(*out)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: lines with words, deleted lines, and the deleted runs as
    ``first-last`` (counted over lines with words, from 1)."""
    lines, gone = later_copies(docs, id_col, text_col)
    count = lines.dropDuplicates([*DOC, "e"]).groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_lines"))
    e = F.col("gone")
    first = F.filter(e, lambda x, i: (i == 0) | (F.get(e, i - 1) != x - 1))
    last = F.filter(e, lambda x, i: (i == F.size(e) - 1) | (F.get(e, i + 1) != x + 1))
    runs = F.concat_ws(",", F.zip_with(first, last, lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))))
    per = (_per_document(gone).select(*DOC, F.size("gone").cast("long").alias("n_deleted"), runs.alias("deleted")))
    docs_only = _keyed(docs, id_col, text_col).drop("text")
    return (docs_only.join(count, DOC, "left").join(per, DOC, "left")
            .select(F.when(~F.col("nul"), F.col("id0")).alias(id_col),
                    F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
                    F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"),
                    F.coalesce("deleted", F.lit("")).alias("deleted")))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs over all ``documents``."""
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(string_split(COALESCE(text, ''), chr(10)),
         lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS e FROM w),
n AS (SELECT doc_id, e, len(regexp_extract_all(ls[e], '[^\\x20\\x09-\\x0D]+')) AS k FROM l),
c AS (SELECT *, sum(k) OVER (PARTITION BY doc_id ORDER BY e) AS upto FROM n),
f AS (SELECT a.doc_id, a.e AS s, min(b.e) AS t FROM c a JOIN c b ON a.doc_id = b.doc_id
        AND b.e >= a.e AND b.upto - a.upto + a.k >= 10 GROUP BY 1, 2
      UNION
      SELECT a.doc_id, max(b.e) AS s, a.e AS t FROM c a JOIN c b ON a.doc_id = b.doc_id
        AND b.e <= a.e AND a.upto - b.upto + b.k >= 10 GROUP BY a.doc_id, a.e),
x AS (SELECT doc_id, s, t, row_number() OVER (PARTITION BY ls[s:t] ORDER BY doc_id, s) AS nth
      FROM f JOIN w USING (doc_id)),
d AS (SELECT DISTINCT doc_id, unnest(range(s, t + 1)) AS e FROM x WHERE nth > 1),
i AS (SELECT doc_id, min(e) AS a, max(e) AS b FROM
        (SELECT doc_id, e, e - row_number() OVER (PARTITION BY doc_id ORDER BY e) AS g FROM d)
      GROUP BY doc_id, g),
r AS (SELECT doc_id, sum(b - a + 1)::BIGINT AS n_deleted, string_agg(a || '-' || b, ',' ORDER BY a) AS deleted
      FROM i GROUP BY doc_id)
SELECT doc_id, len(ls) AS n_lines, COALESCE(n_deleted, 0) AS n_deleted, COALESCE(deleted, '') AS deleted
FROM w LEFT JOIN r USING (doc_id)
"""

QUERIES = {"op2_line_dedup": (op2_line_dedup, ORACLE)}
