"""Operator 12: source divergence audit with late string materialization.

How differently do a language's sources use its words? Terms are runs of letters
(A-Z folded). A language keeps the terms that at least ``min_docs`` of its
documents hold; every group (language, source) and every language gives each
kept term a smoothed share ``p`` in billionths. Part ``pair`` compares each
source with each other source of its language (sum of ``|p - q|`` over the kept
terms), part ``term`` lists the terms that a source uses more than its language.

1. One scan turns texts into 64-bit term digests; occurrences and documents are
   summed per (language, source, digest) inside the task, then by Spark. Only
   digests cross the network, never words.
2. A digest's documents are at least those of each of its terms, so the digests
   with ``min_docs`` documents cover all kept terms. Only for these a second
   scan takes the smallest and the largest string per digest. A bit table of at
   most ``FILTER_BITS`` bits, sent to the tasks, leaves out other digests before
   the exchange; what passes it by chance is dropped by an exact join.
3. Where smallest and largest string differ, terms collided: such digests are
   split, that is counted again by (digest, string) and given a ``sub`` number.
4. All arithmetic runs on (digest, sub). The strings are joined back only for
   the rows of part ``term`` that can be among the first ``top`` (ties with the
   last one included, since text decides them).

Part ``pair`` is a sum over terms of a sources-by-sources matrix. A task gets,
term by term, the shares of two tiles of at most ``TILE`` sources and keeps one
``TILE x TILE`` matrix; terms that neither source has add the same to all and
are added at the end. So memory is bounded for any number of sources and terms.

Defined results: NULL text, language and source are read as ''; equal rows are
separate documents; a text without terms counts for its group's existence only;
a language without kept terms has pair values 0 and no ``term`` rows; a language
with one source has no pairs; an empty table gives no rows; ties are ranked by
the item's UTF-8 bytes; columns other than the three named ones are not read. A
very long text is counted piece by piece (its distinct terms stay in memory).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import _terms
from ._text import span_hashes

MIN_DOCS = 30
TOP = 50
#: Smoothing count and the unit of shares.
SMOOTH = 5
UNIT = 1_000_000_000
#: Sources in one tile of the pair matrix.
TILE = 256
#: Most bits of the table that marks kept digests (16 MB).
FILTER_BITS = 1 << 27


def digests(terms: pa.Array, bits: int = 64) -> np.ndarray:
    """Signed 64-bit digests of a binary array (``bits``: only so many of them,
    to try collisions)."""
    off = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset:terms.offset + len(terms) + 1].astype(np.int64)
    buf = terms.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    h = span_hashes(data, off[:-1], off[1:])
    return (h >> np.uint64(64 - bits)).view(np.int64)


def _sums(group: np.ndarray, row: np.ndarray, code: np.ndarray, n_codes: int):
    """(group, code, occurrences, rows) of each (group, code)."""
    n_rows = int(row.max()) + 1 if len(row) else 1
    key = (group * n_codes + code) * n_rows + row
    key.sort()
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    pair = key // n_rows
    at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.r_[at, len(key)])
    d = np.add.reduceat(new.astype(np.int64), at) if len(at) else n
    return pair[at] // n_codes, pair[at] % n_codes, n, d


def _counter(pick):
    """A ``mapInArrow`` function: counts of the terms that ``pick(terms)``
    chooses (a mask or None) and what to key them by."""
    def run(batches):
        for batch in batches:
            lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            names = list(dict.fromkeys(zip(lang, source)))
            at = {g: i for i, g in enumerate(names)}
            gid = np.fromiter((at[g] for g in zip(lang, source)), np.int64, len(lang))
            langs, sources = pa.array([g[0] for g in names], pa.string()), pa.array([g[1] for g in names], pa.string())
            open_row: Counter = Counter()

            def out(terms, g, c, n, d):
                mask, digest = pick(terms)
                if mask is not None:
                    ok = mask[c]
                    g, c, n, d = g[ok], c[ok], n[ok], d[ok]
                return pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(g)), sources.take(pa.array(g)), pa.array(digest[c]),
                     terms.take(pa.array(c)).cast(pa.string()), pa.array(n), pa.array(d)],
                    ["lang", "source", "digest", "term", "n", "d"])

            for seg in _terms.segments(batch.column("text"), _terms.LETTERS):
                if seg.whole:
                    if len(seg.code):
                        yield out(seg.terms, *_sums(gid[seg.row], seg.row, seg.code.astype(np.int64), len(seg.terms)))
                    continue
                for t, k in zip(seg.terms.to_pylist(), np.bincount(seg.code, minlength=len(seg.terms)).tolist()):
                    open_row[t] += k
                if seg.last and open_row:
                    c = np.arange(len(open_row))
                    yield out(pa.array(list(open_row), pa.binary()), np.full(len(c), gid[seg.rows[0]]), c,
                              np.fromiter(open_row.values(), np.int64, len(c)), np.ones(len(c), np.int64))
                    open_row.clear()
    return run


_COUNTED = "lang string, source string, digest long, term string, n long, d long"


def _count_digests(docs: DataFrame, bits: int) -> DataFrame:
    counted = _counter(lambda terms: (None, digests(terms, bits)))

    def run(batches):
        for b in counted(batches):
            yield b.select(["lang", "source", "digest", "n", "d"])
    rows = docs.mapInArrow(run, "lang string, source string, digest long, n long, d long")
    return rows.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _bit_table(spark, digest: DataFrame, n: int):
    """Broadcast bit table over digests: ``2**k`` bits, 16 for each of the ``n``
    digests as far as ``FILTER_BITS`` allows."""
    k = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length())).bit_length() - 1
    slot = F.shiftrightunsigned("digest", 64 - k)  # the digest is evenly spread
    words = (digest.select(slot.alias("slot"))
             .groupBy(F.shiftright("slot", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
             .toArrow())  # at most FILTER_BITS / 64 words
    table = np.zeros(max(1, (1 << k) >> 6), np.int64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy()
    return spark.sparkContext.broadcast((k, table))


def _marked(digest: np.ndarray, k: int, table: np.ndarray) -> np.ndarray:
    slot = digest.view(np.uint64) >> np.uint64(64 - k)
    return (table.view(np.uint64)[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _named(docs: DataFrame, kept: DataFrame, bits: int) -> DataFrame:
    """``(digest, low, high)``: smallest and largest string of kept digests."""
    spark = docs.sparkSession
    unique = materialize(kept.select("digest").distinct(), "late-digests")
    marks = _bit_table(spark, unique, unique.count())

    def run(batches):
        k, table = marks.value
        for batch in batches:
            for seg in _terms.segments(batch.column("text"), _terms.LETTERS):
                if len(seg.terms):
                    h = digests(seg.terms, bits)
                    ok = pa.array(_marked(h, k, table))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h).filter(ok), seg.terms.filter(ok).cast(pa.string())], ["digest", "term"])
    found = docs.select("text").mapInArrow(run, "digest long, term string")
    ends = found.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    return materialize(ends.join(unique, "digest"), "late-names")


def _split(docs: DataFrame, names: DataFrame, bits: int) -> tuple[DataFrame, DataFrame] | None:
    """Counts and names of the terms of collided digests, numbered by ``sub``;
    None if none collided."""
    hit = names.where(F.col("low") != F.col("high")).select("digest")
    n = hit.count()
    if not n:
        return None
    marks = _bit_table(docs.sparkSession, hit, n)

    def pick(terms):
        h = digests(terms, bits)
        return _marked(h, *marks.value), h
    rows = docs.mapInArrow(_counter(pick), _COUNTED).join(hit, "digest", "left_semi")
    counts = materialize(rows.groupBy("lang", "source", "digest", "term")
                         .agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "late-split")
    # A digest has a handful of strings, however often they occur.
    sub = F.row_number().over(Window.partitionBy("digest").orderBy("term"))
    split = materialize(counts.select("digest", "term").distinct().withColumn("sub", sub), "late-sub")
    return counts.join(split, ["digest", "term"]).select("lang", "source", "digest", "sub", "n", "d"), split


def _shares(df: DataFrame, name: str, n: str, total: str) -> DataFrame:
    """Add ``name = 1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * v))``, exactly."""
    top = f"CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + {SMOOTH} AS DECIMAL(20,0))"
    return df.withColumn(name, F.expr(f"1 + (({top}) div CAST({total} + {SMOOTH} * v AS DECIMAL(20,0)))"))


def _pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, i, j, total, seen)`` for source numbers ``i < j`` of a language:
    the sum of ``|p - q|`` over the ``seen`` terms that a source of their two
    tiles has. ``counts``: (lang, i, sources, digest, sub, p); ``groups``: (lang,
    i, sources, p0), ``p0`` being the share of a term that the source hasn't."""
    n_salts = min(4096, 1 + counts.count() // 50_000)
    tile, tiles = F.floor(F.col("i") / TILE).cast("int"), F.ceil(F.col("sources") / TILE).cast("int")

    def dealt(df, *cols):  # a row goes to every pair of tiles of which its own is one
        df = df.select("*", tile.alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
        return df.select("lang", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), *cols)
    terms = dealt(counts, F.pmod(F.xxhash64("digest"), F.lit(n_salts)).cast("int").alias("salt"),
                  F.lit(1).alias("kind"), "digest", "sub", "i", "p")
    # In front of each part's terms: the shares of absent terms.
    head = dealt(groups, F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))).alias("salt"), F.lit(0).alias("kind"),
                 F.lit(0).cast("long").alias("digest"), F.lit(0).alias("sub"), "i", F.col("p0").alias("p"))
    part = ["lang", "a", "b", "salt"]
    rows = terms.unionByName(head).repartition(*part).sortWithinPartitions(*part, "kind", "digest", "sub")

    def run(batches):
        now, base, total, seen, held = None, None, None, 0, None

        def add(k, p, i, n_terms):
            """``n_terms`` whole terms; ``k`` numbers them from 0."""
            _, a, b = now[:3]
            sides = []
            for side, t in enumerate((a, b)):
                dense = np.broadcast_to(base[side], (n_terms, len(base[side]))).copy()
                mine = i // TILE == t
                dense[k[mine], i[mine] - t * TILE] = p[mine]
                sides.append(dense)
            for x in range(total.shape[0]):
                total[x] += np.abs(sides[0][:, x, None] - sides[1]).sum(0)

        def emit():
            lang, a, b = now[:3]
            x, y = (v.ravel() for v in np.indices(total.shape))
            i, j = x + a * TILE, y + b * TILE
            ok = i < j
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * int(ok.sum()), pa.string()), pa.array(i[ok], pa.int32()), pa.array(j[ok], pa.int32()),
                 pa.array(total.ravel()[ok]), pa.array(np.full(int(ok.sum()), seen))], ["lang", "i", "j", "total", "seen"])

        def flush(upto):
            """Add the held terms but for the last one, which may go on."""
            nonlocal held, seen
            digest, sub, i, p = held
            new = np.r_[True, (digest[1:] != digest[:-1]) | (sub[1:] != sub[:-1])] if len(digest) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            n = len(at) if upto else max(0, len(at) - 1)
            end = len(digest) if upto else (int(at[-1]) if len(at) else 0)
            k = np.cumsum(new) - 1
            step = max(1, (1 << 18) // max(1, *total.shape))
            for t in range(0, n, step):
                s, e = int(at[t]), int(at[t + step]) if t + step < n else end
                add(k[s:e] - t, p[s:e], i[s:e], min(step, n - t))
            seen += n
            held = tuple(v[end:] for v in held)

        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "salt", "kind", "digest", "sub", "i", "p")}
            langs = batch.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, np.any([v[1:] != v[:-1] for v in (code, cols["a"], cols["b"], cols["salt"])], axis=0)]) \
                if batch.num_rows else []
            for s, e in zip(edge, np.r_[edge[1:], batch.num_rows]):
                key = (langs.dictionary[int(code[s])].as_py(), *(int(cols[c][s]) for c in ("a", "b", "salt")))
                if key != now:
                    if now is not None and total is not None:
                        flush(True)
                        if seen:
                            yield emit()
                    now, base, total, seen = key, ([], []), None, 0
                    held = tuple(np.zeros(0, np.int64) for _ in range(4))
                cut = s + int(np.searchsorted(cols["kind"][s:e], 1))
                for side, t in enumerate(now[1:3] if cut > s else ()):  # sources come in no fixed order
                    mine = cols["i"][s:cut] // TILE == t
                    base[side].extend(zip(cols["i"][s:cut][mine].tolist(), cols["p"][s:cut][mine].tolist()))
                if cut < e:
                    if total is None:
                        base = tuple(np.array([p for _, p in sorted(set(side))], np.int64) for side in base)
                        total = np.zeros((len(base[0]), len(base[1])), np.int64)
                    held = tuple(np.r_[h, cols[c][cut:e]] for h, c in zip(held, ("digest", "sub", "i", "p")))
                    flush(False)
        if now is not None and total is not None:
            flush(True)
            if seen:
                yield emit()
    sums = rows.mapInArrow(run, "lang string, i int, j int, total long, seen long")
    return sums.groupBy("lang", "i", "j").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """``(lang, source, part, item, value, rank)``; see the module text."""
    empty = F.lit("")
    groups = docs.select(F.coalesce(docs[lang_col].cast("string"), empty).alias("lang"),
                         F.coalesce(docs[source_col].cast("string"), empty).alias("source")).distinct()
    docs = docs.select(F.coalesce(docs[lang_col].cast("string"), empty).alias("lang"),
                       F.coalesce(docs[source_col].cast("string"), empty).alias("source"), docs[text_col].alias("text"))
    raw = materialize(_count_digests(docs, bits), "late-counts")
    enough = F.sum("d") >= min_docs
    kept = materialize(raw.groupBy("lang", "digest").agg(enough.alias("ok")).where("ok").select("lang", "digest"), "late-kept")
    names = _named(docs, kept, bits).withColumn("sub", F.lit(0))
    found = raw.join(kept, ["lang", "digest"]).select("lang", "source", "digest", F.lit(0).alias("sub"), "n")
    terms = names.select("digest", "sub", F.col("low").alias("term"))
    if (split := _split(docs, names, bits)) is not None:
        counts, subs = split
        apart = subs.select("digest").distinct()
        kept = counts.groupBy("lang", "digest", "sub").agg(enough.alias("ok")).where("ok").drop("ok")
        found = (found.join(apart, "digest", "left_anti").select("lang", "source", "digest", "sub", "n")
                 .unionByName(counts.join(kept, ["lang", "digest", "sub"]).select("lang", "source", "digest", "sub", "n")))
        terms = terms.join(apart, "digest", "left_anti").unionByName(subs.select("digest", "sub", "term"))
    found = materialize(found, "late-found")

    # Shares: a row per group (few), per language, per kept term and group.
    by_lang = found.groupBy("lang", "digest", "sub").agg(F.sum("n").alias("m"))
    langs = by_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("m").alias("all_n"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = (groups.withColumn("i", number)
              .join(groups.groupBy("lang").agg(F.count(F.lit(1)).cast("int").alias("sources")), "lang")
              .join(langs, "lang", "left").join(found.groupBy("lang", "source").agg(F.sum("n").alias("own_n")), ["lang", "source"], "left")
              .fillna(0, ["v", "all_n", "own_n"]).withColumn("none", F.lit(0).cast("long")))
    groups = materialize(_shares(groups.where("v > 0"), "p0", "none", "own_n")
                         .unionByName(groups.where("v = 0").withColumn("p0", F.lit(0).cast("long"))), "late-groups")
    shares = _shares(found.join(groups, ["lang", "source"]), "p", "n", "own_n")

    sums = _pair_sums(shares.select("lang", "i", "sources", "digest", "sub", "p"), groups.select("lang", "i", "sources", "p0"))
    left = groups.select("lang", "source", F.col("i").alias("x"), "v", "p0")
    right = groups.select("lang", F.col("source").alias("item"), F.col("i").alias("y"), F.col("p0").alias("q0"))
    pairs = (left.join(right, "lang").where("x != y").withColumn("i", F.least("x", "y")).withColumn("j", F.greatest("x", "y"))
             .join(sums, ["lang", "i", "j"], "left").fillna(0, ["total", "seen"]))
    value = F.col("total") + (F.col("v") - F.col("seen")) * F.abs(F.col("p0") - F.col("q0"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
             .withColumn("rank", F.row_number().over(by_value)))

    more = _shares(shares.select("lang", "source", "digest", "sub", "p", "v", "all_n").join(by_lang, ["lang", "digest", "sub"]), "q", "m", "all_n")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    more = (more.where("p > q").select("lang", "source", "digest", "sub", (F.col("p") - F.col("q")).alias("value"))
            .withColumn("near", F.rank().over(best)).where(F.col("near") <= top))
    more = (more.join(terms, ["digest", "sub"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
            .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top))
    return pairs.unionByName(more)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: how sources of a language differ in their terms."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
                  translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS m FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(m) AS total FROM k GROUP BY 1),
g AS (SELECT d.lang, d.source, COALESCE(max(s.n), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) d
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) s ON s.lang = d.lang AND s.source = d.source GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n,
             1 + ({UNIT}::HUGEINT * (COALESCE(c.n, 0) + {SMOOTH})) // (g.total + {SMOOTH} * l.v)::HUGEINT AS p,
             1 + ({UNIT}::HUGEINT * (k.m + {SMOOTH})) // (l.total + {SMOOTH} * l.v)::HUGEINT AS q
      FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, COALESCE(sum(abs(x.p - y.p)), 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
out AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
        UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM out)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""

QUERIES = {"op12_source_divergence": (op12_source_divergence, ORACLE)}
