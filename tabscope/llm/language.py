"""Operator 11: language identification by prediction by partial matching (PPM).

Every language has a tree of byte contexts of length 0 to ``ORDER`` with the
counts of the byte that followed. Under frozen counts a byte's code length is
found by partial matching: in the longest known context, a byte seen there costs
``-log2(count / (total + kinds))``; another one costs the escape,
``-log2(kinds / (total + kinds))``, plus its code length in the context shortened
by its oldest byte; an unknown context costs nothing and is shortened; below the
empty context all 256 bytes cost 8 bits (method C, without exclusions). A text's
code length is the sum over its bytes plus the language's own,
``-log2(share of the training rows)``; the shortest one wins.

Bytes are read folded: A-Z as a-z, each run of ASCII bytes that are no letters as
one space; a text begins in a context of spaces. Code lengths are whole numbers
of 1/65,536 bit, so sums don't depend on how texts are cut.

Training: labelled rows (language not NULL) that ``trained_on`` lets through.
All of them count for the languages' shares. The trees are fitted on a bounded
sample: at most ``SAMPLE_ROWS`` rows over all languages, in equal parts and by
hash of the row, none above ``SAMPLE_BYTES`` bytes. Spark counts the byte runs
of the sample; the summed counts go to the driver, which turns them into one
table of code lengths (each known run of ``ORDER`` + 1 bytes, back-offs resolved)
for the tasks. Its size is bounded by the sample.

Defined results: NULL text and text without a letter are ``und`` with score 0, as
is every text if there is no training row; equal code lengths go to the language
that sorts first; the score is the winner's posterior, ``2**-length`` over the
sum for all languages; equal rows are separate rows; a NULL id counts as '' in
the split; the caller's columns travel in one struct. Texts are scored in
segments of ``SEGMENT`` bytes that hand on their last bytes, so memory does not
follow the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import configure, materialize
from ._text import blocks, utf8

ORDER = 3
SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 64 << 10
SEGMENT = 1 << 20
#: Code lengths are counted in 1/BIT bit.
BIT = 1 << 16
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


# ------------------------------------------------------- texts as byte runs

def _pieces(data: np.ndarray, off: np.ndarray, segment: int):
    """(begin, end, rows with bytes in it, where each begins in it) of each segment."""
    for a in range(0, len(data), segment):
        b = min(len(data), a + segment)
        rows = np.arange(np.searchsorted(off, a, "right") - 1, np.searchsorted(off, b, "left"), dtype=np.int32)
        edge = np.maximum(off[rows], a) - a
        some = np.diff(np.r_[edge, b - a]) > 0
        yield a, b, rows[some], edge[some]


def runs(column: pa.Array, segment: int = SEGMENT):
    """``(run, row)`` arrays by segment: for each folded byte of a text, it and
    the ``ORDER`` bytes before it as one 32-bit number, oldest byte first."""
    data, off = utf8(column)
    tail = np.zeros(0, np.uint8), np.zeros(0, np.int32)  # last bytes and their rows
    for a, b, rows, edge in _pieces(data, off, segment):
        byte = _FOLD[data[a:b]]
        row = np.repeat(rows, np.diff(np.r_[edge, b - a]))
        last = tail[0][-1:], tail[1][-1:]
        before = np.r_[last[0] if len(last[0]) else np.uint8(0x20), byte[:-1]]
        same = np.r_[last[1] if len(last[1]) else -1, row[:-1]] == row
        keep = (byte != 0x20) | (np.where(same, before, 0x20) != 0x20)  # one space of a run, none in front
        k = len(tail[0])
        # In front: the bytes handed on, and before the first segment bytes of no row.
        s = np.r_[np.zeros(ORDER - k, np.uint8), tail[0], byte[keep]]
        r = np.r_[np.full(ORDER - k, -1, np.int32), tail[1], row[keep]]
        run = s[ORDER:].astype(np.uint32)
        for back in range(1, ORDER + 1):
            own = r[ORDER - back:len(r) - back] == r[ORDER:]
            run |= np.where(own, s[ORDER - back:len(s) - back], np.uint8(0x20)).astype(np.uint32) << np.uint32(8 * back)
        yield run, r[ORDER:]
        # A dropped space is no byte of the text, so the tail holds kept bytes only.
        tail = s[-ORDER:], r[-ORDER:]


def has_letter(column: pa.Array) -> np.ndarray:
    """Which texts have a letter (of any script)."""
    data, off = utf8(column)
    ascii_, wide = np.zeros(len(off) - 1, bool), np.zeros(len(off) - 1, bool)
    for a, b, rows, edge in _pieces(data, off, SEGMENT):
        byte = _FOLD[data[a:b]]
        ascii_[rows] |= np.logical_or.reduceat((byte != 0x20) & (byte < 128), edge)
        wide[rows] |= np.logical_or.reduceat(byte >= 128, edge)
    for i in np.flatnonzero(~ascii_ & wide):
        ascii_[i] = regex.search(r"\p{L}", column[int(i)].as_py()) is not None
    return ascii_


# ---------------------------------------------------------------- the model

class Model:
    """Code lengths of runs: ``lengths[l]`` of the known runs of full length, by
    slot of a hash table, and the parts to work out any other run."""

    def __init__(self, languages: list[str], prior: np.ndarray, counts: list[dict]):
        """``counts[l][o]``: (run of ``o`` + 1 bytes, count) arrays of language
        ``l``, ``o`` from 0 to ``ORDER``."""
        self.languages, self.prior = languages, prior
        n = len(languages)
        self.known: list[np.ndarray] = []  # by o: sorted runs of o + 1 bytes known to some language
        self.full: list[np.ndarray] = []   # by o: (language, run) code lengths
        self.context: list[np.ndarray] = []  # by o: sorted contexts of o bytes
        self.escape: list[np.ndarray] = []   # by o: (language, context) escape lengths, 0 if unknown
        for o in range(ORDER + 1):
            known = np.unique(np.concatenate([counts[x][o][0] for x in range(n)]))
            context = np.unique(known >> np.uint32(8))
            escape = np.zeros((n, len(context)), np.int32)
            full = np.zeros((n, len(known)), np.int32)
            for x in range(n):
                run, c = counts[x][o]
                own = np.searchsorted(context, run >> np.uint32(8))
                total = np.bincount(own, c, len(context))
                kinds = np.bincount(own, minlength=len(context))
                some = kinds > 0
                escape[x, some] = np.rint(-np.log2(kinds[some] / (total + kinds)[some]) * BIT)
                direct = np.rint(-np.log2(c / (total + kinds)[own]) * BIT).astype(np.int32)
                at = np.searchsorted(known, run)
                missing = np.ones(len(known), bool)
                missing[at] = False
                full[x, at] = direct
                if missing.any():
                    miss = known[missing]
                    shorter = self._lengths(o - 1, miss & np.uint32((1 << 8 * o) - 1))[x]
                    full[x, missing] = escape[x, np.searchsorted(context, miss >> np.uint32(8))] + shorter
            self.known.append(known)
            self.full.append(full)
            self.context.append(context)
            self.escape.append(escape)
        # Open addressing, at most a quarter full: run -> slot -> place in ``known[ORDER]``.
        k = max(8, (4 * len(self.known[ORDER])).bit_length())
        self.shift = np.uint32(32 - k)
        self.slots = np.full(1 << k, -1, np.int32)
        todo, slot = np.arange(len(self.known[ORDER])), self._slot(self.known[ORDER])
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # of several, the last one stays
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & ((1 << k) - 1)

    def _slot(self, run: np.ndarray) -> np.ndarray:
        return ((run * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def _lengths(self, o: int, run: np.ndarray) -> np.ndarray:
        """(language, run) code lengths of runs of ``o`` + 1 bytes."""
        n = len(self.languages)
        if o < 0:
            return np.full((n, len(run)), 8 * BIT, np.int32)
        at = np.minimum(np.searchsorted(self.known[o], run), len(self.known[o]) - 1)
        hit = self.known[o][at] == run
        out = np.empty((n, len(run)), np.int32)
        out[:, hit] = self.full[o][:, at[hit]]
        miss = run[~hit]
        if len(miss):
            context = miss >> np.uint32(8)
            c = np.minimum(np.searchsorted(self.context[o], context), len(self.context[o]) - 1)
            escape = np.where(self.context[o][c] == context, self.escape[o][:, c], 0)
            out[:, ~hit] = escape + self._lengths(o - 1, miss & np.uint32((1 << 8 * o) - 1))
        return out

    def lengths(self, column: pa.Array, segment: int = SEGMENT) -> np.ndarray:
        """(row, language) code lengths of texts in 1/BIT bit."""
        out = np.tile(self.prior, (len(column), 1))
        for run, row in runs(column, segment):
            if not len(run):
                continue
            at = np.full(len(run), -1, np.int64)
            todo, slot = np.arange(len(run)), self._slot(run)
            while len(todo):
                place = self.slots[slot]
                hit = self.known[ORDER][place] == run[todo]  # an empty slot (-1) is sorted out below
                hit &= place >= 0
                at[todo[hit]] = place[hit]
                on = ~hit & (place >= 0)
                todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)
            odd = np.flatnonzero(at < 0)
            unique, back = np.unique(run[odd], return_inverse=True)
            rare = self._lengths(ORDER, unique)
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            for x in range(len(self.languages)):
                bits = self.full[ORDER][x][at]
                bits[odd] = rare[x][back]
                out[row[begin], x] += np.add.reduceat(bits, begin, dtype=np.int64)
        return out


def _sampled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """At most ``SAMPLE_ROWS`` of ``(lang, text, h)`` in equal parts by language:
    those with the smallest hashes."""
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    per = materialize(counted, "languages")
    each = max(1, SAMPLE_ROWS // max(1, per.count()))
    # Four times the share by hash first, so that few texts are sorted.
    share = F.least(F.lit(1.0), F.lit(4.0 * each) / F.col("n"))
    near = F.shiftrightunsigned("h", 1).cast("double") / F.lit(2.0 ** 63) < share
    some = rows.where(F.octet_length("text") <= SAMPLE_BYTES).join(per, "lang").where(near)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return some.withColumn("nth", first).where(F.col("nth") <= each).select("lang", "text"), per


def train(docs: DataFrame, trained_on: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit the model on the rows of ``docs`` with a language for which
    ``trained_on`` holds; None if there are none."""
    configure(docs.sparkSession)
    rows = docs if trained_on is None else docs.where(trained_on)
    rows = rows.where(rows[lang_col].isNotNull()).select(
        rows[lang_col].cast("string").alias("lang"), F.coalesce(rows[text_col], F.lit("")).alias("text"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"))
    sample, per = _sampled(rows)

    def count(batches):
        for batch in blocks(batches):
            lang = batch.column("lang").dictionary_encode()
            code = lang.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
            for run, row in runs(batch.column("text")):
                for o in range(ORDER + 1):
                    own = (run & np.uint32((1 << 8 * (o + 1)) - 1)).astype(np.uint64) | code[row] << np.uint64(32)
                    key, c = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [lang.dictionary.take(pa.array((key >> np.uint64(32)).astype(np.int64))),
                         pa.array(np.full(len(key), o, np.int32)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                         pa.array(c)], ["lang", "o", "run", "c"])
    counts = (sample.mapInArrow(count, "lang string, o int, run long, c long")
              .groupBy("lang", "o", "run").agg(F.sum("c").alias("c")).toArrow())
    total = {r["lang"]: r["n"] for r in per.collect()}
    languages = sorted(set(counts.column("lang").to_pylist()), key=lambda x: x.encode())
    if not languages:
        return None
    at = {x: i for i, x in enumerate(languages)}
    code = np.array([at[x] for x in counts.column("lang").to_pylist()])
    o, run, c = (counts.column(x).to_numpy() for x in ("o", "run", "c"))
    by = np.lexsort((run, o, code))
    code, o, run, c = code[by], o[by], run[by].astype(np.uint32), c[by].astype(float)
    parts = [[(run[m], c[m]) for k in range(ORDER + 1) for m in [(code == x) & (o == k)]] for x in range(len(languages))]
    share = np.array([total[x] for x in languages]) / sum(total[x] for x in languages)
    return Model(languages, np.rint(-np.log2(share) * BIT).astype(np.int64), parts)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``(row, lang_pred, score, bits)`` of every row; ``row`` is a struct of the
    ``carry`` columns (default: all), ``bits`` the winner's code length."""
    configure(docs.sparkSession)
    cols = docs.columns if carry is None else carry
    work = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), docs[text_col].alias("text"))
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = frozen.value
        for batch in blocks(batches):
            text = batch.column("text")
            n = len(text)
            pred, score, bits = np.full(n, -1), np.zeros(n), np.zeros(n)
            if model is not None and n:
                ok = has_letter(text)
                length = model.lengths(text)
                best = length.argmin(1)
                least = length[np.arange(n), best]
                odds = np.exp2(np.maximum((least[:, None] - length) / BIT, -1000.0)).sum(1)
                pred[ok], score[ok], bits[ok] = best[ok], 1 / odds[ok], least[ok] / BIT
            names = pa.array([*(model.languages if model else ()), UNKNOWN], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), names.take(pa.array(pred % len(names))), pa.array(score), pa.array(bits)],
                ["row", "lang_pred", "score", "bits"])
    return work.mapInArrow(run, f"row {work.schema['row'].dataType.simpleString()}, lang_pred string, score double, bits double")


def held_out(id_col: Column) -> Column:
    """The quarter of ids that is never trained on."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of all ``documents``, learned from three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train_on = docs.select("text", "lang", "doc_id").where(~held_out(F.col("doc_id")))
    out = identify(docs, train(train_on), carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "bits")


QUERIES = {"op11_language_id": (op11_language_id, None)}
