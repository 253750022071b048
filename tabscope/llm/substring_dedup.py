"""Operator 4: substring dedup by content-defined chunking.

A gear hash rolls over the bytes of every text (``h = (h << 1) + gear[byte]`` on
32 bits, so it depends on the last 32 bytes only). A text is cut before a word
where the hash falls below a fixed fraction, on average every ``MEAN`` words, at the latest after ``LONGEST``;
after an insertion or deletion the cuts fall into step again within 16 bytes.
Chunks are compared by a 64-bit digest of their words. A chunk whose digest
occurred before (in a text of smaller id, or earlier in the same text) is a
later copy; consecutive later copies form a run, and runs of at least
``MIN_WORDS`` words are removed. A passage of 50 shared words holds such a run
with a probability of over 99.5 %; what lies before its first and behind its
last cut stays.

Defined results: NULL and empty texts have no chunks; rows that repeat an id and
its text are one document; NULL ids come last; an empty table gives no rows.

Scale: first occurrences are a partial aggregate per digest, joined back by a
sort-merge join that the engine splits where a passage is in very many texts.
Only later copies are exchanged again, by document; the list of one document's
copies is bounded by the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configure, materialize
from ._text import Words, _powers, blocks, mix, utf8

MEAN = 4  # words per chunk
LONGEST = 64
MIN_WORDS = 20
WINDOW = 16  # bytes
DOC = ["nul", "id0", "tag"]

_U = np.uint64
_GEAR = (mix(np.arange(500, 756, dtype=_U)) >> _U(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte; it starts anew with every text."""
    h = _GEAR[data]
    since = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    step = 1
    while step < WINDOW:
        # The hash of 2 * step bytes from the hashes of step bytes.
        older = h[:-step] << np.uint32(step)
        older[since[step:] < step] = 0
        h = h.copy()
        h[step:] += older
        step *= 2
    return h


def chunks(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word within its text, words, digest) of every chunk."""
    n = len(words)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    cut = np.zeros(n, bool)
    inner = words.start > words.off[words.row]
    h = gear_hashes(words.data, words.off)
    cut[inner] = h[words.start[inner] - 1] < np.uint32((1 << 32) // MEAN)
    cut[words.first[:-1][np.diff(words.first) > 0]] = True
    begin = np.flatnonzero(cut)
    # A stretch without cuts (one word over and over) is cut every LONGEST words.
    pieces = -(-np.diff(np.r_[begin, n]) // LONGEST)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begin, pieces) + LONGEST * nth
    end = np.r_[begin[1:], n]
    power, inverse = _powers(max(1 << 16, n))
    c = np.r_[_U(0), np.cumsum(words.hashes() * power[:n], dtype=_U)]
    digest = mix((c[end] - c[begin]) * inverse[begin] ^ mix((end - begin).astype(_U)))
    row = words.row[begin]
    return row, begin - words.first[row], end - begin, digest.view(np.int64)


CHUNKS = "nul boolean, id0 bigint, tag int, at int, w int, digest bigint"


def _chunk(batches):
    for batch in blocks(batches):
        row, at, w, digest = chunks(Words(*utf8(batch.column("text"))))
        own = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(own) for c in DOC], pa.array(at.astype(np.int32)),
             pa.array(w.astype(np.int32)), pa.array(digest)],
            names=[f.split()[0] for f in CHUNKS.split(", ")])


RUNS = "nul boolean, id0 bigint, tag int, n_removed bigint, start array<int>, stop array<int>, sources array<bigint>"


def _runs(least: int):
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_removed", "start", "stop", "sources")}
            for copies in batch.column("copies").to_pylist():
                spans = []  # (start, stop, sources) in words
                for c in sorted(copies, key=lambda c: c["at"]):
                    if spans and spans[-1][1] == c["at"]:
                        spans[-1][1] += c["w"]
                        spans[-1][2].add(c["source"])
                    else:
                        spans.append([c["at"], c["at"] + c["w"], {c["source"]}])
                spans = [s for s in spans if s[1] - s[0] >= least]
                out["n_removed"].append(sum(b - a for a, b, _ in spans))
                out["start"].append([a for a, _, _ in spans])
                out["stop"].append([b for _, b, _ in spans])
                out["sources"].append(sorted({i for *_, s in spans for i in s if i is not None}))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in DOC], pa.array(out["n_removed"], pa.int64()),
                 pa.array(out["start"], pa.list_(pa.int32())), pa.array(out["stop"], pa.list_(pa.int32())),
                 pa.array(out["sources"], pa.list_(pa.int64()))],
                names=[f.split()[0] for f in RUNS.split(", ")])
    return run


def _key(docs: DataFrame, id_col: str, text_col: str) -> list:
    key, text = docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit(""))
    return [key.isNull().alias("nul"), F.coalesce(key, F.lit(0)).alias("id0"), F.hash(text).alias("tag")]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """``(nul, id0, tag, n_removed, start, stop, sources)`` of every document with
    a run to remove: word spans, and the ids of the texts that hold the first
    copies."""
    configure(docs.sparkSession)
    rows = docs.select(*_key(docs, id_col, text_col), docs[text_col].alias("text"))
    made = rows.mapInArrow(_chunk, CHUNKS)
    place = F.struct(*DOC, "at")
    first = (made.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                 .where("first < last").drop("last"))
    later = made.join(first, "digest").where(place > F.col("first"))
    source = F.when(~F.col("first.nul"), F.col("first.id0")).alias("source")
    per = (later.select(*DOC, F.struct("at", "w", source).alias("c"))
                .groupBy(*DOC).agg(F.collect_set("c").alias("copies")))
    return materialize(per.mapInArrow(_runs(min_words), RUNS).where("n_removed > 0"), "spans")


def _cut_out(batches):
    for batch in batches:
        texts = []
        for text, start, stop in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "stop"))):
            if start is None:
                texts.append(text)
                continue
            raw = text.encode()
            words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            out, done = [], 0
            for a, b in zip(start, stop):  # with the white space behind
                out.append(raw[done:words.start[a]])
                done = int(words.start[b]) if b < len(words) else len(raw)
            texts.append(b"".join([*out, raw[done:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string())],
                                         names=["__row", "__text"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated runs cut out of the text column."""
    spans = repeated_spans(docs, id_col, text_col, min_words).select(*DOC, "start", "stop")
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[docs[c] for c in rest]).alias("__row"), docs[text_col].alias("text"),
                       *_key(docs, id_col, text_col))
    joined = rows.join(spans, DOC, "left").select("__row", "text", "start", "stop")
    row = joined.schema["__row"].dataType.simpleString()
    clean = joined.mapInArrow(_cut_out, f"__row {row}, __text string")
    return clean.select(*[F.col("__text").alias(c) if c == text_col else F.col("__row").getField(c).alias(c)
                          for c in docs.columns])


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: words in repeated runs, their word spans
    (``start:stop``, from 0) and the ids of the texts with the first copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = repeated_spans(docs)
    text = F.concat_ws(",", F.zip_with("start", "stop", lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))))
    found = spans.select(*DOC, "n_removed", text.alias("spans"), "sources")
    words = F.coalesce(F.regexp_count(docs["text"], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(*_key(docs, "doc_id", "text"), docs["doc_id"].alias("doc_id"), words.alias("n_words"))
    return rows.join(found, DOC, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("sources", F.array().cast("array<bigint>")).alias("source_ids"))


QUERIES = {"op4_substring_dedup": (op4_substring_dedup, None)}
