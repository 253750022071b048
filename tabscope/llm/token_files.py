"""Operator 9: token-id files with directly addressable codes (DAC).

Ids are split into chunk levels: level 1 holds the low bits of every id, level 2
the next bits of those ids that need them, and so on. A continuation bitmap per
level says which ids go on, and a rank directory over the bitmap turns a
position on one level into the position on the next, so token ``i`` is read in
at most ``levels`` steps without decoding anything else. The chunk widths are
those that cost the fewest bits for the segment's ids.

Files. ``write_token_files`` writes two Parquet tables: ``segments`` (one row
per segment: its document ids, their token offsets, and the code bytes; a
segment holds whole documents, about ``SEGMENT`` tokens) and ``parts`` (first
token of each part). Spark's writer commits them, so a lost task leaves nothing
behind, and any store Spark can write will do.

Encoding. Where a tokenizer cuts at white space, equal words have equal ids: each
block's distinct words are encoded once (with a bounded cache per worker) and
the texts are put together from them, which gives the same ids as encoding the
whole text. ASCII words are looked up in lower case and without their final
punctuation where the tokenizer would cut off and fold these itself. A tokenizer
that does otherwise (:class:`WordEncoder` tries it out) gets the whole texts.

Defined results: NULL and empty texts have the end id only; documents are in
ascending id order, NULL ids last, repeated ids by text hash; an empty table
gives files without rows; other columns of the table are never read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, configure
from ._text import IdTable, Words, blocks, spell, utf8

END_ID = 1
SEGMENT = 1 << 19  # tokens
BLOCK = 4 << 20  # text bytes encoded together
CACHE = 400_000  # words a worker remembers
CHUNK = 10_000  # words per call of the tokenizer
RANK = 512  # bits per entry of the rank directory
MAGIC = b"DAC1"


# ---- the code ------------------------------------------------------------------

def chunk_widths(ids: np.ndarray, most: int = 3) -> tuple[int, ...]:
    """Widths of at most ``most`` levels with the fewest bits for ``ids``."""
    # The binary exponent of an id is its number of bits.
    lengths = np.bincount(np.maximum(np.frexp(ids.astype(np.float64))[1], 1), minlength=34)
    top = int(np.flatnonzero(lengths)[-1]) if lengths.any() else 1
    longer = np.r_[np.cumsum(lengths[::-1])[::-1], 0]  # ids of at least k bits
    best = None
    for n in range(1, min(most, top) + 1):
        for cut in combinations(range(1, top), n - 1):
            edge = (0, *cut, top)
            cost = sum(int(longer[edge[i] + 1] if i else longer[0]) * (edge[i + 1] - edge[i] + (i < n - 1))
                       for i in range(n))
            if best is None or cost < best[0]:
                best = cost, tuple(edge[i + 1] - edge[i] for i in range(n))
    return best[1]


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits side by side: each 64 of them fill ``width`` words
    of 64 bits, and the ``j``-th of 64 lies at the same place in all of them."""
    n = len(values)
    rows = np.zeros((-(-n // 64), 64), np.uint64)
    rows.reshape(-1)[:n] = values
    words = np.zeros((len(rows), width), np.uint64)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[:, at] |= rows[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8", copy=False).view(np.uint8).reshape(-1)[:-(-n * width // 8)].tobytes()


def _unpack(data: np.ndarray, width: int, start: int, stop: int) -> np.ndarray:
    """Values ``start:stop`` of a packed level: the bytes each one touches (at most
    5), put together and shifted."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    first = start * width // 8
    part = np.r_[data[first:-(-stop * width // 8)], np.zeros(5, np.uint8)]
    bit = np.arange(start * width - 8 * first, stop * width - 8 * first, width)
    byte = bit >> 3
    value = part[byte].astype(np.uint64)
    for k in range(1, (width + 14) // 8):
        value |= part[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def dac_encode(ids: np.ndarray) -> bytes:
    """Code bytes of ``ids`` (below ``2**32``)."""
    widths = chunk_widths(ids)
    out = [MAGIC, struct.pack("<IB", len(ids), len(widths)), bytes(widths)]
    rest = ids.astype(np.uint32)
    for i, w in enumerate(widths):
        last = i == len(widths) - 1
        low = rest & np.uint32((1 << w) - 1) if w < 32 else rest
        more = np.zeros(0, bool) if last else (rest >> np.uint32(w)) > 0
        data = _pack(low, w)
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK)) if len(more) else np.zeros(0, int)
        ranks = np.r_[0, np.cumsum(ones)].astype("<u4") if not last else np.zeros(0, "<u4")
        out += [struct.pack("<III", len(rest), len(data), len(bitmap)), data, bitmap.tobytes(),
                ranks.tobytes()]
        if not last:
            rest = rest[more] >> np.uint32(w)
    return b"".join(out)


class Dac:
    """Random access to a code: ``dac[i]``, ``dac.slice(a, b)``, ``len(dac)``."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        self.n, levels = struct.unpack_from("<IB", code, 4)
        self.widths = tuple(code[9:9 + levels])
        at, self.levels = 9 + levels, []
        for i in range(levels):
            n, size, bitmap = struct.unpack_from("<III", code, at)
            at += 12
            data = np.frombuffer(code, np.uint8, size, at)
            at += size
            more = np.frombuffer(code, np.uint8, bitmap, at)
            at += bitmap
            entries = 0 if i == levels - 1 else -(-n // RANK) + 1
            ranks = np.frombuffer(code, "<u4", entries, at)
            at += 4 * entries
            self.levels.append((data, more, ranks))

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a level's bitmap: one directory entry
        and at most ``RANK`` bits."""
        _, more, ranks = self.levels[level]
        block = i // RANK
        bits = np.unpackbits(more[block * RANK // 8:-(-i // 8)], bitorder="little")
        return int(ranks[block]) + int(bits[:i - block * RANK].sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for level, w in enumerate(self.widths):
            data, more, _ = self.levels[level]
            value |= int(_unpack(data, w, i, i + 1)[0]) << shift
            if level == len(self.widths) - 1 or not (more[i // 8] >> (i % 8)) & 1:
                return value
            shift += w
            i = self._rank(level, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start:stop``; only their own chunks are read."""
        out, where, shift = None, None, 0
        for level, w in enumerate(self.widths):
            data, more, _ = self.levels[level]
            low = _unpack(data, w, start, stop)
            if out is None:
                out, where = low, np.arange(len(low))
            else:
                out[where] |= low << np.uint32(shift)
            if level == len(self.widths) - 1 or start >= stop:
                return out
            bits = np.unpackbits(more[start // 8:-(-stop // 8)], bitorder="little")
            bits = bits[start % 8:start % 8 + stop - start].astype(bool)
            where, shift = where[bits], shift + w
            start = self._rank(level, start)
            stop = start + len(where)
        return out


# ---- words to ids ---------------------------------------------------------------

#: Words on which a tokenizer shows what it does with case, punctuation and blanks.
PROBES = ("a", "the", "Hello", "WORLD", "iPhone", "x1", "1", "42", "2024", "don't", "I'm", "e-mail", "a.b", "3.14", "1,000",
          "(x", "#tag", "$5", "Straße", "ÉCOLE", "naïve", "日本語", "Привет", "\U0001f600", "co-op's", "A1b2C3", "zzzzzzzzzzzzqqqq")
MARKS = (".", ",", ";", ":", "!", "?", "...", "?!", ".,")


class WordEncoder:
    """Ids of white-space words by the tokenizers library, cached.

    What may be done to a text before the tokenizer sees it is asked of the tokenizer
    itself, on ``PROBES``: ``alone``, whether a text's ids are those of its words, one
    by one; ``folds``, whether ASCII case makes no difference; ``cuts``, whether final
    ASCII punctuation is coded by itself. Where one does not hold, it is not done."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.table = IdTable(CACHE)
        words = PROBES + tuple(w + m for w in PROBES for m in MARKS)
        own = dict(zip(words, self.encode(list(words))))
        marks = dict(zip(MARKS, self.encode(list(MARKS))))
        blanks = (" ", "\n", "  ", " \t\r\n", "\x0b\x0c ")
        pairs = [(a, b) for a in words for b in PROBES]
        joined = self.encode([a + blanks[i % len(blanks)] + b for i, (a, b) in enumerate(pairs)])
        edges = self.encode([blank + w + blank for blank in blanks for w in PROBES])
        plain = [w for w in words if w.isascii()]
        self.alone = (all(x == own[a] + own[b] for x, (a, b) in zip(joined, pairs))
                      and edges == [own[w] for _ in blanks for w in PROBES])
        self.folds = self.alone and self.encode([w.lower() for w in plain]) == self.encode([w.upper() for w in plain]) == [own[w] for w in plain]
        self.cuts = self.folds and all(own[w + m] == own[w] + marks[m] for w in PROBES if w.isascii() and w[-1].isalnum() for m in MARKS)

    def encode(self, pieces: list[str]) -> list:
        out = []
        for i in range(0, len(pieces), CHUNK):
            part = pieces[i:i + CHUNK]
            out += [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def rows(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, ids) of distinct words: of an ASCII word in lower case,
        what stands before its final punctuation, then the punctuation (if that makes
        no difference to the tokenizer, else of the words as they are)."""
        if not self.cuts:
            return self.table.rows(words.to_pylist(), self.encode)
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        words = pc.if_else(plain, pc.ascii_lower(words), words)
        core = pc.ascii_rtrim(words, characters=".,;:!?")
        cut = pc.and_(pc.and_(plain, pc.match_substring_regex(core, "[0-9a-z]$")),
                      pc.less(pc.binary_length(core), pc.binary_length(words)))
        core = pc.if_else(cut, core, words)
        tail = pc.struct_field(pc.extract_regex(words.filter(cut), "(?P<t>[.,;:!?]+)$"), "t")
        coded = pa.concat_arrays([core, tail.cast(core.type)]).dictionary_encode()
        table = self.table.rows(coded.dictionary.to_pylist(), self.encode)
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        has_tail = cut.to_numpy(zero_copy_only=False)
        n = len(words)
        ids, upto = spell(np.insert(which[:n], np.flatnonzero(has_tail) + 1, which[n:]), *table)
        end = upto[np.arange(n) + np.cumsum(has_tail)] if n else upto
        start = np.r_[0, end[:-1]] if n else end
        return start, end - start, ids


_ENCODERS: dict[str, WordEncoder] = {}


def encode_block(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a text column, each text followed by the end id."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    encoder = _ENCODERS[path]
    if not encoder.alone:
        rows = encoder.encode([t or "" for t in column.to_pylist()])
        ends = np.cumsum([len(r) + 1 for r in rows], dtype=np.int64)
        return np.fromiter((i for r in rows for i in (*r, END_ID)), np.uint32, int(ends[-1]) if rows else 0), np.r_[0, ends]
    data, off = utf8(column)
    words = Words(data, off)
    edge = np.empty(2 * len(words), np.int64)
    edge[0::2], edge[1::2] = words.start, words.end
    # Words and the gaps between them as one array: the words are every other.
    spans = pa.LargeStringArray.from_buffers(
        len(edge) - 1 if len(edge) else 0, pa.py_buffer(edge if len(edge) else np.zeros(1, np.int64)),
        pa.py_buffer(np.ascontiguousarray(data)))
    if len(words):
        spans = spans.take(pa.array(np.arange(0, len(spans), 2)))
    coded = spans.dictionary_encode()
    start, size, flat = encoder.rows(coded.dictionary)
    # One pseudo word per text stands for its end id.
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    which = np.insert(which, words.first[1:], len(start))
    ids, upto = spell(which, np.r_[start, len(flat)], np.r_[size, 1], np.r_[flat, np.uint32(END_ID)])
    ends = upto[words.first[1:] + np.arange(len(off) - 1)] if len(off) > 1 else np.zeros(0, np.int64)
    return ids, np.r_[0, ends]


# ---- files ----------------------------------------------------------------------

SEGMENTS = ("part int, seq int, first bigint, n_tokens bigint, doc_ids array<bigint>, "
            "offsets array<bigint>, code binary")


def _segments(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        for batch in blocks(batches, limit=BLOCK):
            ids, off = encode_block(batch.column("text"), path)
            keys = batch.column("id")
            at = 0
            while at < len(off) - 1:
                stop = max(at + 1, int(np.searchsorted(off, off[at] + SEGMENT, "right")) - 1)
                mine = ids[off[at]:off[stop]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                     pa.array([first], pa.int64()), pa.array([len(mine)], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, stop - at], pa.int32()), keys.slice(at, stop - at)),
                     pa.array([(off[at:stop + 1] - off[at]).tolist()], pa.list_(pa.int64())),
                     pa.array([dac_encode(mine)], pa.binary())],
                    names=["part", "seq", "first", "n_tokens", "doc_ids", "offsets", "code"])
                first, seq, at = first + len(mine), seq + 1, stop
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Encode ``docs`` and write ``folder/segments`` and ``folder/parts``."""
    spark = configure(docs.sparkSession)
    key, text = docs[id_col].cast("long"), docs[text_col]
    order = [F.col("nul"), F.col("id"), F.col("th")]
    rows = docs.select(key.isNull().alias("nul"), key.alias("id"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("id", "text").mapInArrow(_segments(tokenizer), SEGMENTS) \
        .write.parquet(f"{folder}/segments")
    # One row per part: as many as the range exchange made.
    parts = sorted((r[0], r[1]) for r in spark.read.parquet(f"{folder}/segments")
                   .groupBy("part").agg(F.sum("n_tokens")).collect())
    begin, out = 0, []
    for part, n in parts:
        out.append((part, begin))
        begin += n
    spark.createDataFrame(out, "part int, begin bigint").write.parquet(f"{folder}/parts")


def _documents(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            row = {k: batch.column(k)[r] for k in batch.schema.names}
            dac, first = Dac(row["code"].as_py()), row["begin"].as_py() + row["first"].as_py()
            off = row["offsets"].values.to_numpy()
            ids = row["doc_ids"].values
            tokens = memoryview(dac.slice(0, len(dac)).astype("<u4").tobytes())
            crc = [zlib.crc32(tokens[4 * a:4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(off[:-1] + first), pa.array(np.diff(off)), pa.array(crc, pa.int64())],
                names=["id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark, folder: str) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` per document, from the files."""
    # ``parts`` has one row per partition of the writer.
    segments = spark.read.parquet(f"{folder}/segments").drop("n_tokens", "seq")
    parts = spark.read.parquet(f"{folder}/parts")
    return segments.join(F.broadcast(parts), "part").mapInArrow(
        _documents, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded, written as DAC files and read back."""
    from public_tokenizers import path
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tabscope-tokens-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, folder, path("word_bpe_49k.json"))
    return read_token_files(spark, folder).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_token_files": (op9_token_files, None)}
