"""Operator 10: SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary is a byte-pair one, so the wanted path is the one the library's
merges give. That path is a Viterbi path: two neighbouring pieces either can
stand side by side after all merges or cannot (:meth:`Vocabulary.fits`), a
piece sequence is the library's result exactly if all neighbours fit, and every
prefix of a text has one such sequence. So each position needs one state, its
last piece, found among the pieces that end there and fit the state they start
from.

Streaming. A state can only be extended while a piece may still begin there,
so the last ``longest`` positions survive; older ones live on as ancestors
only. Once all survivors' backpointers lead through one boundary, the ids up to
it are committed and forgotten (:class:`StreamingViterbi`). Between two
characters that no piece holds side by side, such as a letter and a blank, the
survivors converge at once; texts are cut there, and each distinct cut is encoded once per block, with a
bounded cache per worker.

Defined results: NULL and empty texts have no ids and decode to the empty text;
U+2581 in a text is a blank, as in the library; characters without a piece
become byte pieces; equal rows get equal ids; an empty table gives no rows;
extra columns travel in one struct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configure
from ._text import IdTable, blocks, spell, utf8

BLANK = "▁"
CACHE = 200_000  # cuts a worker remembers
PAIRS = 200_000  # neighbours a worker remembers
BLOCK = 2 << 20  # text bytes encoded together


class Vocabulary:
    """Pieces of a SentencePiece byte-pair model."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1, np.int64)
        self.id: dict[str, int] = {}
        self.bytes: list[bytes] = []
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.id[piece] = i
                self.bytes.append(piece.replace(BLANK, " ").encode())
        # Merges prefer the higher score; a smaller rank merges earlier.
        self.rank = {p: -model.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self._shape: dict[str, tuple | None] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        for p in [p for p in self.id if len(p) > 1 and self.shape(p) is None]:
            del self.id[p]  # no merge sequence ends in it
        self._own = {p: p for p in self.id}  # one string object per piece for the pairs remembered
        # Pieces by their characters from the last to the first; "" marks one.
        self.backward: dict = {}
        for p in self.id:
            node = self.backward
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = True
        # ASCII neighbours (blanks for U+2581) that some piece holds: between
        # any other two no piece crosses.
        self.inside = np.zeros((256, 256), bool)
        self.inside[128:, :] = self.inside[:, 128:] = True
        for p in self.id:
            q = p.replace(BLANK, " ")
            for x, y in zip(q, q[1:]):
                if x < "\x80" and y < "\x80":
                    self.inside[ord(x), ord(y)] = True

    def shape(self, piece: str) -> tuple | None:
        """(left edge, right edge) of the merges that build ``piece``: the first
        and the last symbol over time, as ``(symbol, (time, rank))`` with the
        moment each is made. None if merging its characters gives other pieces."""
        if piece in self._shape:
            return self._shape[piece]
        start = (float("-inf"), float("-inf"))
        parts = [(c, start) for c in piece]
        left, right = [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i][0] + parts[i + 1][0])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                self._shape[piece] = None
                return None
            a, b = parts[at], parts[at + 1]
            made = (a[0] + b[0], (max(best, a[1][0], b[1][0]), best))
            parts[at:at + 2] = [made]
            if at == 0:
                left.append(made)
            if at == len(parts) - 1:
                right.append(made)
        self._shape[piece] = left, right
        return left, right

    def fits(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` stay two pieces when their characters are
        merged together: no symbol at the end of ``a`` merges with one at the
        start of ``b`` before one of them is merged inside its own piece."""
        known = self._fits.get((a, b))
        if known is not None:
            return known
        ends = self.shape(a)[1] if a in self.id else [(a, (float("-inf"),) * 2)]
        begins = self.shape(b)[0] if b in self.id else [(b, (float("-inf"),) * 2)]
        never = (float("inf"), float("inf"))
        i = j = 0
        out = True
        while True:
            (x, tx), (y, ty) = ends[i], begins[j]
            next_a = ends[i + 1][1] if i + 1 < len(ends) else never
            next_b = begins[j + 1][1] if j + 1 < len(begins) else never
            rank = self.rank.get(x + y)
            if rank is not None:
                when = (max(rank, tx[0], ty[0]), rank)
                # Of equal merges the leftmost comes first.
                if when < next_a and when <= next_b:
                    out = False
                    break
            if next_a == never and next_b == never:
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self._fits) >= PAIRS:
            self._fits.clear()
        self._fits[self._own.get(a, a), self._own.get(b, b)] = out
        return out

    def ids(self, piece: str) -> tuple[int, ...]:
        """Id of a piece, or the byte pieces of a character without one."""
        i = self.id.get(piece)
        return (i,) if i is not None else tuple(int(self.byte[b]) for b in piece.encode())


class StreamingViterbi:
    """Encode a stream of characters; at most the window of surviving positions
    and their paths back to the last committed boundary are held."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.tail = ""  # the last ``longest`` characters
        self.n = 0  # characters read
        self.root = 0  # committed boundary
        # position -> [last piece, start position, children]
        self.state: dict[int, list] = {0: [None, -1, 0]}

    def push(self, char: str) -> list[str]:
        """Read one character; the pieces committed by it."""
        v, n = self.v, self.n + 1
        self.tail = (self.tail + char)[-v.longest:]
        for size in range(min(len(self.tail), v.longest), 0, -1):
            piece, from_ = self.tail[-size:], self.state.get(n - size)
            if from_ is None or (piece not in v.id and size > 1):
                continue
            if from_[0] is None or v.fits(from_[0], piece):
                break
        else:  # a character without a piece
            size, piece = 1, char
        self.state[n] = [piece, n - size, 0]
        self.state[n - size][2] += 1
        self.n = n
        self._forget(n - v.longest)
        return self._commit(n - v.longest)

    def _forget(self, at: int) -> None:
        """Position ``at`` can no longer be extended: drop it, and its
        ancestors outside the window, if nothing leads on from them."""
        while at > self.root and at <= self.n - self.v.longest and at in self.state and not self.state[at][2]:
            _, start, _ = self.state.pop(at)
            self.state[start][2] -= 1
            at = start

    def _commit(self, last: int) -> list[str]:
        """Pieces up to the boundary on which all survivors' paths converge."""
        out = []
        while self.root <= last and self.state[self.root][2] == 1:
            child = next(p for p in range(self.root + 1, self.root + self.v.longest + 1)
                         if p in self.state and self.state[p][1] == self.root)
            out.append(self.state[child][0])
            del self.state[self.root]
            self.root = child
        return out

    def finish(self) -> list[str]:
        """The remaining pieces of the whole stream's path."""
        out, at = [], self.n
        while at > self.root:
            out.append(self.state[at][0])
            at = self.state[at][1]
        return out[::-1]


def encode_text(v: Vocabulary, text: str) -> list[int]:
    """Ids of one text by one uncut stream."""
    if not text:
        return []
    return list(_stream_ids(v, BLANK + text.replace(" ", BLANK)))


def _stream_ids(v: Vocabulary, chars: str) -> tuple[int, ...]:
    stream, out = StreamingViterbi(v), []
    for char in chars:
        out += stream.push(char)
    return tuple(i for p in out + stream.finish() for i in v.ids(p))


def cut_ids(v: Vocabulary, cuts: list[str]) -> dict[str, tuple[int, ...]]:
    """Ids of distinct cuts (U+2581 for blanks). Short cuts need no commits; a
    state depends on the characters before it only, so in sorted order each cut
    goes on from the states of the prefix it shares with the one before."""
    out: dict[str, tuple[int, ...]] = {}
    trie, fits, memo, ids = v.backward, v.fits, v._fits, v.ids
    last, start, before = [None], [-1], ""
    for cut in sorted(cuts):
        if len(cut) > 8 * v.longest:
            out[cut] = _stream_ids(v, cut)
            continue
        n = 0
        for x, y in zip(cut, before):
            if x != y:
                break
            n += 1
        del last[n + 1:], start[n + 1:]
        before = cut
        for n in range(n + 1, len(cut) + 1):
            node, ends = trie, []
            for a in range(n - 1, -1, -1):
                node = node.get(cut[a])
                if node is None:
                    break
                if "" in node:
                    ends.append(a)
            for a in reversed(ends):
                piece, state = cut[a:n], last[a]
                if state is None:
                    break
                ok = memo.get((state, piece))
                if fits(state, piece) if ok is None else ok:
                    break
            else:
                a, piece = n - 1, cut[n - 1]
            last.append(piece)
            start.append(a)
        path, n = [], len(cut)
        while n > 0:
            path.append(ids(last[n]))
            n = start[n]
        out[cut] = tuple(i for t in reversed(path) for i in t)
    return out


class Codec:
    """Encode and decode blocks of texts."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.table = IdTable(CACHE)

    def _new(self, cuts: list[str]) -> list:
        chars = [c.replace(" ", BLANK) for c in cuts]
        ids = cut_ids(self.v, chars)
        return [ids[c] for c in chars]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a text column."""
        data, off = utf8(column)
        full = np.flatnonzero(np.diff(off))
        # A blank goes before every text that is not empty.
        data = np.insert(data, off[:-1][full], 0x20)
        off = off + np.r_[0, np.cumsum(np.diff(off) > 0)]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.v.inside[data[:-1], data[1:]]
        cut[off] = True
        edge = np.flatnonzero(cut)
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        spans = pa.LargeStringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.astype(np.int64)),
                                                 pa.py_buffer(data))
        coded = spans.dictionary_encode()
        table = self.table.rows(coded.dictionary.to_pylist(), self._new)
        ids, upto = spell(coded.indices.to_numpy(zero_copy_only=False), *table)
        return ids.astype(np.int32), np.r_[0, upto][np.searchsorted(edge, off)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of one id list."""
        joined = b"".join([self.v.bytes[i] for i in ids.tolist()])
        text = joined.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encode(path: str):
    def run(batches):
        c = codec(path)
        for batch in blocks(batches, limit=BLOCK):
            ids, off = c.encode(batch.column("text"))
            same = []
            for text, a, b in zip(batch.column("text").to_pylist(), off[:-1], off[1:]):
                same.append(c.decode(ids[a:b]) == (text or "").replace(BLANK, " "))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.diff(off)),
                 pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)),
                 pa.array(same, pa.bool_())], names=["row", "n_tokens", "ids", "round_trip"])
    return run


def _decode(path: str):
    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [None if ids is None else c.decode(np.asarray(ids, np.int64))
                     for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())],
                                             names=["row", "text"])
    return run


def encode_documents(docs: DataFrame, model: str, text_col: str = "text",
                     carry: list[str] | None = None) -> DataFrame:
    """``(row, n_tokens, ids, round_trip)``: ids of every text, and whether they
    decode to it. ``row`` holds the ``carry`` columns (default: all but the
    text). No shuffle."""
    configure(docs.sparkSession)
    cols = [c for c in docs.columns if c != text_col] if carry is None else carry
    rows = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), docs[text_col].alias("text"))
    row = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_encode(model), f"row {row}, n_tokens bigint, ids array<int>, round_trip boolean")


def decode_documents(coded: DataFrame, model: str) -> DataFrame:
    """``(row, text)`` from ``(row, ids)``."""
    row = coded.schema["row"].dataType.simpleString()
    return coded.select("row", "ids").mapInArrow(_decode(model), f"row {row}, text string")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents``, decoded again and compared."""
    from public_tokenizers import path
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_documents(docs, path("piece_bpe_32k.model"), carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids", "round_trip")


QUERIES = {"op10_sentencepiece": (op10_sentencepiece, None)}
