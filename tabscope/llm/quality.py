"""Operator 5: quality rules and a hashed n-gram logistic regression.

Base rules reject texts of fewer than 10 words and texts of which over 20 % of
the words lie in repeated 5-word windows. For the others a logistic regression
decides. Its features are the relative frequencies of word 1- and 2-grams (one
family) and of character 3-grams over UTF-8 bytes (another), each hashed into a
fixed number of slots. It is trained on labelled rows: those ``SAMPLE`` rows of
``labels`` whose id has the smallest hash (a fixed bound, independent of the
corpus size), three quarters for the weights and one quarter to calibrate the
scores to probabilities (Platt's sigmoid). Every text of the corpus is scored
whole, in Arrow batches, and kept if its probability reaches ``THRESHOLD``.

Defined results: NULL and empty texts have no words and fail the base rules;
labels that are NULL or whose id has no document are not used; equal rows get
equal results; without labels of both classes the base rules alone decide; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configure
from ._text import SEGMENT, Words, blocks, mix, span_hashes, utf8, window_hashes

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20  # words; percent
SAMPLE = 3000  # labelled rows used for training and calibration
THRESHOLD = 0.5
BLOCK = 512 << 10  # text bytes judged together: workers may still hold other steps' caches
WORD_BITS, CHAR_BITS = 16, 15
ROUNDS, RATE, DECAY = 200, 0.5, 1e-6

_U = np.uint64
_NEWLINE = 10
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeats(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, occurred before) per item, within its row."""
    tag = mix(h ^ mix(row.astype(_U) + _U(1)))
    order = np.argsort(tag, kind="stable")
    same = np.r_[False, tag[order][1:] == tag[order][:-1]] if len(tag) else np.zeros(0, bool)
    before = np.zeros(len(tag), bool)
    before[order] = same
    twice = np.zeros(len(tag), bool)
    twice[order] = same | np.r_[same[1:], False] if len(tag) else same
    return twice, before


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """The base figures of each row of a block."""
    data, off = words.data, words.off
    rows = len(off) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(rows, np.int64)
        for a in range(0, len(mask), SEGMENT):
            c += np.diff(np.searchsorted(a + np.flatnonzero(mask[a:a + SEGMENT]), off))
        return c

    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    np.add.at(inside, words.end, -1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
    n_words = np.diff(words.first)

    h = words.hashes()
    wh, at = window_hashes(h, words.row, words.first, WINDOW)
    twice, _ = _repeats(wh, words.row[at])
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + WINDOW, -1)
    covered = np.cumsum(covered[:-1]) > 0

    # Lines: from a row's start or a newline to the next newline or row's end.
    cuts = np.flatnonzero(data == _NEWLINE)
    start = np.sort(np.r_[off[:-1], cuts + 1])
    stop = np.sort(np.r_[off[1:], cuts])
    line_row = np.searchsorted(cuts, off[1:], "left") - np.searchsorted(cuts, off[:-1], "left") + 1
    line_row = np.repeat(np.arange(rows), line_row)
    has_word = np.searchsorted(words.start, stop) > np.searchsorted(words.start, start)
    lh = span_hashes(data, start[has_word], stop[has_word])
    _, again = _repeats(lh, line_row[has_word])
    return {
        "n_words": n_words,
        "word_chars": per_row(in_word & ((data & 0xC0) != 0x80)),
        "n_symbols": per_row(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_row[has_word][again], minlength=rows),
        "n_repeat_words": np.bincount(words.row[covered], minlength=rows),
        "hashes": h,
    }


def _families(words: Words, h: np.ndarray):
    """Per family: the parts of it, each slot and row of its n-grams in order."""
    pair, at = window_hashes(h, words.row, words.first, 2)
    slots = np.r_[h, pair] >> _U(64 - WORD_BITS)
    yield [(slots.astype(np.int64), np.r_[words.row, words.row[at]])]
    yield _bytes(words)


def _bytes(words: Words):
    """Slot and row of every 3-gram of bytes, ``SEGMENT`` bytes of text at a time."""
    rows = np.arange(len(words.off) - 1)
    for a in range(0, len(words.data) - 2, SEGMENT):
        data = words.data[a:a + SEGMENT + 2]
        gram = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << 8 | data[2:].astype(np.uint32) << 16
        slots = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)
        row = np.repeat(rows, np.diff(np.clip(words.off, a, a + len(data))))
        inside = row[:-2] == row[2:]
        yield (1 << WORD_BITS) + slots[inside].astype(np.int64), row[:-2][inside]


@dataclass
class Model:
    """Slot weights, bias, and the calibration ``sigmoid(a * score + b)``."""

    weights: np.ndarray
    bias: float
    a: float
    b: float

    def probability(self, words: Words, h: np.ndarray) -> np.ndarray:
        rows = len(words.off) - 1
        score, each = np.full(rows, self.bias), np.arange(rows)
        for family in _families(words, h):
            n, total = np.zeros(rows, np.int64), np.zeros(rows)
            for slots, row in family:  # the sums go on where the part before ended
                n += np.bincount(row, minlength=rows)
                total = np.bincount(np.r_[each, row], weights=np.r_[total, self.weights[slots]], minlength=rows)
            score += total / np.maximum(n, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(self.a * score + self.b, -30, 30)))


def _counted(family) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``row << 32 | slot`` of a family, ascending, and their numbers."""
    key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for slots, row in family:
        new, n = np.unique(row << 32 | slots, return_counts=True)
        key, at = np.unique(np.r_[key, new], return_inverse=True)
        count = np.bincount(at, weights=np.r_[count, n], minlength=len(key)).astype(np.int64)
    return key, count


def _features(batches):
    """(y, test, slot list, value list) per labelled text."""
    for batch in blocks(batches, limit=BLOCK):
        data, off = utf8(batch.column("text"))
        words = Words(data, off)
        rows = len(off) - 1
        keys, values = [], []
        for family in _families(words, words.hashes()):
            key, count = _counted(family)
            n = np.bincount(key >> 32, weights=count, minlength=rows)
            keys.append(key)
            values.append(count / n[key >> 32])
        key, value = np.concatenate(keys), np.concatenate(values).astype(np.float32)
        order = np.argsort(key >> 32, kind="stable")
        key, value = key[order], value[order]
        edge = np.searchsorted(key >> 32, np.arange(rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("y"), batch.column("test"),
             pa.ListArray.from_arrays(pa.array(edge), pa.array((key & 0xFFFFFFFF).astype(np.int32))),
             pa.ListArray.from_arrays(pa.array(edge), pa.array(value))],
            names=["y", "test", "slot", "value"])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(y: np.ndarray, test: np.ndarray, row: np.ndarray, slot: np.ndarray,
        value: np.ndarray) -> Model | None:
    """Logistic regression by Adagrad on all training rows at once, then
    Platt's calibration on the test rows (classes weigh alike in the first)."""
    size = (1 << WORD_BITS) + (1 << CHAR_BITS)
    train = ~test
    if len(np.unique(y[train])) < 2:
        return None
    w, b = np.zeros(size), 0.0
    grad_w, grad_b = np.full(size, 1e-8), 1e-8
    weight = np.where(y == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum())) * train

    def score():
        return np.bincount(row, weights=w[slot] * value, minlength=len(y)) + b

    for _ in range(ROUNDS):
        err = (_sigmoid(score()) - y) * weight
        g = np.bincount(slot, weights=err[row] * value, minlength=size) + DECAY * w
        grad_w += g * g
        w -= RATE * g / np.sqrt(grad_w)
        grad_b += err.sum() ** 2
        b -= RATE * err.sum() / np.sqrt(grad_b)
    s, t = score()[test], y[test]
    a, c = 1.0, 0.0
    if len(np.unique(t)) == 2:
        # Platt's smoothed targets keep the slope finite on separable scores.
        up, down = (t == 1).sum(), (t == 0).sum()
        goal = np.where(t == 1, (up + 1) / (up + 2), 1 / (down + 2))
        a = 1.0 / max(1e-9, s.std())
        for _ in range(50):  # Newton with a small ridge
            p = _sigmoid(a * s + c)
            v = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((p - goal) * s).sum(), (p - goal).sum()])
            hess = np.array([[(v * s * s).sum(), (v * s).sum()], [(v * s).sum(), v.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(hess, g)
            a, c = a - step[0], c - step[1]
            if np.abs(step).max() < 1e-9:
                break
    return Model(w.astype(np.float32), float(b), float(a), float(c))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Model from at most ``sample`` labelled rows (those of smallest id hash).
    Only their hashed features reach the driver: at most one value per slot."""
    configure(docs.sparkSession)
    h = F.xxhash64(labels[id_col], F.lit(5))
    chosen = (labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull())
                    .select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y"), h.alias("h"))
                    .orderBy("h", "id", "y").limit(sample)
                    .select("id", "y", (F.pmod("h", F.lit(4)) == 0).alias("test")))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    got = (rows.join(F.broadcast(chosen), "id").select("y", "test", "text")  # ≤ ``sample`` rows
               .mapInArrow(_features, "y int, test boolean, slot array<int>, value array<float>")
               .toArrow().combine_chunks())
    if got.num_rows == 0:
        return None
    slot, value = got.column("slot").combine_chunks(), got.column("value").combine_chunks()
    if isinstance(slot, pa.ChunkedArray):
        slot, value = pa.concat_arrays(slot.chunks), pa.concat_arrays(value.chunks)
    size = np.diff(slot.offsets.to_numpy())
    return fit(got.column("y").to_numpy().astype(np.float64), got.column("test").to_numpy(),
               np.repeat(np.arange(got.num_rows), size), slot.flatten().to_numpy().astype(np.int64),
               value.flatten().to_numpy().astype(np.float64))


def judge(column: pa.Array, model: Model | None, threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    """Base figures, ``base_failed``, ``probability`` and ``kept`` per text."""
    data, off = utf8(column)
    words = Words(data, off)
    out = base_counts(words)
    h = out.pop("hashes")
    failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    p = model.probability(words, h) if model is not None else np.ones(len(off) - 1)
    return out | {"base_failed": failed, "kept": ~failed & (p >= threshold), "probability": p}


SCORED = ("id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean, kept boolean, probability double")


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row of figures per document."""
    names = [f.split()[0] for f in SCORED.split(", ")]

    def run(batches):
        for batch in blocks(batches, limit=BLOCK):
            got = judge(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(got[n]) for n in names[1:]]], names=names)

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, SCORED).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are kept. No shuffle."""
    def run(batches):
        for batch in blocks(batches, text_col, BLOCK):
            kept = judge(batch.column(text_col), model)["kept"]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base figures and verdict for every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model)


QUERIES = {"op5_quality_rules": (op5_quality_rules, None)}
