"""Operator 6: personal data by base rules and a semi-Markov CRF.

Base rules find e-mail addresses, IP addresses, card and phone numbers by
pattern and check digit. They always stay. A semi-Markov conditional random
field adds spans the patterns miss (a phone number without ``+``, an address
with blanks around the ``@``): it scores whole candidate segments of up to
``LONGEST`` tokens and ``LONGEST_CHARS`` characters (longer ones are left to the
patterns, which have no bound) by features of the whole span (its shape, numbers of digits,
Luhn and octet tests, edges, neighbours), and dynamic programming over segments
picks boundaries and types jointly.

Only windows around digits and ``@`` are decoded: elsewhere a segment has no
digit and no ``@`` and cannot be an entity, so the windows are independent.

Training. A bounded sample of ``SAMPLE`` windows of the corpus (those of
smallest hash) is labelled by the base rules; each labelled window is added
``VARIANTS`` times with its spans rewritten in looser forms that the base rules do
not know, each other one once more with a date, an amount or a range.
The weights maximise the conditional likelihood (batched forward-backward).

Defined results: NULL and empty texts have no spans; positions are code points,
ends exclusive; spans are ordered by start, then kind as in ``KINDS``; equal rows
get equal results; without any base span in the sample the base rules alone
decide; an empty table gives no rows; extra columns are not read. The patterns are
searched in time linear in the text, however long its runs of digits or letters are.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configure, materialize
from ._text import blocks

# The base rules. Possessive: what a run of characters has taken is
# never given back, so a search is linear in the text. No match needs it back: each
# run is followed by a character that it cannot hold.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")  # the rule; searched from the ``@``:
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SAMPLE = 1200  # training windows
VARIANTS = 3  # looser forms of a labelled window
WINDOW_TOKENS = 48  # longest training window
LONGEST, LONGEST_CHARS = 16, 128  # tokens and characters of an entity that the model adds
SLOTS = 1 << 12  # hashed features per type
ROUNDS, RATE, DECAY = 120, 0.3, 1e-4
MARGIN = 1.0  # log odds an added span needs against no span

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ANCHOR = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\W_]+|\s+|.", re.S)
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]*\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base rules, in order."""
    out = []
    at, free = text.find("@"), 0  # addresses before ``free`` are done
    while at >= 0:
        # The local part reaches back over all its characters (no ``@`` is one of them).
        a = at
        while a > free and (run := _LOCAL_TAIL.search(text[max(free, a - 64):a]).group()):
            a -= len(run)
            if len(run) < 64:
                break
        m = EMAIL_DOMAIN.match(text, at) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    for m in IP.finditer(text):
        if all(_octet(p) for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub(r"[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of neighbouring words (at most one other word between) with a
    digit or ``@``."""
    out: list[list[int]] = []
    gap = 2
    for m in _WORD.finditer(text):
        if _ANCHOR.search(text, m.start(), m.end()):
            if gap <= 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            gap = 0
        else:
            gap += 1
    return [(a, b) for a, b in out]


# ---- segments and their features ------------------------------------------------

def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SLOTS


def _kind_of(char: str) -> str:
    return "^" if not char else "9" if char.isdigit() else "a" if char.isalpha() else "_" if char.isspace() else char


def _features(text: str, a: int, b: int, tokens: int) -> list[int]:
    """Slots of the features of the span ``a:b`` (a whole-span view)."""
    s = text[a:b]
    runs = re.sub(r"[^\W\d_]+", "a", s)
    shape = re.sub(r"[0-9]+", lambda m: f"9{len(m.group())}", runs)
    coarse = re.sub(r"[a9]+", "x", re.sub(r"[0-9]+", "9", runs))
    digits = re.sub(r"[^0-9]", "", s)
    parts = s.split(".")
    octets = len(parts) == 4 and all(p.isdigit() and p.isascii() and _octet(p) for p in parts)
    left, right = _kind_of(text[a - 1:a]), _kind_of(text[b:b + 1])
    names = (
        "bias", f"shape {shape}" if "@" not in s else "shape @", f"coarse {coarse}", f"digits {min(len(digits), 20)}",
        f"luhn {12 <= len(digits) <= 19 and luhn(digits)} {len(digits) == len(s)}", f"octets {octets}",
        f"at {s.count('@')} dots {min(s.count('.'), 5)}", f"blanks {min(sum(map(str.isspace, s)), 5)}",
        f"edges {_kind_of(s[:1])}{_kind_of(s[-1:])}", f"left {left}{_kind_of(s[:1])}", f"right {_kind_of(s[-1:])}{right}",
        f"tokens {tokens}",
    )
    return [_slot(n) for n in names]


def segments(text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """(token edges, candidate segments ``(first, last, slots)``) of a window. A
    candidate has a digit or ``@``, begins with a letter, digit, ``+`` or ``(``
    and ends with a letter or digit."""
    edge = [m.start() for m in _TOKEN.finditer(text, a, b)] + [b]
    out = []
    for i in range(len(edge) - 1):
        if not (text[edge[i]].isalnum() or text[edge[i]] in "+("):
            continue
        for j in range(i + 1, min(i + LONGEST, len(edge) - 1) + 1):
            if edge[j] - edge[i] > LONGEST_CHARS:
                break
            if not text[edge[j] - 1].isalnum():
                continue
            span = text[edge[i]:edge[j]]
            if "@" in span or sum(c.isdigit() for c in span) >= 4:
                out.append((i, j, _features(text, edge[i], edge[j], j - i)))
    return edge, out


@dataclass
class Model:
    """``weights[kind, slot]`` of entity segments against tokens outside (0)."""

    weights: np.ndarray

    def scores(self, slots: list[list[int]]) -> np.ndarray:
        """(segments, kinds)."""
        return self.weights[:, np.array(slots, np.int64)].sum(axis=2).T

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Best segmentation of each window by dynamic programming."""
        out = []
        for a, b in windows(text):
            edge, found = segments(text, a, b)
            if not found:
                continue
            score = self.scores([f for *_, f in found]) - MARGIN
            kind = score.argmax(axis=1)
            gain = score[np.arange(len(found)), kind]
            ends: dict[int, list[int]] = {}
            for k, (_, j, _) in enumerate(found):
                if gain[k] > 0:
                    ends.setdefault(j, []).append(k)
            best, back = [0.0], [None]
            for j in range(1, len(edge)):
                value, which = best[j - 1], None  # token j - 1 stays outside
                for k in ends.get(j, ()):
                    if best[found[k][0]] + gain[k] > value:
                        value, which = best[found[k][0]] + gain[k], k
                best.append(value)
                back.append(which)
            j = len(edge) - 1
            while j > 0:
                if back[j] is None:
                    j -= 1
                else:
                    k = back[j]
                    out.append((edge[found[k][0]], int(kind[k]), edge[j]))
                    j = found[k][0]
        return sorted(out)


# ---- training -------------------------------------------------------------------

def _looser(span: str, kind: int, rng: random.Random) -> str:
    """The span in a form that the base rules do not know (or know as well)."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        return rng.choice((span.replace("@", " @ "), span.replace("@", "@ "), span.replace("@", " @"), span))
    if kind == 2:
        group = rng.choice((" ", "-", ""))
        return group.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    if kind == 3 and len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}",
                           f"1 ({a}) {b}-{c}"))
    return span


def _decoy(rng: random.Random) -> str:
    """A number that is no personal datum: a date, an amount, a version, a range."""
    y, m, d = rng.randint(1900, 2030), rng.randint(1, 12), rng.randint(1, 28)
    n = rng.randint(1000, 9_999_999)
    return rng.choice((f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{n:,}", f"{n}", f"{n}-{n + d}",
                       f"{d}.{m}.{y % 10}", f"{y}-{y + d}", f"{n / 100:.2f}"))


def _examples(rows: list[tuple[str, list[tuple[int, int, int]]]]):
    """Per training window: tokens, segments, and the index of the true ones."""
    rng = random.Random(6)
    texts = []
    for text, spans in rows:
        texts.append((text, spans))
        if not spans and (cut := text.rfind(" ")) > 0:
            texts.append((f"{text[:cut]} {_decoy(rng)}{text[cut:]}", []))
        for _ in range(VARIANTS if spans else 0):
            new, out, done = [], "", 0
            for a, kind, b in spans:
                out += text[done:a]
                put = _looser(text[a:b], kind, rng)
                new.append((len(out), kind, len(out) + len(put)))
                out, done = out + put, b
            texts.append((out + text[done:], new))
    for text, spans in texts:
        word = list(_WORD.finditer(text))
        if not word:
            continue
        # The first and last word are context.
        edge, found = segments(text, word[0].start(), word[-1].end())
        if not found or len(edge) > 2 * WINDOW_TOKENS:
            continue
        at = {e: i for i, e in enumerate(edge)}
        want = {(at.get(a), at.get(b)): kind for a, kind, b in spans}
        label = [want.get((i, j), -1) for i, j, _ in found]
        yield len(edge) - 1, found, label


def fit(rows: list[tuple[str, list[tuple[int, int, int]]]]) -> Model | None:
    """Weights by gradient steps on the exact conditional likelihood."""
    data = list(_examples(rows))
    if not any(k >= 0 for *_, label in data for k in label):
        return None
    n_kinds, n = len(KINDS), len(data)
    length = max(t for t, *_ in data)
    slots = np.array([f for _, found, _ in data for *_, f in found], np.int64)
    who = np.concatenate([np.full(len(found), w) for w, (_, found, _) in enumerate(data)])
    first = np.array([i for _, found, _ in data for i, *_ in found])
    last = np.array([j for _, found, _ in data for _, j, _ in found])
    label = np.array([k for *_, labels in data for k in labels])
    tokens = np.array([t for t, *_ in data])
    by_end = [np.flatnonzero(last == j) for j in range(length + 1)]
    by_start = [np.flatnonzero(first == i) for i in range(length + 1)]
    weights = np.zeros((n_kinds, SLOTS))
    weights[:, _slot("bias")] = -2.0
    square = np.full((n_kinds, SLOTS), 1e-6)
    true = np.zeros((len(slots), n_kinds))
    true[label >= 0, label[label >= 0]] = 1.0
    for _ in range(ROUNDS):
        score = weights[:, slots].sum(axis=2).T
        any_kind = np.logaddexp.reduce(score, axis=1)
        # Sums over segmentations of the tokens before, and behind, a position.
        before = np.zeros((n, length + 1))
        for j in range(1, length + 1):
            before[:, j] = before[:, j - 1]
            if len(e := by_end[j]):
                np.logaddexp.at(before[:, j], who[e], before[who[e], first[e]] + any_kind[e])
        behind = np.zeros((n, length + 1))
        for i in range(length - 1, -1, -1):
            live = i < tokens
            behind[live, i] = behind[live, i + 1]
            if len(s := by_start[i]):
                np.logaddexp.at(behind[:, i], who[s], any_kind[s] + behind[who[s], last[s]])
        total = behind[:, 0]
        p = np.exp(before[who, first][:, None] + score + behind[who, last][:, None] - total[who][:, None])
        g = np.zeros_like(weights)
        for k in range(n_kinds):
            err = (p[:, k] - true[:, k]) / n
            g[k] = np.bincount(slots.reshape(-1), np.repeat(err, slots.shape[1]), minlength=SLOTS)
        g += DECAY / n * weights
        square += g * g
        weights -= RATE * g / np.sqrt(square)
    return Model(weights.astype(np.float32))


def _sample_windows(keep: int):
    """The ``keep`` windows of smallest hash of each half (with and without base
    spans) of one task."""
    def run(batches):
        best: tuple[dict, dict] = ({}, {})
        for batch in blocks(batches):
            for text in batch.column("text").to_pylist():
                if not text or not _ANCHOR.search(text):
                    continue
                found = base_spans(text)
                for a, b in windows(text):
                    if b - a > 20 * WINDOW_TOKENS or sum(1 for _ in _TOKEN.finditer(text, a, b)) > WINDOW_TOKENS:
                        continue
                    before, after = text.rfind(" ", 0, max(0, a - 1)) + 1, text.find(" ", b + 1)
                    before, after = max(before, a - 20), min(after if after >= 0 else len(text), b + 20)
                    piece = text[before:after]
                    inside = [(s - before, k, e - before) for s, k, e in found if a <= s and e <= b]
                    best[bool(inside)][hashlib.md5(piece.encode()).hexdigest()] = (
                        piece, ";".join(f"{s},{k},{e}" for s, k, e in inside))
            for half in best:
                for h in sorted(half)[keep:]:
                    del half[h]
        rows = [(h, *half[h]) for half in best for h in half]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)],
                                         names=["h", "text", "spans"])
    return run


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Model from at most ``sample`` windows of the corpus, those of smallest
    hash (equal windows count once), half of them with base spans."""
    configure(docs.sparkSession)
    # At most ``sample`` rows per task.
    found = materialize(docs.select(docs[text_col].alias("text")).mapInArrow(
        _sample_windows(sample // 2), "h string, text string, spans string"), "windows").distinct()
    rows = []
    for half in (F.col("spans") != "", F.col("spans") == ""):
        rows += found.where(half).orderBy("h").limit(sample // 2).collect()
    return fit([(r["text"], [tuple(map(int, s.split(","))) for s in r["spans"].split(";") if s])
                for r in rows])


# ---- whole texts ------------------------------------------------------------------

def find(text: str, model: Model | None) -> tuple[list, list]:
    """(base spans, all spans) of a text, as ``(start, kind, end)``."""
    base = base_spans(text)
    if model is None:
        return base, base
    # The model adds what touches no base span.
    added = []
    for a, kind, b in model.spans(text):
        if not any(s < b and a < e for s, _, e in base):
            added.append((a, kind, b))
    return base, sorted(base + added)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, model: Model | None, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans."""
    def run(batches):
        empty = hashlib.sha256(b"").hexdigest()
        for batch in blocks(batches):
            n = batch.num_rows
            count = np.zeros((n, len(KINDS)), np.int64)
            sha, spans = [empty] * n, [""] * n
            column = batch.column("text")
            hit = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False)
            for i in np.flatnonzero(hit.to_numpy(zero_copy_only=False)).tolist():
                base, found = find(column[i].as_py(), model)
                for _, k, _ in base:
                    count[i, k] += 1
                sha[i], spans[i] = hashlib.sha256(_written(base).encode()).hexdigest(), _written(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(count[:, k]) for k in range(len(KINDS))],
                 pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                names=[f.split()[0] for f in FOUND.split(", ")])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, FOUND).withColumnRenamed("id", id_col)


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_personal_data(docs, train(docs))


QUERIES = {"op6_personal_data": (op6_personal_data, None)}
