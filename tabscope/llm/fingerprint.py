"""Operator 3: document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (parts between ``\\n``). Each paragraph
hashes to a wide vector and a text's fingerprint is the sum of its paragraphs'
vectors, every lane modulo ``2**32``. Hence paragraph order does not matter,
equal texts have equal fingerprints, and a paragraph is inserted or deleted by
adding or subtracting its vector (:func:`combine`) without reading the rest.

Lanes of a vector:

* 8 lanes from the paragraph's SHA-256, for equality;
* 1 lane with its number of word pairs (the last word stands alone);
* 64 lanes of signs: each word pair adds a hashed ``+1`` or ``-1`` to one hashed
  lane, so the cosine of two texts' 64 sums estimates the cosine of their
  word-pair counts: :func:`likeness`.

Defined results: NULL text is the empty text (one empty paragraph); rows equal
in id and text are separate rows, neighbours in the order of ids; NULL ids come
first; ids that occur with several texts are ordered by the text's hash; an
empty table gives no rows; other columns of the table are never read.

Native: DataFrame operations only. Texts are exchanged once (by id and text
hash), the borrowed half of the next text once; words are aggregated in place,
after the join, without another exchange. The order of ids is a distributed
row number, not a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import row_index
from ..session import materialize

SPACES = r"[\x20\x09-\x0D]+"
WIDE, SIGN_BITS = 8, 6
LANES = WIDE + 1 + (1 << SIGN_BITS)
MOD = 1 << 32


def _hex_lanes(sha: Column, n: int) -> Column:
    """``n`` lanes of 32 bits from a hex digest."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(
        F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long"))


def _wide(paras: Column) -> Column:
    """Sum of the paragraphs' SHA-256 lanes."""
    return F.aggregate(paras, F.array_repeat(F.lit(0).cast("long"), WIDE), lambda acc, p: F.zip_with(
        acc, _hex_lanes(F.sha2(p, 256), WIDE), lambda x, y: (x + y).bitwiseAND(F.lit(MOD - 1))))


def _pairs(paras: Column) -> Column:
    """Hash (not negative) of every word and its successor in the paragraph."""
    top = F.lit((1 << 63) - 1)
    return F.flatten(F.transform(paras, lambda p: F.zip_with(
        F.split(p, SPACES, -1), F.slice(F.split(p, SPACES, -1), 2, 1 << 30),
        lambda x, y: F.xxhash64(x, y).bitwiseAND(top))))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str, digest: bool = False) -> DataFrame:
    """``(*keys, lanes array<bigint>)``: one fingerprint per distinct ``keys``
    row (with ``digest``, the text's SHA-256 as 8 more lanes). If the input is
    already partitioned by some of the keys, all is aggregated where it is: a
    text becomes a sparse vector, one sum per (text, lane) adds it up."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = _hex_lanes(F.sha2(text, 256), 8) if digest else F.array().cast("array<bigint>")
    para = texts.select(*keys, sha.alias("__sha"), F.split(text, "\n", -1).alias("__p"))
    para = para.select(*keys, "__sha", _wide(F.col("__p")).alias("__wide"), _pairs(F.col("__p")).alias("__g"))
    # A given lane value is a negative number that holds lane and value; every
    # lane is given once, so that each text has all of them.
    fixed = F.concat("__wide", F.array(F.size("__g").cast("long")),
                     F.array_repeat(F.lit(0).cast("long"), 1 << SIGN_BITS), "__sha")
    fixed = F.transform(fixed, lambda v, i: F.lit(-(1 << 63)) + F.shiftleft(i.cast("long"), 32) + v)
    rows = para.select(*keys, F.explode(F.concat(fixed, "__g")).alias("__x"))
    x, given = F.col("__x"), F.col("__x") < 0
    lane = F.when(given, F.shiftright(x, 32).bitwiseAND(F.lit(0xFFFF))).otherwise(
        F.lit(WIDE + 1) + F.shiftright(x, 63 - SIGN_BITS))
    value = F.when(given, x.bitwiseAND(F.lit(MOD - 1))).otherwise(
        F.lit(1) - 2 * x.bitwiseAND(F.lit(1)))
    sums = (rows.select(*keys, lane.cast("int").alias("__lane"), value.alias("__v"))
                .groupBy(*keys, "__lane").agg(F.sum("__v").alias("__v")))
    packed = F.shiftleft(F.col("__lane").cast("long"), 32) + F.col("__v").bitwiseAND(F.lit(MOD - 1))
    full = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(packed)).alias("__all"))
    return full.select(*keys, F.transform("__all", lambda x: x.bitwiseAND(F.lit(MOD - 1))).alias("lanes"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint after inserting (``sign=1``) or deleting (``-1``) ``b``."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(MOD - 1)))


def as_text(lanes: Column) -> Column:
    return F.concat_ws("", F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def _signs(lanes: Column) -> Column:
    half = F.lit(MOD >> 1)  # lanes are residues: those above half are negative
    return F.transform(F.slice(lanes, WIDE + 2, 1 << SIGN_BITS), lambda x: F.when(
        x >= half, x - F.lit(MOD)).otherwise(x).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two ``lanes`` columns: 1 for equal fingerprints, else the
    estimated cosine of the word-pair counts, not below 0."""
    sa, sb = _signs(a), _signs(b)
    norm = F.sqrt(_dot(sa, sa) * _dot(sb, sb))
    cos = F.when(norm > 0, _dot(sa, sb) / norm).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos)))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, and that of its edited text: the last
    ``floor(n_chars / 2)`` code points replaced by the first as many (or all) of
    the next document in ascending id order (after the last: the first)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    key = docs[id_col]
    # (id0, h) is a key without NULLs, so that plain equality joins on it.
    base = docs.select(key.alias("id"), F.coalesce(key, F.lit(0).cast(docs.schema[id_col].dataType)).alias("id0"),
                       F.xxhash64(text, key.isNull()).alias("h"), text.alias("text"))
    ids = row_index(base.select("id", "id0", "h", F.char_length("text").cast("long").alias("n")),
                    ["id", "h"], "i")
    ids = materialize(ids, "ids")
    total = ids.count()
    after = ids.select(F.pmod(F.col("i") - 1, F.lit(max(total, 1))).alias("i"),
                       F.col("id0").alias("next_id"), F.col("h").alias("next_h"))
    asked = materialize(ids.join(after, "i"), "asked")
    # Rows equal in id and text are one text here; ``asked`` has each of them.
    same = Window.partitionBy("id0", "h").orderBy("h")
    texts = base.drop("id").withColumn("k", F.row_number().over(same)).where("k = 1").drop("k")
    half = F.floor(F.col("n") / 2).cast("int")
    lent = asked.join(texts.select(F.col("id0").alias("next_id"), F.col("h").alias("next_h"),
                                   F.col("text").alias("next")), ["next_id", "next_h"])
    lent = lent.select("i", "id", "id0", "h", "n", F.left("next", half).alias("tail"))
    both = texts.join(lent, ["id0", "h"])
    edited = F.concat(F.left("text", (F.col("n") - half).cast("int")), F.col("tail"))
    keys = ["id0", "h", "i", "edited"]
    both = both.select("id0", "h", "i", "text", edited.alias("new")).select(
        "id0", "h", "i", F.explode(F.array(
            F.struct(F.lit(False).alias("edited"), F.col("text").alias("text")),
            F.struct(F.lit(True).alias("edited"), F.col("new").alias("text")))).alias("x"))
    prints = fingerprints(both.select("id0", "h", "i", "x.*"), keys, "text", digest=True)
    prints = materialize(prints.groupBy("id0", "h", "i").agg(
        F.max(F.when(~F.col("edited"), F.slice("lanes", 1, LANES))).alias("mine"),
        F.max(F.when(F.col("edited"), F.col("lanes"))).alias("other")), "fingerprints")
    prints = prints.join(ids.select("i", "id", "n"), "i").select(
        "i", "id", "n", "mine", F.slice("other", 1, LANES).alias("edited"),
        as_text(F.slice("other", LANES + 1, 8)).alias("edited_sha256"))
    following = prints.select(F.pmod(F.col("i") - 1, F.lit(max(total, 1))).alias("i"),
                              F.col("mine").alias("next"))
    return prints.join(following, "i").select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256",
        as_text(F.col("mine")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("edited")).alias("near_edited"),
        likeness(F.col("mine"), F.col("next")).alias("near_next"))


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_fingerprints": (op3_fingerprints, None)}
