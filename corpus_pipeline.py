"""Corpus pipeline: from raw ``documents`` to token ids, in five stages.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and reread as the next
stage's ``docs``. All but the last return the columns of ``documents``:

1. ``quality_rules`` drops the documents that the quality rules reject;
2. ``line_dedup`` deletes later copies of repeated line runs from the texts,
   down to a run of a single line of one word, and the documents of which no
   line is left;
3. ``near_dedup`` keeps one document of each group of near duplicates, linked at
   80 percent of their shingles;
4. ``mix_sources`` repeats or leaves out documents to meet the target weights;
5. ``tokenize`` returns ``(doc_id, source, n_tokens, ids, round_trip)``, one row
   per document of the mix (a document taken twice has two rows).

``run(spark, sf_dir)`` applies them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm import line_dedup as lines
from tabscope.llm import mixing, near_dup, pieces, quality
from tabscope.session import configure, materialize, scratch_scope


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.drop_later_copies(docs, min_words=1)  # no floor: op2's 10 words are its oracle's
    n = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))  # texts may be shorter now
    return out.withColumn("n_chars", n)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def tokenize(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    from public_tokenizers import path
    out = pieces.encode_documents(docs, path("piece_bpe_32k.model"), carry=["doc_id", "source"])
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"),
                      "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: None: stages 1 and 5 train a classifier and run a tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark):  # a stage's own tables go once its result is written
            docs = materialize(stage(spark, docs, sf_dir), name.replace("_", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
