"""A corpus pipeline of five stages over ``documents``.

Each stage reads what the one before kept, written as Parquet in the shared
folder.  All but the last return the columns of ``documents``, whatever they are
called.  Rows that repeat an id, or have none, are documents of their own; texts of any
length are read whole; an empty table gives no rows in every stage.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rarelabel.functions.ranking import remove_path, scratch_path  # noqa: E402
from rarelabel.llm import exact_dedup, minhash, mixing, packing, toxicity  # noqa: E402
from rarelabel.llm.common import numbered, without  # noqa: E402

#: The classifier of the first stage and the tokenizer of the last cannot be stated in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the limit of rejection.

    Null and empty texts score as texts without evidence.  Without labels of both
    kinds all texts score alike, so all go if every label is toxic and else none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    counted, number = numbered(docs)
    return without(counted, number, toxicity.toxicity(counted, counted, labels, number).where("predicted = 1").select("row"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z case, the row with the largest id.

    Null and empty texts are equal; a null id is smaller than any; of rows that repeat
    the largest id one stays.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 on five-word shingles, the row with the smallest id.

    Texts without words are linked with nothing and stay; a null id is larger than
    any; of rows that repeat the smallest id one stays.
    """
    return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it.

    A null source is a source of its own.  Documents without words are taken as often
    as others of their source, and not at all if their source has no words.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    A null or empty text is the closing id alone, a piece of length 1.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
