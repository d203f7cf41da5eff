"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, and BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of documents: the quality stage drops what it rejects and the
lines that fail, the near-duplicate stage keeps one document of each class, the PII stage replaces personal data, the
mixing stage returns each document as often as the mix takes it, and the last stage encodes.

Null texts are rejected by the first stage, as are empty ones; an empty table passes through all stages.  Of texts that
are alike that of the smallest id stays, of equal ids that of the smallest hash, and rows that repeat id and text are
one; columns of any name are carried along.  Very long texts go through whole.  Each function's operator states the rest.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm import bpe, minhash, mixing, pii, quality
from motifloom.llm.shared import folder

#: Key of the surrogates; a production run passes a secret one.
KEY = "motifloom"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    judged = quality.judge(docs, keep=tuple(docs.columns), renamed=True)
    text = [F.col("clean_text").alias("text") if c == "text" else F.length("clean_text").cast("long").alias(c) if c == "n_chars" else F.col(f"kept_{c}").alias(c) for c in docs.columns]
    return judged.where("kept").select(*text)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs, KEY, chars_col="n_chars" if "n_chars" in docs.columns else None)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("encoding", encoding),
]

#: Near-duplicates, surrogates and BPE have no SQL form; a test compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{i}")
            docs = spark.read.parquet(f"{place}/{i}")
    return docs
