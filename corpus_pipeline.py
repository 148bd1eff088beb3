"""A corpus pipeline of five stages, each one operator of tramline.llm.

Stages take (spark, docs, sf_dir) and return a DataFrame; run() writes each result as Parquet
to the shared folder and reads it back as the next stage's docs.

Every stage keeps the columns of its docs, whatever further ones there are, but for the last one.
Empty tables give empty tables. Null and empty texts are dropped by the first stage; a later stage
by itself keeps them as they are (packing: one separator). Rows without an id stay where ids
decide. Of near copies the smallest id stays, of passages the first in order of id and place; rows
that share an id and are equal or near copies stay together. Texts are taken whole, of any length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import language, packing, secrets, simhash, spans
from tramline.llm._common import materialize


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay; texts without a letter, or like no known language, go."""
    return language.keep_known(docs, language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies stays."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that an earlier document has are cut."""
    return _counted(spans.cut_repeats(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _counted(secrets.redact(docs, secrets.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Hashing, training and tokenization have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
