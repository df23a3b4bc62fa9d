"""A corpus pipeline of five stages; each reads what the one before has written.

Every stage takes a table with doc_id and text and whatever other columns, whole texts of any length, and rows with a
null in any column; an empty table gives an empty table. Ids play no part in what happens to a text, but for which of
several near copies stays. Columns that are named like an operator's results pass through as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from doctree.llm import bpe, decontaminate, jaccard, pii, quality
from doctree.llm.shared import set_aside, shared_dir
from doctree.sources.scratch import delete, scope


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled documents, does not reject.

    Null and empty texts have no words and get the model's bias, so they stay or go together; equal rows have equal
    scores. Without labels every score is one half, and every document goes.
    """
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(given, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs, restored = set_aside(docs, "score")
    return restored(quality.score(docs, model).filter(F.col("score") >= quality.THRESHOLD))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles with a similarity of 0.8 or more.

    The smallest doc_id of a group stays, then the smallest text hash; null ids come last. Of equal rows one stays.
    Null and empty texts are copies of nothing: all of them stay.
    """
    return jaccard.keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark. Null and empty texts stay, equal rows share their fate, an empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. All rows stay; texts without any, null and empty ones too, are as they were."""
    return pii.mask(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: digests of its token ids and of the bytes that they decode to.

    All other columns end here. Null texts count as empty: no tokens. Equal rows stay, each with its own result.
    """
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("tokens", encode_tokens),
]

#: The quality classifier and context bootstrapping are beyond SQL; tests compare the pipeline with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, a written table. What the stages before it have written is deleted as soon as the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
