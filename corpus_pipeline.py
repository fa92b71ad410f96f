"""A training corpus from raw documents: reject toxic texts, drop near copies, mask live secrets, mix, pack.

Each stage works on all that its predecessor kept, written as Parquet in the shared folder in between.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kvflow.llm._store import drop, written
from kvflow.llm.mixing import mixed_documents
from kvflow.llm.packing import pack_documents
from kvflow.llm.secrets import redact_secrets
from kvflow.llm.simhash import simhash_dedup
from kvflow.llm.toxicity import reject_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the others come back unchanged. Null and empty texts score as texts without
    matches and stay, null ids and repeated rows are judged like any other, without labels of both kinds nothing goes."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (of several with that id, the least row hash).
    Null and empty texts are copies of each other; a text without a near copy stays whatever its id; rows with null ids
    stay."""
    return simhash_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific credentials are masked; every row stays. A null source is one owner, a null text stays null."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for: not at all, once or twice. Null and empty texts
    stay once, a null source is a source of its own, repeated rows are taken alike."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, with their token ids; a null or empty text is the end id alone. An empty
    table gives no rows here and in every stage before."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Learned scores, fingerprints and a tokeniser have no SQL form; tests/llm/test_pipeline.py holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            drop(*before)
            before = [docs]
    return docs
