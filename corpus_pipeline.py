"""A training corpus from ``documents``: classify, dedup, decontaminate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared checkpoint folder and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scholia.llm import classifier, decontam, mixture, packing, simhash
from scholia.llm.common import delete, ensure_checkpoint_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from this stage's own input.

    Null and empty texts are scored like any other; repeated rows share a score;
    a row without a label, or with a null id, is scored and not learnt from.
    """
    return classifier.accepted(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    The least id stays, null last; texts without words, null ones included, are
    one group; of rows alike in id and words, one stays.
    """
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no 10-word window with the benchmark.

    Null and word-less texts stay; an empty benchmark removes nothing.
    """
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mixture takes them.

    A null source is a source of its own; a source without any word gives no
    rows; of rows alike in id and text, any may be the ones taken once less.
    """
    return mixture.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids; a null text counts as empty, and an empty one as a piece of no tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", pack),
]

#: Training and hashing with seeds have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows, read from its own table.

    A stage's table is deleted when the next one is written; the last one stays.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
