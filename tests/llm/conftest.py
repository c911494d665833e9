from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Makes documents from texts; extra columns clash with what the operators name."""

    def make(texts, ids=None, sources=None, extra=()):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["a"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in zip(ids, texts, sources, strict=True)]
        df = spark.createDataFrame(rows, DOCS)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
        return df

    return make
