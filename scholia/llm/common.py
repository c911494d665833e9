"""What the operators share: tables, materialising, word classes."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, for Java and Python patterns.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Maps A-Z to lower case and leaves every other byte, non-ASCII ones included.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the folder that the session names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; on a cluster
    a machine's own folder would be lost with the executor, so that is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(named)


def materialise(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes ``df`` once to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and, if it is told to clean them, the checkpoints that nothing refers to any more.

    Its cleaner follows the collection of garbage, which in a small driver may
    come late, while an iterative job goes on writing.
    """
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table of our own that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that cross to a Python worker at once.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> None:
    """Bounds what an Arrow function holds: Spark's default of 10,000 rows is much for whole texts.

    Spark also bounds a batch by bytes. A lower setting of the session stays. The
    plan is run after this returns, so the setting remains with the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary; ``folder`` or $TOKENIZER_DIR names another place."""
    return os.path.join(folder or os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]
