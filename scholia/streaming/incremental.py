"""Judging files as they arrive.

An extension: each micro-batch of new files is checked on its own and appended to
a findings table. Files are judged alone, so there is no state to keep and a
batch that runs again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholia.operators.rules import run_rules
from scholia.sources.config import Config
from scholia.sources.extract import comments_of, functions_of, parsed

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """``FILES`` rows of files that appear under ``folder``."""
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return stream.select(F.lit(0).alias("file_ord"), "path", name.alias("rel"), "content")


def check_stream(files: DataFrame, output: str, checkpoint: str, cfg: Config | None = None, once: bool = False) -> StreamingQuery:
    """Appends findings of each batch to the Parquet table ``output``, under the number of the batch."""
    cfg = cfg or Config()

    def write(batch: DataFrame, number: int) -> None:
        table = parsed(batch, cfg.mark).persist()
        found = run_rules(comments_of(table), functions_of(table), cfg)
        found.write.mode("overwrite").parquet(f"{output}/batch={number}")  # a batch that runs again replaces itself
        table.unpersist()

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
