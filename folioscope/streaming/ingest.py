"""Files that arrive in a folder or a table, analysed once each by a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.sources import books

FILE = "path string, modificationTime timestamp, length long, content binary"


def inbox_files(spark: SparkSession, inbox: str) -> DataFrame:
    """A stream of the files of a folder."""
    return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).load(inbox)


def ingest(files: DataFrame, out: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame] | None = None, extract_pdf=None, at_once: int | None = None) -> StreamingQuery:
    """Start a stream that parses new .fb2 and .pdf files(path, content) into out/books and keeps bad ones in out/quarantine.

    A file that can't be parsed is quarantined and never read again; what fails beside it (a lost executor, a full
    disk) fails the batch, which is repeated when the stream is started anew. The checkpoint remembers what was read.
    Each batch writes partitions of its own, so a repeated batch replaces what it wrote before. out/status has a row
    for each file. The query ends when all files are read.
    """

    def batch(df: DataFrame, number: int) -> None:
        parsed = books.dispatched(df, extract_pdf).withColumn("batch", F.lit(number)).persist()
        good = parsed.where("_error is null").drop("_error")
        tables = {"books": analyse(good) if analyse else good, "quarantine": parsed.where("_error is not null").select("path", "_error", "batch"), "status": books.statuses(parsed).withColumn("batch", F.lit(number))}
        for name, rows in tables.items():
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")
        parsed.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
