"""Continuous ingest: new files are parsed as they arrive, without state between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.kernels.model import Options
from quire.sources import pdf

SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (file_id, path, length, content) of the files that appear in a folder."""
    s = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_batch).load(folder)
    return s.select(F.xxhash64("path").alias("file_id"), "path", "length", "content")


def table(stream: DataFrame, name: str, options: Options | None = None) -> DataFrame:
    """One table of the stream; a map over rows, so it needs no watermark."""
    return pdf.parse(stream, name, options)


def follow(stream: DataFrame, out: str, checkpoint: str, options: Options | None = None, once: bool = False) -> StreamingQuery:
    """Append every table of each micro-batch under ``out/batch=N``; a repeated batch overwrites itself."""

    def write(batch: DataFrame, n: int) -> None:
        pdf.ingest(batch, f"{out}/batch={n}", options)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
