"""Text of PDF files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pageloom.sources import pdf


def files(spark: SparkSession, folder: str, at_once: int = 1000) -> DataFrame:
    """path and content of each new file; at most `at_once` files make a batch."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", at_once).option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")


def text_elements(spark: SparkSession, folder: str, out: str, checkpoint: str, password: str = "") -> StreamingQuery:
    """Appends the elements of all files not yet seen to Parquet, then stops; a rerun goes on from there."""
    rows = pdf.text_elements(files(spark, folder), "path", password)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
