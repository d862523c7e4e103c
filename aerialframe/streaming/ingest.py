"""Photos as they arrive (an extension: a survey tool reads a folder once, a stream reads what is new in it)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.photos import with_footprint
from ..sources.photos import GLOB, headers, parse

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each new photo of ``folder`` to the Parquet table ``table`` once, parsed and with its footprint."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).options(recursiveFileLookup=True, pathGlobFilter=GLOB).load(folder)
    rows = with_footprint(parse(headers(files.drop("content"))))
    writer = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
