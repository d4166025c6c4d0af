"""Archives as they arrive: the same scans over a file stream.

``binaryFile`` streams new files of a folder; detection, entries and diagnostics are stateless, so they run unchanged
on it.  Dispositions per archive follow from the diagnostics of the same micro-batch, since an archive is one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arclake.sources import archive

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return stream.load(path).select("path", "content")


def index_stream(spark: SparkSession, path: str, target: str, checkpoint: str, glob: str = "*"):
    """Append the entries of arriving archives to a Parquet table, exactly once; ends when all that is there is read."""
    rows = archive.entries(arriving(spark, path, glob))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
