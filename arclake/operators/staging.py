"""Tables that a plan reads several times, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only where Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="arclake-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back, so that what made it runs once and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/arclake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def to_release(path: str) -> str:
    """A folder below the shared one that is deleted with the staged tables."""
    _STAGED.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete every staged table; call it once the results that read them are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)
