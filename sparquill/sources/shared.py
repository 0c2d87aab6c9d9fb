"""Intermediate tables in the folder that a cluster's machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where that is unset (a local session, as in tests) a temporary folder takes its place.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    held = tempfile.TemporaryDirectory(prefix="sparquill-")
    atexit.register(held.cleanup)
    spark.conf.set("spark.checkpoint.dir", f"file://{held.name}")
    return f"file://{held.name}"


def stored(df: DataFrame, *by: str, codec: str | None = None) -> DataFrame:
    """df written once to the shared folder, in folders by the columns named, and read back: cut lineage that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a frame from stored() that no later step reads."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
