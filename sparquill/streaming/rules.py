"""Rules over a stream of files: the batch rules are stateless, so they run unchanged on a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparquill.operators import rules


def party_stream(spark: SparkSession, folder: str, schema: str, files_each: int = 16) -> DataFrame:
    """Party rows from JSON-lines files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(folder)


def write_repairs(parties: DataFrame, keys: list[str], out: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """Repair codes of a party stream, appended to Parquet exactly once; `available` stops at what has arrived."""
    found = rules.repair_codes(parties, keys)
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available else writer).start()
