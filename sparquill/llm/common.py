"""What the training-data operators share: shared storage, texts, words, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.sources.shared import forget, shared_dir, stored

__all__ = ["LOWER", "SPACE", "UPPER", "WORD", "content_key", "empty", "forget", "fresh", "lower_ascii", "read", "row_key", "shared_dir", "spread_join", "stored", "text_of", "words"]

#: ASCII white space, the only separators between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. In texts of ASCII alone that is what lower() does, many times faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def row_key() -> Column:
    """Tells rows apart that are equal in all columns; the same on a task's second attempt."""
    return F.monotonically_increasing_id()


def content_key() -> Column:
    """16 bytes for (doc_id, text). Rows that share them are the same row to any operator that reads these columns alone."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_of())))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for df that clash with none it has."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str, salt: str, total: int, hot: int = 10_000, outer: bool = False) -> DataFrame:
    """rows with the columns of table, which has one row for each key and the number n of the rows with that key.

    An inner equi-join that no frequent key makes lopsided: keys that over total / hot rows share are fewer than
    hot and broadcast, and their rows are dealt by the salt, a column of rows. total is the number of rows; n and
    all columns of table must not be among those of rows, but for the key. With outer, rows without a match stay.
    """
    others = [c for c in table.columns if c != key]
    found, mine, way = fresh(rows, "found", "mine", "way")
    value = F.struct(*others)
    often = F.col(n) > total / hot
    out = rows.join(F.broadcast(table.where(often).select(key, value.alias(found))), key, "left")
    out = out.withColumn(way, F.when(F.col(found).isNotNull(), F.pmod(F.xxhash64(salt), F.lit(1 << 20)) + 1).otherwise(F.lit(0)))
    # The way of the others is 0, but no literal, which would fold and leave the key alone to deal the rows by.
    out = out.join(table.where(~often).select(key, value.alias(mine), (F.col(n).cast("long") % 1).alias(way)), [key, way], "left")
    out = out.withColumn(found, F.coalesce(found, mine))
    out = out if outer else out.where(F.col(found).isNotNull())
    return out.select(*rows.columns, f"{found}.*")


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
