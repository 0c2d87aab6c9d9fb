"""Line dedup by levelled sorted runs of line hashes.

Lines come in batches. A batch's hashes, counted and sorted, are merge-joined with the runs there are: those that
no run has become the batch's own run, the others are noted as seen again with what the run knows of them. When a
level has `fan` runs they are merged into one of the next level. A run is a bucketed, sorted table, so that runs
are neither shuffled for a merge nor held in memory; a hash is new in exactly one of them. A line that half the
documents hold is one row per batch there, as counting combines it before the shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.llm.common import LOWER, UPPER, content_key, forget, fresh, lower_ascii, read, row_key, shared_dir, spread_join, stored, text_of

LEAST_CHARS, LEAST_DOCS = 40, 5
BATCHES, FAN = 8, 4
BLANK = "\t\n\x0b\x0c\r "
ADDED = ["n_lines", "n_dropped", "kept_text"]


def line_key(line: Column) -> Column:
    """What makes lines equal: ASCII white space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """key (of the row), doc_id and hash: each distinct line of each row whose key has least_chars code points or more."""
    keys = F.transform(F.split(text_of(), "\n", -1), line_key)
    hashes = F.array_distinct(F.transform(F.filter(keys, lambda k: F.length(k) >= least_chars), F.md5))
    return docs.select(content_key().alias("key"), "doc_id", hashes.alias("hashes")).select("key", "doc_id", F.explode("hashes").alias("hash"))


class Runs:
    """Runs of (hash, n, top, first, seen): n rows of a batch hold the hash, the largest doc_id among these and all
    earlier ones is top. seen is false where the hash was new; else first is the n of the run in which it was."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan, self.buckets = spark, fan, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{self.spark.sparkContext.applicationId}-{name}"
        rows.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        files = self.spark.table(name)
        forget(files)
        self.spark.sql(f"DROP TABLE {name}")

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """A batch of line_hashes(): what the runs don't have becomes a run, what they have is marked as seen."""
        own = lines.groupBy("hash").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).withColumn("known", F.lit(None).cast("struct<n:bigint,top:bigint>"))
        for name in self.names():
            run = self.spark.table(name).where("NOT seen").select("hash", F.struct("n", "top").alias("held"))
            own = own.join(run, "hash", "left").withColumn("known", F.coalesce("known", "held")).drop("held")
        seen = F.col("known").isNotNull()
        own = own.select("hash", "n", F.greatest("top", "known.top").alias("top"), F.when(seen, F.col("known.n")).otherwise(0).alias("first"), seen.alias("seen"))
        self.levels[0].append(self._write(own))
        self._compact()

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fan:
                continue
            merged = reduce(DataFrame.unionAll, [self.spark.table(name) for name in self.levels[k]]).repartition(self.buckets, "hash")
            merged = merged.groupBy("hash", "seen").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.max("first").alias("first")).select("hash", "n", "top", "first", "seen")
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(merged))
            for name in self.levels[k]:
                self._drop(name)
            self.levels[k] = []

    def frequent(self, least_docs: int) -> DataFrame:
        """(hash, docs, top) of the hashes that least_docs rows or more hold. Hashes met in one batch only, by fewer rows, are not looked at again."""
        rows = self.spark.createDataFrame([], "hash string, n long, top long, first long, seen boolean")
        rows = reduce(DataFrame.unionByName, [self.spark.table(name) for name in self.names()], rows)
        seen = F.col("seen")
        rows = rows.where(seen | (F.col("n") >= least_docs)).select("hash", "top", F.when(seen, F.col("n")).otherwise(0).alias("n"), F.when(seen, F.col("first")).otherwise(F.col("n")).alias("first"))
        return rows.groupBy("hash").agg((F.max("first") + F.sum("n")).alias("docs"), F.max("top").alias("top")).where(F.col("docs") >= least_docs)

    def close(self) -> None:
        for name in self.names():
            self._drop(name)
        self.levels = [[]]


def frequent_lines(lines: DataFrame, least_docs: int = LEAST_DOCS, fan: int = FAN) -> DataFrame:
    """(hash, docs, top) of the lines (key, doc_id, hash, batch) that least_docs rows or more hold, by runs."""
    runs = Runs(lines.sparkSession, fan)
    for (batch,) in lines.select("batch").distinct().orderBy("batch").collect():
        runs.add(lines.where(F.col("batch") == batch))
    found = stored(runs.frequent(least_docs))
    runs.close()
    return found


@F.arrow_udf(T.StructType().add("kept_text", T.StringType()).add("n_dropped", T.LongType()))
def _without(texts: pa.Array, drops: pa.Array) -> pa.Array:
    lower = str.maketrans(UPPER, LOWER)
    kept, dropped = [], []
    for text, gone in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
        if text is None:
            kept.append(None)
            dropped.append(0)
            continue
        gone = set(gone)
        lines = text.split("\n")
        stay = [line for line in lines if hashlib.md5((s.lower() if (s := line.strip(BLANK)).isascii() else s.translate(lower)).encode()).hexdigest() not in gone]
        kept.append("\n".join(stay))
        dropped.append(len(lines) - len(stay))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(dropped, pa.int64())], ["kept_text", "n_dropped"])


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """docs (doc_id long, text, any other columns) with n_lines, n_dropped and kept_text.

    Each row is a document, those with repeated ids too. A line whose key at least least_docs rows hold stays only in
    the rows with the largest doc_id that holds it, all its places there; null ids count as the smallest, and where
    all are null all stay. A null or empty text is one empty line. Columns of docs that are named as the added ones
    are replaced. An empty table gives an empty result. Batches are the input's partitions, dealt in turn.
    """
    docs = docs.drop(*ADDED)
    key, copies, gone, salt, made = fresh(docs, "key", "copies", "gone", "row", "made")
    lines = stored(line_hashes(docs, least_chars).withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(batches))), "batch")
    frequent = frequent_lines(lines, least_docs, fan)
    total = lines.count()
    met = spread_join(lines.select("key", "doc_id", "hash"), frequent, "hash", "docs", "key", total).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    lost = met.groupBy("key").agg(F.collect_set("hash").alias(gone), F.count("*").alias(copies))
    lost = stored(lost.select(F.col("key").alias(key), gone, F.expr(f"`{copies}` div size(`{gone}`)").alias(copies)))
    rows = docs.withColumn(key, content_key()).withColumn(salt, row_key())
    out = spread_join(rows, lost, key, copies, salt, lost.agg(F.sum(copies)).first()[0] or 0, outer=True)
    text = text_of()
    out = out.withColumn(made, _without(F.when(F.col(gone).isNotNull(), text), F.col(gone)))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return out.select(*docs.columns, n_lines.alias("n_lines"), F.coalesce(F.col(made)["n_dropped"], F.lit(0)).alias("n_dropped"), F.coalesce(F.col(made)["kept_text"], text).alias("kept_text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.top AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
