"""Exact dedup by skew-safe combining.

Rows are combined three times, and each time the full normalised content is part of the key: within each
input partition (partial aggregation), then by (digest, content, salt), then the salts' winners by (digest,
content). However many copies a text has, one task gets at most one row of it from each other task. The rows then
look up their group's winner, where the copies of a frequent text are spread over tasks too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.llm.common import SPACE, fresh, read, row_key, spread_join, stored, text_of

SALTS = 16


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space. A single space needs no replacement."""
    return F.regexp_replace(text, rf"[\x09-\x0D]{SPACE[:-1]}*|\x20{SPACE}", " ")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digest, keep_id, group_size, n_texts, content.

    keep_id is the smallest doc_id (nulls count only where there is no other); n_texts the number of
    different texts with that digest. content is null unless that number is over one.
    """
    content = normalised(text_of())
    salted = docs.select("doc_id", content.alias("content"), digest(content).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    first = salted.groupBy("digest", "content", "salt").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Dealt by digest alone, the winners can be combined and the texts of a digest counted in one shuffle.
    whole = first.repartition("digest").groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    n_texts = F.count("*").over(Window.partitionBy("digest"))
    return whole.withColumn("n_texts", n_texts).withColumn("content", F.when(F.col("n_texts") > 1, F.col("content")))


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """docs (doc_id, text, any other columns) with keep_id, group_size, kept and digest.

    A null text equals the empty one. Of equal texts the row with the smallest doc_id stays; among rows that
    share that doc_id too, just one. A null doc_id stays only where its group has no other. Columns of docs
    that are named as the added ones are replaced, all others kept. An empty table gives an empty result.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "digest")
    content, key, rank = fresh(docs, "content", "row", "rank")
    found = stored(groups(docs, digest, salts))
    single = found.where("n_texts = 1").select("digest", "keep_id", "group_size")
    several = found.where("n_texts > 1").select("digest", F.col("content").alias(content), "keep_id", "group_size")
    text = normalised(text_of())
    rows = docs.withColumn(key, row_key()).withColumn("digest", digest(text))
    total = found.agg(F.sum("group_size")).first()[0] or 0
    out = spread_join(rows, single, "digest", "group_size", key, total)
    if not several.isEmpty():  # texts that only their full content tells apart
        out = out.unionByName(rows.withColumn(content, text).join(several, ["digest", content]).drop(content))
    candidate = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return out.withColumn("kept", candidate).drop(key)
    # Repeated ids: one of the rows that share the group's doc_id. All other rows are partitions of their own.
    twice = Window.partitionBy("digest", "keep_id", F.when(~candidate, F.col(key))).orderBy(key)
    out = out.withColumn(rank, F.row_number().over(twice))
    return out.withColumn("kept", candidate & (F.col(rank) == 1)).drop(rank, key)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' own columns."""
    return exact_duplicates(docs).where("kept").select(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(s) AS text_sha256
FROM t WINDOW w AS (PARTITION BY s)
"""
