"""Readers and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt by columns to three tasks for each core. A small, well packed file is one task, however much is made of its rows; call this before they grow."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, *by)


#: File type by extension.
FILE_TYPES = {"pdf": "pdf", "tal": "code", "cbl": "code", "cob": "code", "sql": "code", "py": "code", "java": "code", "c": "code", "h": "code", "js": "code", "txt": "text", "md": "text", "log": "text", "csv": "text", "json": "config", "yaml": "config", "yml": "config", "ini": "config", "xml": "markup", "html": "markup"}


def file_type(path: Column) -> Column:
    """The type that a file's extension names, in any case; else unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, ext), F.lit("unknown"))


def files(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, file_type, length, text) of all files below a folder; invalid UTF-8 is read as Latin-1."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    if extensions:
        found = found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    body = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(body), body).otherwise(F.decode("content", "ISO-8859-1"))
    return found.select("path", file_type(F.col("path")).alias("file_type"), "length", text.alias("text"))


def payment_messages(spark: SparkSession, folder: str) -> DataFrame:
    """(txn_id, message) of JSON files that map transaction ids to their request and response."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    one = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("txn_id", "body"))
    return one.select("txn_id", F.try_parse_json("body").alias("message"))


def paired_files(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Inner join of two files() frames on the file name without its extension: (stem, request, response)."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    a = requests.select(stem.alias("stem"), F.col("text").alias("request"))
    return a.join(responses.select(stem.alias("stem"), F.col("text").alias("response")), "stem")


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph file with nodes and edges or entities and relationships; edge ends may be objects or named *_id."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    get = lambda c, p, t="string": F.try_variant_get(c, p, t)
    either = lambda a, b: F.coalesce(F.try_variant_get("v", a, "array<variant>"), F.try_variant_get("v", b, "array<variant>"))
    n = doc.select(F.explode(either("$.nodes", "$.entities")).alias("n"))
    nodes = n.select(*[get("n", f"$.{k}").alias(k) for k in ("id", "type", "name", "qualified_name", "file_path", "language")])
    e = doc.select(F.explode(either("$.edges", "$.relationships")).alias("e"))
    ends = [F.coalesce(get("e", f"$.{k}.id"), get("e", f"$.{k}"), get("e", f"$.{k}_id")).alias(k) for k in ("source", "target")]
    edges = e.select(*ends, get("e", "$.type").alias("type"), F.coalesce(get("e", "$.weight", "double"), F.lit(1.0)).alias("weight"))
    return nodes, edges


def write_csv(df: DataFrame, path: str) -> None:
    """A report: for results of a size that one file holds."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_index(postings: DataFrame, path: str, buckets: int = 16) -> None:
    """Postings by hash bucket of the term, so that a lookup reads one bucket."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
    postings.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_terms(spark: SparkSession, path: str, terms: list[str], buckets: int = 16) -> DataFrame:
    """The postings of some terms from write_index: prunes to their buckets and row groups."""
    index = spark.read.parquet(path)
    wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets))).distinct().collect()]
    return index.where(F.col("bucket").isin(wanted) & F.col("term").isin(terms)).drop("bucket")
