"""Queries over nested JSON, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.functions import json as fn
from sparquill.sources.tables import table


def _orders(spark, d):
    o = table(spark, d, "orders")
    inner = F.struct(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("priority"))
    doc = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cust"), inner.alias("inner"), F.array(F.col("o_orderstatus"), F.lit("z")).alias("tags")))
    return o.select("o_orderkey", doc.alias("doc"))


def event_props(spark, d):
    leaves = fn.flatten(table(spark, d, "events"), "event_id", "props")
    return leaves.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("value").alias("different"))


def json_leaves(spark, d):
    return fn.flatten(_orders(spark, d), "o_orderkey", "doc").groupBy("path", "value").agg(F.count("*").alias("n"))


def json_metrics(spark, d):
    return fn.metrics(fn.flatten(_orders(spark, d), "o_orderkey", "doc"), "o_orderkey")


def json_find(spark, d):
    return fn.find_all(fn.flatten(_orders(spark, d), "o_orderkey", "doc"), "STATUS").groupBy("value").agg(F.count("*").alias("n"))


def json_lower_keys(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("Brand"), F.struct(F.col("p_type").alias("TYPE"), F.col("p_size").alias("Size")).alias("Inner"), F.col("p_name").alias("brand"))).alias("doc"))
    return fn.lower_keys(fn.flatten(p, "p_partkey", "doc"))


def json_changes(spark, d):
    o = table(spark, d, "orders")
    before = o.selectExpr("o_orderkey AS k", "inline(array(struct('a' AS path, o_orderstatus AS value), struct('b' AS path, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'x' END AS value)))")
    after = o.selectExpr("o_orderkey AS k", "inline(array(struct('a' AS path, CASE WHEN o_custkey % 5 = 0 THEN 'N' ELSE o_orderstatus END AS value), struct('b' AS path, 'x' AS value), struct('c' AS path, 'new' AS value)))")
    return fn.difference(before, after, "k").groupBy("path", "change").agg(F.count("*").alias("n"))


def state_fingerprints(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.array(F.concat(F.lit("f"), (F.col("c_custkey") % 3).cast("string")), F.lit("name")).alias("f"), F.array(F.concat(F.lit("m"), (F.col("c_custkey") % 2).cast("string"))).alias("m"))
    like = fn.similarity(F.col("f"), F.array(F.lit("f0"), F.lit("name")), F.col("m"), F.array(F.lit("m0")))
    return c.groupBy(fn.fingerprint(F.col("f"), F.col("m")).alias("fingerprint"), F.round(like, 6).alias("likeness")).agg(F.count("*").alias("n"))


def context_keys(spark, d):
    p = F.create_map(F.lit("dbt"), F.col("c_custkey") % 2 == 0, F.lit("bnf"), F.col("c_custkey") % 3 == 0)
    return table(spark, d, "customer").groupBy(fn.context_key(F.lit("SWF"), F.col("c_mktsegment"), p).alias("context")).agg(F.count("*").alias("n"))


O = "o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS p FROM orders)"
SQL = {
    "event_props": "SELECT 'k' AS path, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS different FROM events",
    "json_leaves": f"WITH {O}, l AS (SELECT unnest(['inner.status', 'inner.priority', 'tags[0]', 'tags[1]', 'cust']) AS path, unnest([s, p, s, 'z', c]) AS value FROM o) SELECT path, value, count(*) AS n FROM l GROUP BY ALL",
    "json_metrics": f"WITH {O} SELECT o_orderkey, 5 AS leaves, 2 AS depth, 1 AS arrays, CASE WHEN p = '' THEN 1 ELSE 0 END AS empty FROM o",
    "json_find": "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1",
    "json_lower_keys": "SELECT p_partkey, unnest(['brand', 'inner.type', 'inner.size']) AS path, unnest([p_name, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part",
    "json_changes": "SELECT 'a' AS path, 'changed' AS change, count(*) AS n FROM orders WHERE o_custkey % 5 = 0 AND o_orderstatus <> 'N' UNION ALL SELECT 'b', 'filled', count(*) FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'c', 'added', count(*) FROM orders",
    "state_fingerprints": "SELECT left(md5('f' || c_custkey % 3 || '|missing:m' || c_custkey % 2 || '|name'), 16) AS fingerprint, round(0.7 * CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 1 / 3 END + 0.3 * CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END, 6) AS likeness, count(*) AS n FROM customer GROUP BY 1, 2",
    "context_keys": "SELECT 'SWF|' || c_mktsegment || '|' || CASE WHEN c_custkey % 6 = 0 THEN 'bnf,dbt' WHEN c_custkey % 3 = 0 THEN 'bnf' WHEN c_custkey % 2 = 0 THEN 'dbt' ELSE 'none' END AS context, count(*) AS n FROM customer GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (event_props, json_leaves, json_metrics, json_find, json_lower_keys, json_changes, state_fingerprints, context_keys)}
