"""Suppliers as bank directories, orders as questions to them; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import directories as op
from sparquill.sources.tables import table

LOADED = ["bic", "aba", "gb"]


def _sources(spark, d):
    s = table(spark, d, "supplier")
    status = F.when(F.col("s_suppkey") % 5 == 0, " Closed").when(F.col("s_suppkey") % 5 != 1, "active")
    letters = F.concat(F.lit("BANK"), F.element_at(F.array(*map(F.lit, ("US", "GB", "DE", "AU", "FR"))), (F.col("s_nationkey") % 5 + 1).cast("int")))
    bic = s.select(F.concat(F.lower(letters), F.lpad((F.col("s_suppkey") % 100).cast("string"), F.when(F.col("s_suppkey") % 11 == 0, 1).otherwise(2), F.lit("0"))).alias("BIC"), F.col("s_name").alias("name"), status.alias("Status"))
    aba = s.select(F.lpad((F.col("s_suppkey") * 37).cast("string"), 9, "0").alias("routing_number"), F.col("s_name").alias("bank_name"), status.alias("status"), F.date_add(F.lit("1992-01-01").cast("date"), (F.col("s_suppkey") % 1500).cast("int")).alias("valid_from"))
    gb = s.select(F.concat_ws("-", F.lit("20"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"), F.lit("77")).alias("code"), F.col("s_name").alias("bank_name"), status.alias("status"))
    return {"bic": (bic, {"bank_name": "name"}), "aba": (aba, None), "gb": (gb, None)}


def directory_rows(spark, d):
    return op.directory([op.normalised(rows, kind, names)[0] for kind, (rows, names) in _sources(spark, d).items()]).select("kind", "code", "bank_name", "country", "status")


def directory_rejects(spark, d):
    rows, names = _sources(spark, d)["bic"]
    return op.normalised(rows, "bic", names)[1].select("BIC", "name")


def routing_lookup(spark, d):
    held = op.directory([op.normalised(rows, kind, names)[0] for kind, (rows, names) in _sources(spark, d).items()])
    o, k = table(spark, d, "orders"), F.col("o_custkey")
    country = F.element_at(F.array(*map(F.lit, ("us", "GB", "DE", "AU", "FR"))), (k % 5 + 1).cast("int"))
    code = F.when(k % 7 == 0, "").when(k % 3 == 0, F.concat(F.lit("BANK"), F.upper(country), F.lpad((k % 100).cast("string"), 2, "0"), F.when(k % 2 == 0, "XXX").otherwise("")))
    code = code.when(k % 5 == 0, F.lpad((k * 37).cast("string"), 9, "0")).when(k % 5 == 1, F.concat_ws(" ", F.lit("20"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("77"))).otherwise(F.lpad(k.cast("string"), 6, "1"))
    asked = o.select(F.col("o_orderkey").alias("key"), F.when(k % 3 == 0, "bic").otherwise("nch").alias("kind"), code.alias("code"), country.alias("country"), F.col("o_orderdate").cast("date").alias("day"))
    return op.lookup(asked, held, LOADED).select("key", "exists", F.coalesce("message", F.lit("ok")).alias("message"), F.coalesce("bank_name", F.lit("")).alias("bank_name"))


_PAD = "lpad(CAST({} AS VARCHAR), {}, '{}')"
_DIR = f"""s AS (SELECT *, CASE WHEN s_suppkey % 5 = 0 THEN 'closed' ELSE 'active' END AS st, ['US', 'GB', 'DE', 'AU', 'FR'][s_nationkey % 5 + 1] AS c FROM supplier),
raw AS (SELECT 'bic' AS kind, 'BANK' || c || {_PAD.format('s_suppkey % 100', 2, '0')} AS code, s_name AS bank_name, c AS country, st AS status, NULL::DATE AS since FROM s WHERE s_suppkey % 11 <> 0
  UNION ALL SELECT 'aba', {_PAD.format('s_suppkey * 37', 9, '0')}, s_name, 'US', st, DATE '1992-01-01' + CAST(s_suppkey % 1500 AS INT) FROM s
  UNION ALL SELECT 'gb', '20' || {_PAD.format('s_suppkey % 100', 2, '0')} || '77', s_name, 'GB', st, NULL FROM s),
dir AS (SELECT kind, code, since, max(struct_pack(b := bank_name, c := country, s := status)) AS r FROM raw GROUP BY ALL)"""
_K = "['us', 'GB', 'DE', 'AU', 'FR'][o_custkey % 5 + 1]"
SQL = {
    "directory_rows": f"WITH {_DIR} SELECT kind, code, r.b AS bank_name, r.c AS country, r.s AS status FROM dir",
    "directory_rejects": f"WITH {_DIR} SELECT 'bank' || lower(c) || CAST(s_suppkey % 100 AS VARCHAR)[1:1] AS BIC, s_name AS name FROM s WHERE s_suppkey % 11 = 0",
    "routing_lookup": f"""WITH {_DIR}, a AS (SELECT o_orderkey AS key, o_custkey AS k, CASE WHEN o_custkey % 3 = 0 THEN 'bic' ELSE ['aba', 'gb', 'de', 'au', NULL][o_custkey % 5 + 1] END AS form, CAST(o_orderdate AS DATE) AS day,
  CASE WHEN o_custkey % 7 = 0 THEN '' WHEN o_custkey % 3 = 0 THEN 'BANK' || upper({_K}) || {_PAD.format('o_custkey % 100', 2, '0')} WHEN o_custkey % 5 = 0 THEN {_PAD.format('o_custkey * 37', 9, '0')} WHEN o_custkey % 5 = 1 THEN '20' || {_PAD.format('o_custkey % 100', 2, '0')} || '77' ELSE {_PAD.format('o_custkey', 6, '1')} END AS code FROM orders),
f AS (SELECT key, max(struct_pack(since := coalesce(since, DATE '0001-01-01'), s := r.s, b := r.b)) AS f FROM a JOIN dir ON dir.kind = form AND dir.code = a.code AND coalesce(since, day) <= day GROUP BY key),
g AS (SELECT a.*, f.f, CASE WHEN code = '' THEN 'empty' WHEN form IS NULL THEN 'no directory for the country' WHEN form = 'de' THEN 'format' WHEN form = 'aba' AND list_sum([CAST(code[i] AS INT) * [3, 7, 1][(i - 1) % 3 + 1] FOR i IN range(1, 10)]) % 10 <> 0 THEN 'checksum'
  WHEN form IN ('de', 'au') THEN 'not loaded' WHEN f IS NULL THEN 'unknown' WHEN f.s <> 'active' THEN 'inactive' END AS message FROM a LEFT JOIN f USING (key))
SELECT key, message IS NULL OR message IN ('no directory for the country', 'not loaded') AS exists, coalesce(message, 'ok') AS message, coalesce(f.b, '') AS bank_name FROM g""",
}

QUERIES = {f.__name__: f for f in (directory_rows, directory_rejects, routing_lookup)}
