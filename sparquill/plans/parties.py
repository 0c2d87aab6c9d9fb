"""Lines of orders as occurrences of their parties; with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import parties as op
from sparquill.sources.tables import table


def merged_parties(spark, d):
    n = F.col("l_partkey")
    account = F.when(n % 4 == 0, F.concat(F.lit("DE89 3704 0044 0532 0130 0"), (n % 2).cast("string"))).when(n % 4 == 1, F.concat(F.lit("ACC-"), n.cast("string"))).when(n % 8 == 2, "gb82west12345698765432")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("role"), (F.col("l_linenumber") * 1000000 + n).alias("place"), account.alias("account"), F.when(n % 3 == 0, F.concat(F.lit("P"), n.cast("string"))).alias("name"), F.when(n % 5 == 0, "DE").alias("country"))
    return op.merged(lines, ["l_orderkey", "role"], "place", "account", ["name"], ["country"])


SQL = {
    "merged_parties": """WITH l AS (SELECT l_orderkey, l_returnflag AS role, l_linenumber * 1000000 + l_partkey AS place, CASE WHEN l_partkey % 4 = 0 THEN 'DE89 3704 0044 0532 0130 0' || l_partkey % 2 WHEN l_partkey % 4 = 1 THEN 'ACC-' || l_partkey WHEN l_partkey % 8 = 2 THEN 'gb82west12345698765432' END AS account,
  CASE WHEN l_partkey % 3 = 0 THEN 'P' || l_partkey END AS name, CASE WHEN l_partkey % 5 = 0 THEN 'DE' END AS country FROM lineitem),
g AS (SELECT l_orderkey, role, count(*) AS occurrences, (list(name ORDER BY place))[1] AS name, (list(country ORDER BY place) FILTER (country IS NOT NULL))[1] AS country, (list(account ORDER BY place))[1] AS a, (list(account ORDER BY place) FILTER (account NOT LIKE 'ACC%'))[1] AS i FROM l GROUP BY ALL)
SELECT l_orderkey, role, occurrences, name, country, coalesce(i, a) AS account, CASE WHEN i IS NOT NULL THEN 'IBAN' WHEN a IS NOT NULL THEN 'OTHER' END AS account_type, coalesce(i IN ('gb82west12345698765432', 'DE89 3704 0044 0532 0130 00'), false) AS iban_valid, upper(left(i, 2)) AS iban_country, coalesce(contains(i, ' '), false) AS needs_formatting FROM g""",
}

QUERIES = {"merged_parties": merged_parties}
