"""Mining and evaluation queries over orders, line items and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import mining as op
from sparquill.sources.tables import table


def _codes(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS txn", "l_returnflag || l_linestatus || l_linenumber AS code", "CASE WHEN l_discount > 0.05 THEN 'E' WHEN l_discount > 0.02 THEN 'W' ELSE 'I' END AS severity")


def _flags(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS txn", "stack(3, 'urgent', o_orderpriority < '3', 'open', o_orderstatus = 'O', 'any', true) AS (feature, value)")


C = "c AS (SELECT DISTINCT l_orderkey AS txn, l_returnflag || l_linestatus || l_linenumber AS code FROM lineitem)"
FL = "f AS (SELECT o_orderkey AS txn, unnest(['urgent', 'open', 'any']) AS feature, unnest([o_orderpriority < '3', o_orderstatus = 'O', true]) AS value FROM orders)"
PAIRS = "pr AS (SELECT a.code AS code1, b.code AS code2, count(*) AS n FROM c a JOIN c b ON a.txn = b.txn AND a.code < b.code GROUP BY 1, 2)"


def code_pairs(spark, d):
    return op.co_occurrence(_codes(spark, d))


def code_exclusions(spark, d):
    return op.exclusions(_codes(spark, d), 10, 0.05)


def code_preconditions(spark, d):
    return op.preconditions(_flags(spark, d), _codes(spark, d), 0.3)


def code_implications(spark, d):
    always = table(spark, d, "orders").selectExpr("o_orderkey AS txn", "explode(array('all', 'S' || o_orderstatus)) AS code")
    return op.implications(always, _flags(spark, d))


def code_severities(spark, d):
    return op.code_statistics(_codes(spark, d), ["E", "W", "I"])


def ace_lookup(spark, d):
    rows = table(spark, d, "orders").selectExpr("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status", "o_orderpriority AS priority", "o_custkey")
    return op.lookup_table(rows, ["status", "priority"], "o_custkey")


def learned_values(spark, d):
    return op.learned_lookup(table(spark, d, "orders").selectExpr("o_custkey", "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS v", "o_orderkey"), "o_custkey", "v", "o_orderkey")


def bank_directory(spark, d):
    return op.clean_directory(table(spark, d, "customer").selectExpr("c_nationkey AS country", "c_mktsegment AS bank", "c_acctbal < 9000 AS has_error"))


def class_weights(spark, d):
    return op.class_weights(table(spark, d, "orders").selectExpr("o_orderpriority AS label"))


def label_encoding(spark, d):
    return op.label_encoding(_codes(spark, d).selectExpr("code AS label"), 1000)


def frequency_encoding(spark, d):
    return op.frequency_encoding(table(spark, d, "customer"), "c_mktsegment")


def downsampling(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus = 'P' AND o_orderkey % 10 = 0 AS positive")
    return op.downsampled(rows, "positive", 2, "o_orderkey").groupBy("positive").agg(F.count("*").alias("n"))


def confusion(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderpriority AS label", "o_totalprice > 200000 AS truth", "o_orderkey % 3 = 0 AS predicted")
    return op.confusion(rows)


def _scores(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS txn", "stack(3, 'A', o_orderkey % 10 / 10D, 'A_B', o_custkey % 10 / 10D, 'C', (o_orderkey + o_custkey) % 10 / 10D) AS (code, p)")


def boosted_scores(spark, d):
    pairs = spark.createDataFrame([("A", "C", 5), ("A_B", "C", 50)], "code1 string, code2 string, n int")
    return op.boosted(_scores(spark, d), pairs).groupBy("code", "p").agg(F.count("*").alias("n"))


def thresholded_scores(spark, d):
    t = spark.createDataFrame([("A", 0.8), ("C", 0.2)], "code string, threshold double")
    return op.thresholded(_scores(spark, d), t, 0.5).groupBy("code").agg(F.count("*").alias("n"), F.round(F.min("p"), 6).alias("least"))


def amount_buckets(spark, d):
    return table(spark, d, "orders").groupBy(op.amount_bucket(F.col("o_totalprice")).alias("bucket")).agg(F.count("*").alias("n"))


def folds(spark, d):
    return op.stratified_folds(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 5).groupBy("o_orderpriority", "fold").agg(F.count("*").alias("n"))


S = "s AS (SELECT o_orderkey AS txn, unnest(['A', 'A_B', 'C']) AS code, unnest([o_orderkey % 10 / 10, o_custkey % 10 / 10, (o_orderkey + o_custkey) % 10 / 10]) AS p FROM orders)"
SQL = {
    "code_pairs": f"WITH {C}, {PAIRS} SELECT * FROM pr",
    "code_exclusions": f"WITH {C}, {PAIRS}, q AS (SELECT code, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 10), j AS (SELECT a.code AS code1, b.code AS code2, a.n AS n1, b.n AS n2, coalesce(pr.n, 0) AS both_n FROM q a JOIN q b ON a.code < b.code LEFT JOIN pr ON pr.code1 = a.code AND pr.code2 = b.code) SELECT code1, code2, n1, n2, both_n AS \"both\", round(both_n / least(n1, n2), 4) AS ratio, CASE WHEN both_n = 0 THEN 'high' WHEN both_n / least(n1, n2) < 0.02 THEN 'medium' ELSE 'low' END AS confidence FROM j WHERE both_n / least(n1, n2) <= 0.05",
    "code_preconditions": f"WITH {C}, {FL} SELECT code, feature, round(avg(CAST(value AS INT)), 6) AS share, count(*) AS n FROM c JOIN f USING (txn) GROUP BY 1, 2 HAVING avg(CAST(value AS INT)) >= 0.3 AND count(*) >= 10",
    "code_implications": f"WITH {FL}, a AS (SELECT DISTINCT o_orderkey AS txn, unnest(['all', 'S' || o_orderstatus]) AS code FROM orders), t AS (SELECT feature, count(*) AS t FROM f WHERE value GROUP BY 1) SELECT feature, code, count(*) AS n FROM f JOIN a USING (txn) JOIN t USING (feature) WHERE value GROUP BY 1, 2 HAVING count(*) = any_value(t) AND count(*) >= 3",
    "code_severities": "WITH x AS (SELECT l_returnflag || l_linestatus || l_linenumber AS code, CASE WHEN l_discount > 0.05 THEN 'E' WHEN l_discount > 0.02 THEN 'W' ELSE 'I' END AS s FROM lineitem) SELECT code, count(*) FILTER (s = 'E') AS E, count(*) FILTER (s = 'W') AS W, count(*) FILTER (s = 'I') AS I, count(*) AS total, round(count(*) * 100 / sum(count(*)) OVER (), 4) AS percent FROM x GROUP BY 1",
    "ace_lookup": "SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status, o_orderpriority AS priority, count(*) AS occurrences, count(DISTINCT o_custkey) AS ids FROM orders GROUP BY 1, 2",
    "learned_values": "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS value, count(DISTINCT o_orderpriority) AS variants FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    "bank_directory": "SELECT c_nationkey AS country, c_mktsegment AS bank, count(*) AS n, bool_or(c_acctbal >= 9000) AS known FROM customer GROUP BY 1, 2",
    "class_weights": "WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS k FROM c), r AS (SELECT label, n, least((t - n) / n, 10.0) AS a, least(t / (k * (n + 1)), 10.0) AS b, 1 / (n / t + 0.01) AS w FROM c, t) SELECT label, n, round(a, 6) AS ratio, round(b, 6) AS balanced, round(w / sum(w) OVER (), 6) AS inverse FROM r",
    "label_encoding": "WITH c AS (SELECT l_returnflag || l_linestatus || l_linenumber AS label, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT CASE WHEN n >= 1000 THEN label ELSE '__RARE__' END AS label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1) SELECT label, n, row_number() OVER (ORDER BY label) - 1 AS number FROM m",
    "frequency_encoding": "SELECT c_mktsegment, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1",
    "downsampling": "WITH x AS (SELECT o_orderstatus = 'P' AND o_orderkey % 10 = 0 AS positive, count(*) AS n FROM orders GROUP BY 1) SELECT positive, CASE WHEN positive THEN n ELSE least(n, 2 * (SELECT n FROM x WHERE positive)) END AS n FROM x",
    "confusion": """WITH x AS (SELECT o_orderpriority AS label, o_totalprice > 200000 AS t, o_orderkey % 3 = 0 AS p FROM orders), c AS (SELECT label, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM x GROUP BY 1)
      SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""",
    "boosted_scores": f"WITH {S}, b AS (SELECT txn, coalesce(sum(CASE code WHEN 'A' THEN 0.05 WHEN 'A_B' THEN 0.1 END) FILTER (p > 0.7 AND code <> 'C'), 0) AS up, coalesce(max(p) FILTER (code = 'C'), 0) AS pc FROM s GROUP BY 1) SELECT code, CAST(round(least(1.0, CASE code WHEN 'C' THEN p + up WHEN 'A' THEN p + CASE WHEN pc > 0.7 THEN 0.05 ELSE 0 END ELSE p + CASE WHEN pc > 0.7 THEN 0.1 ELSE 0 END END), 6) AS DOUBLE) AS p, count(*) AS n FROM s JOIN b USING (txn) GROUP BY 1, 2",
    "thresholded_scores": f"WITH {S} SELECT code, count(*) AS n, round(min(p), 6) AS least FROM s WHERE p >= CASE code WHEN 'C' THEN 0.2 ELSE 0.8 END GROUP BY 1",
    "amount_buckets": "SELECT CASE WHEN o_totalprice <= 0 THEN 0 WHEN o_totalprice <= 1000 THEN 1 WHEN o_totalprice <= 10000 THEN 2 WHEN o_totalprice <= 100000 THEN 3 WHEN o_totalprice <= 1000000 THEN 4 ELSE 5 END AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "folds": "WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, unnest(range(5)) AS fold, unnest(list_transform(range(5), lambda k: (n - k + 4) // 5)) AS n FROM c",
}

QUERIES = {f.__name__: f for f in (
    code_pairs, code_exclusions, code_preconditions, code_implications, code_severities, ace_lookup, learned_values, bank_directory, class_weights, label_encoding, frequency_encoding, downsampling, confusion,
    boosted_scores, thresholded_scores, amount_buckets, folds,
)}
