"""What is learned from repairs and predictions, made from orders and line items, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import learning, messages
from sparquill.operators import mining as op
from sparquill.sources.tables import table

SCORED = "stack(3, 'A', o_custkey % 3 = 0, o_orderkey % 4 < 2, 'B', o_custkey % 5 < 2, o_custkey % 5 < 3, 'C', o_orderkey % 2 = 0, o_orderkey % 6 = 0) AS (label, truth, predicted)"
SCORED_SQL = "s AS (SELECT o_orderkey AS k, unnest(['A', 'B', 'C']) AS label, unnest([o_custkey % 3 = 0, o_custkey % 5 < 2, o_orderkey % 2 = 0]) AS truth, unnest([o_orderkey % 4 < 2, o_custkey % 5 < 3, o_orderkey % 6 = 0]) AS predicted FROM orders)"


def _scored(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS k", SCORED)


def summary_scores(spark, d):
    return op.summary_scores(op.confusion(_scored(spark, d)))


def set_scores(spark, d):
    return op.set_scores(_scored(spark, d), "k")


def ensemble_scores(spark, d):
    o = table(spark, d, "orders")
    first = o.selectExpr("o_orderkey AS txn", "'X' || o_custkey % 7 AS code", "o_orderkey % 100 / 100D AS p")
    second = o.selectExpr("o_orderkey AS txn", "'X' || o_custkey % 5 AS code", "o_custkey % 100 / 100D AS p")
    support = o.groupBy(F.concat(F.lit("X"), (F.col("o_custkey") % 7).cast("string")).alias("code")).agg((F.count("*") % 20).alias("n"))
    return op.ensemble(first, second, support)


def presence_profile(spark, d):
    p = table(spark, d, "part")
    fields = p.select(F.col("p_partkey").alias("txn"), F.explode(F.array(F.struct(F.lit("name").alias("field"), F.col("p_name").alias("value")), F.struct(F.lit("code").alias("field"), F.when(F.col("p_size") % 3 > 0, F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))).alias("value")))).alias("f")).select("txn", "f.field", "f.value").where("value IS NOT NULL")
    return op.presence_profile(fields, p.select(F.col("p_partkey").alias("txn"), F.col("p_brand").alias("context"))).withColumn("samples", F.array_join("samples", ","))


def applied_lookups(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 10 END AS bic", "o_custkey % 4 AS nch", "CAST(NULL AS STRING) AS name")
    by_nch = spark.range(0, 3).selectExpr("id AS key", "id * 2 AS value")
    by_bic = spark.range(0, 8).selectExpr("id AS key", "'bank ' || id AS value")
    return op.applied_lookups(o, [(by_nch, "nch", "bic"), (by_bic, "bic", "name")])


def _diffs(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS txn", "CASE l_linenumber % 3 WHEN 0 THEN 'cdtrAgt' WHEN 1 THEN 'dbtrAgt' ELSE 'bnfBnk' END AS entity", "CASE l_suppkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'dropped' ELSE 'edited' END AS action", "l_returnflag AS field")


def repair_actions(spark, d):
    return op.repair_actions(_diffs(spark, d))


def entity_patterns(spark, d):
    codes = table(spark, d, "orders").selectExpr("o_orderkey AS txn", "'C' || o_custkey % 20 AS code")
    return op.entity_patterns(_diffs(spark, d), codes, 0.6, 0.6)


def cross_capability(spark, d):
    p = table(spark, d, "part").selectExpr("p_name AS function", "p_brand AS capability")
    return op.cross_code(p, 2).select("function", "n", F.array_join("capabilities", ",").alias("capabilities"))


def best_repairs(spark, d):
    asked = table(spark, d, "part").selectExpr("p_partkey AS key", "p_brand AS entity", "p_name AS message")
    repairs = table(spark, d, "part").selectExpr("p_partkey AS id", "p_brand AS entity", "'f' AS field", "CASE WHEN p_size % 2 = 0 THEN split(p_name, ' ')[1] ELSE upper(p_name) END AS message", "p_size % 10 / 10D AS score")
    return op.best_repair(asked, repairs)


SPECS = [(1, "AUTO", "x", ["a", "b", "c"]), (2, "AUTO", "x", ["a"]), (3, "AUTO", "y", ["a", "b"]), (4, "HOUSEHOLD", "x", ["b", "c"]), (5, "HOUSEHOLD", "x", ["b"])]


def spec_matches(spark, d):
    specs = spark.createDataFrame(SPECS, "place int, source string, clearing string, parties array<string>")
    m = table(spark, d, "customer").selectExpr("c_custkey AS key", "CASE WHEN c_custkey % 3 = 0 THEN 'AUTO' ELSE 'HOUSEHOLD' END AS source", "CASE WHEN c_custkey % 5 = 0 THEN 'y' ELSE 'x' END AS clearing", "CASE c_custkey % 4 WHEN 0 THEN array('a') WHEN 1 THEN array('b') WHEN 2 THEN array('b', 'c') ELSE array('c', 'b', 'a') END AS parties")
    return op.matching_spec(m, specs)


def cross_validation(spark, d):
    """Folds of line items, a tree for each; no SQL: MLlib's trees."""
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_quantity", "l_discount", "l_tax", "CAST(l_extendedprice > 30000 AS DOUBLE) AS y")
    folds = op.stratified_folds(rows, "y", "id", 3)
    features = ["l_quantity", "l_discount", "l_tax"]

    def predict(model, own):
        p = learning.probabilities(model, own.select("id", "y", *features), features, "id")
        return p.join(own.select("id", "y"), "id").select(F.lit("dear").alias("label"), (F.col("y") == 1).alias("truth"), (F.col("p") >= 0.5).alias("predicted"))

    return op.cross_validated(folds, 3, lambda train: learning.forest(train, features, "y", 3, 3), predict)


def encoded_rows(spark, d):
    o = table(spark, d, "orders")
    rows = o.selectExpr("o_orderkey AS k", "o_custkey % 3 = 0 AS a", "CASE WHEN o_custkey % 4 > 0 THEN o_totalprice END AS b", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS c", "o_custkey % 50 AS f")
    seen = o.where("o_orderpriority <> '5-LOW'").selectExpr("CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS c", "o_custkey % 40 AS f")
    return op.encoded(rows, seen, ["a"], ["b"], ["c"], ["f"]).select("k", "a_flag", "b_number", "c_encoded", "f_freq")


def recalled_repairs(spark, d):
    c = table(spark, d, "customer")
    fields = lambda m: f"array('f' || c_custkey % {m}, 'g' || c_custkey % 3, 'h')"
    asked = c.selectExpr("c_custkey AS key", "c_mktsegment AS context", "'p' || c_custkey % 40 AS fingerprint", f"{fields(4)} AS fields")
    memory = c.selectExpr("c_mktsegment AS context", "'p' || c_custkey % 25 AS fingerprint", f"{fields(5)} AS fields", "'R' || c_custkey % 6 AS repair")
    return op.recalled(asked, memory).groupBy("repair", "score").agg(F.count("*").alias("n"))


def cross_borders(spark, d):
    party = "CASE l_linenumber % 5 WHEN 0 THEN 'orig' WHEN 1 THEN 'cdt' WHEN 2 THEN 'bnf_bank' WHEN 3 THEN 'intm' ELSE 'dbt' END AS party"
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS k", party, "CASE WHEN l_suppkey % 3 > 0 THEN 'C' || l_suppkey % 2 ELSE '' END AS country", "CASE WHEN l_partkey % 2 = 0 THEN 'M' END AS mailing_country")
    return messages.cross_party(rows, "k")


DIFFS = "d AS (SELECT l_orderkey AS txn, CASE l_linenumber % 3 WHEN 0 THEN 'cdtrAgt' WHEN 1 THEN 'dbtrAgt' ELSE 'bnfBnk' END AS entity, CASE l_suppkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'dropped' ELSE 'edited' END AS action, l_returnflag AS field FROM lineitem)"
SPEC_VALUES = ", ".join(f"({p}, '{s}', '{c}', {x})" for p, s, c, x in SPECS)
SQL = {
    "summary_scores": f"""WITH {SCORED_SQL}, c AS (SELECT label, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn FROM s GROUP BY 1)
      SELECT round(sum(tp) / sum(tp + fp), 6) AS precision, round(sum(tp) / sum(tp + fn), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)), 6) AS macro_f1 FROM c""",
    "set_scores": f"WITH {SCORED_SQL}, w AS (SELECT k, count(*) FILTER (truth <> predicted) AS w FROM s GROUP BY 1) SELECT count(*) AS rows, round(avg(CAST(w = 0 AS INT)), 6) AS exact, round(sum(w) / (3 * count(*)), 6) AS hamming FROM w",
    "ensemble_scores": """WITH a AS (SELECT o_orderkey AS txn, 'X' || o_custkey % 7 AS code, o_orderkey % 100 / 100 AS p FROM orders), b AS (SELECT o_orderkey AS txn, 'X' || o_custkey % 5 AS code, o_custkey % 100 / 100 AS p FROM orders), n AS (SELECT 'X' || o_custkey % 7 AS code, count(*) % 20 AS n FROM orders GROUP BY 1),
      j AS (SELECT coalesce(a.txn, b.txn) AS txn, coalesce(a.code, b.code) AS code, round(0.6 * coalesce(a.p, 0) + 0.4 * coalesce(b.p, 0), 6) AS p FROM a FULL JOIN b ON a.txn = b.txn AND a.code = b.code) SELECT txn, code, p FROM j LEFT JOIN n USING (code) WHERE p >= CASE WHEN coalesce(n, 0) < 10 THEN 0.7 ELSE 0.5 END""",
    "presence_profile": """WITH f AS (SELECT p_partkey AS txn, p_brand AS context, 'name' AS field, p_name AS value FROM part UNION ALL SELECT p_partkey, p_brand, 'code', p_brand || '-' || p_size FROM part WHERE p_size % 3 > 0), t AS (SELECT p_brand AS context, count(*) AS total FROM part GROUP BY 1)
      SELECT context, field, round(count(DISTINCT txn) / any_value(total), 6) AS rate, min(length(value)) AS shortest, max(length(value)) AS longest, count(*) FILTER (contains(value, '-')) AS dashes, array_to_string(list_sort(list_distinct(list(value)))[1:5], ',') AS samples, count(DISTINCT txn) = any_value(total) AS required FROM f JOIN t USING (context) GROUP BY 1, 2""",
    "applied_lookups": """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 10 END AS b, o_custkey % 4 AS nch FROM orders), b AS (SELECT k, coalesce(b, CASE WHEN nch < 3 THEN nch * 2 END) AS bic, nch, b IS NULL AND nch < 3 AS filled_bic FROM a)
      SELECT k, bic, nch, CASE WHEN bic < 8 THEN 'bank ' || bic END AS name, filled_bic, coalesce(bic < 8, false) AS filled_name FROM b""",
    "repair_actions": f"WITH {DIFFS} SELECT entity, action, field, count(*) AS n, count(DISTINCT txn) AS txns FROM d GROUP BY 1, 2, 3",
    "entity_patterns": f"""WITH {DIFFS}, c AS (SELECT o_orderkey AS txn, 'C' || o_custkey % 20 AS code FROM orders), t AS (SELECT code, count(*) AS total FROM c GROUP BY 1 HAVING count(*) >= 3), m AS (SELECT DISTINCT txn, 'entity' AS kind, entity AS value FROM d UNION SELECT DISTINCT txn, 'field', field FROM d)
      SELECT code, kind, value, round(count(*) / any_value(total), 6) AS share, count(*) AS n FROM m JOIN c USING (txn) JOIN t USING (code) GROUP BY 1, 2, 3 HAVING count(*) / any_value(total) >= 0.6""",
    "cross_capability": "SELECT p_name AS function, count(DISTINCT p_brand) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS capabilities FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2",
    "best_repairs": """WITH r AS (SELECT p_partkey AS id, p_brand AS entity, lower(CASE WHEN p_size % 2 = 0 THEN string_split(p_name, ' ')[2] ELSE p_name END) AS m, p_size % 10 / 10 AS score FROM part)
      SELECT p_partkey AS key, arg_min(id, [-score, id]) AS id, max(score) AS score FROM part JOIN r ON entity = p_brand AND score >= 0.5 AND (contains(lower(p_name), m) OR contains(m, lower(p_name))) GROUP BY 1""",
    "encoded_rows": """WITH s AS (SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority ELSE '__missing__' END AS c, CAST(o_custkey % 40 AS VARCHAR) AS f FROM orders WHERE o_orderpriority <> '5-LOW'), v AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS nr FROM (SELECT c FROM s UNION SELECT unnest(['__missing__', '__unknown__']))),
      h AS (SELECT f, count(*) / (SELECT count(*) FROM s) AS share FROM s GROUP BY 1) SELECT o_orderkey AS k, CAST(o_custkey % 3 = 0 AS INT) AS a_flag, CAST(CASE WHEN o_custkey % 4 > 0 THEN o_totalprice ELSE 0 END AS DOUBLE) AS b_number, coalesce(v.nr, (SELECT nr FROM v WHERE c = '__unknown__')) AS c_encoded, round(coalesce(share, 0), 6) AS f_freq
      FROM orders LEFT JOIN v ON v.c = CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority ELSE '__missing__' END LEFT JOIN h ON h.f = CAST(o_custkey % 50 AS VARCHAR)""",
    "recalled_repairs": """WITH a AS (SELECT c_custkey AS key, c_mktsegment AS context, 'p' || c_custkey % 40 AS fp, ['f' || c_custkey % 4, 'g' || c_custkey % 3, 'h'] AS fields FROM customer), m AS (SELECT DISTINCT c_mktsegment AS context, 'p' || c_custkey % 25 AS fp, ['f' || c_custkey % 5, 'g' || c_custkey % 3, 'h'] AS fields, 'R' || c_custkey % 6 AS repair FROM customer),
      x AS (SELECT DISTINCT key, repair, 1.0 AS score FROM a JOIN m USING (fp)), n AS (SELECT key, m.fp AS fp, repair, round(len(list_intersect(a.fields, m.fields)) / len(list_distinct(list_concat(a.fields, m.fields))), 6) AS score FROM a JOIN m USING (context) WHERE key NOT IN (SELECT key FROM x)),
      r AS (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY score DESC, fp) AS place FROM n WHERE score >= 0.5), b AS (SELECT key, repair, max(score) AS score FROM r WHERE place <= 3 GROUP BY 1, 2) SELECT repair, CAST(score AS DOUBLE) AS score, count(*) AS n FROM (FROM x UNION ALL FROM b) GROUP BY 1, 2""",
    "cross_borders": """WITH p AS (SELECT l_orderkey AS k, l_linenumber % 5 AS p, CASE WHEN l_suppkey % 3 > 0 THEN 'C' || l_suppkey % 2 END AS c, CASE WHEN l_partkey % 2 = 0 THEN 'M' END AS m FROM lineitem),
      g AS (SELECT k, max(c) FILTER (p = 0) AS o, coalesce(max(c) FILTER (p = 1), max(m) FILTER (p = 1), max(c) FILTER (p = 2)) AS b, count(*) FILTER (p = 3) > 0 AS i, count(*) FILTER (p = 2) > 0 AS bb FROM p GROUP BY 1) SELECT k, o AS originator_country, b AS beneficiary_country, i AS has_intermediary, bb AS has_beneficiary_bank, coalesce(o <> b, false) AS is_cross_border FROM g""",
    "spec_matches": f"""WITH s(place, source, clearing, parties) AS (VALUES {SPEC_VALUES}), m AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'AUTO' ELSE 'HOUSEHOLD' END AS source, CASE WHEN c_custkey % 5 = 0 THEN 'y' ELSE 'x' END AS clearing, CASE c_custkey % 4 WHEN 0 THEN ['a'] WHEN 1 THEN ['b'] WHEN 2 THEN ['b', 'c'] ELSE ['a', 'b', 'c'] END AS parties FROM customer)
      SELECT key, arg_min(place, [CASE WHEN list_sort(m.parties) = list_sort(s.parties) THEN 0 ELSE 1 END, place]) AS place FROM m JOIN s USING (source, clearing) WHERE list_has_all(s.parties, m.parties) GROUP BY 1""",
}

QUERIES = {f.__name__: f for f in (
    summary_scores, set_scores, ensemble_scores, presence_profile, applied_lookups, repair_actions, entity_patterns, cross_capability, best_repairs, spec_matches, encoded_rows, recalled_repairs, cross_borders, cross_validation,
)}
