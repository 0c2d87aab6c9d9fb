"""Queries over source code, payment messages and vectors, made from the tables at hand, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import code, learning, messages
from sparquill.sources.tables import table


def _files(spark, d):
    text = F.concat(
        F.lit("! part "), F.col("p_name"), F.lit("\nINT PROC proc_"), F.col("p_partkey"), F.lit("(a);\n  INT a, .b[0:"), F.col("p_size"), F.lit("];\nBEGIN\n  IF a THEN CALL proc_"), (F.col("p_partkey") * 7 % 1000).cast("string"),
        F.lit("(a);\n  b := $len(a); ! CALL nothing\nEND;\nPROC last_"), F.col("p_partkey"), F.lit(";\nBEGIN\n  CALL proc_"), F.col("p_partkey"), F.lit("(a);\n  EXEC SQL UPDATE t;\nEND;"),
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("file"), text.alias("text"))


def code_procedures(spark, d):
    return code.procedures(code.lines(_files(spark, d)))


def code_calls(spark, d):
    lines = code.lines(_files(spark, d))
    return code.calls(lines, code.procedures(lines))


def code_statements(spark, d):
    lines = code.lines(_files(spark, d))
    return lines.groupBy(F.coalesce(code.statement_kind(F.col("code")), F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))


def code_symbols(spark, d):
    return code.symbols(code.lines(_files(spark, d))).select("file", "data_type", "name", "is_pointer", "bounds")


def code_sql(spark, d):
    return code.sql_operations(code.lines(_files(spark, d))).groupBy("operation").agg(F.count("*").alias("n"))


def code_complexity(spark, d):
    return code.complexity(_files(spark, d))


def code_balance(spark, d):
    return code.parenthesis_balance(code.lines(_files(spark, d))).groupBy("balance").agg(F.count("*").alias("n"))


def _messages(spark, d):
    party = F.struct(F.struct(F.concat(F.lit("DEUTDEF"), (F.col("k") % 10).cast("string")).alias("ID"), F.when(F.col("k") % 4 > 0, F.concat(F.lit("Name "), F.col("c"))).alias("Name"), F.when(F.col("k") % 3 == 0, F.struct(F.struct(F.lpad(F.col("k").cast("string"), 9, "0").alias("#text")).alias("ID"))).alias("AcctIDInf")).alias("AccountPartyInf"))
    amount = F.struct(F.lit("Amount").alias("@Type"), F.lit("USD").alias("@Currency"), F.col("total").cast("string").alias("Amount"))
    payment = F.struct(F.lit("SWF").alias("SourceCode"), amount.alias("MonetaryAmount"), F.struct(party.alias("CreditPartyInf"), F.when(F.col("k") % 2 == 0, party).alias("DebitPartyInfo")).alias("PartyInf"))
    status = F.struct(F.concat(F.lit("80"), F.lpad((F.col("k") % 7).cast("string"), 2, "0")).alias("Code"), F.lit("E").alias("Severity"), F.when(F.col("k") % 5 == 0, "CDTPTY account").otherwise("text").alias("InformationalData"))
    doc = F.struct(F.struct(F.struct(F.struct(F.struct(payment.alias("BasicPayment")).alias("Message")).alias("File")).alias("IFML")).alias("Request"), F.struct(F.struct(F.struct(F.struct(F.struct(F.array(status).alias("MsgStatus")).alias("AuditTrail")).alias("Message")).alias("File")).alias("IFML")).alias("Response"))
    o = table(spark, d, "orders").selectExpr("o_orderkey AS k", "CAST(o_custkey AS STRING) AS c", "o_totalprice AS total")
    return messages.located(o.select("k", F.parse_json(F.to_json(doc)).alias("message")))


def message_amounts(spark, d):
    return messages.basics(_messages(spark, d), "k").groupBy("source_code", "currency", "amounts_differ").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


def message_parties(spark, d):
    f = messages.party_features(messages.parties(_messages(spark, d), "k"), ["k", "party", "nr"], ["DE"])
    return f.groupBy("party", "has_bic", "has_name", "has_account", F.coalesce("account_type", F.lit("none")).alias("account_type")).agg(F.count("*").alias("n"))


def message_codes(spark, d):
    return messages.response_codes(_messages(spark, d), "k").groupBy("composite", "severity").agg(F.count("*").alias("n"))


def nearest_embeddings(spark, d):
    """Queries are all rows whose id is divisible by 50."""
    return learning.nearest_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 20)


def latent_neighbours(spark, d):
    """Nearest documents in latent space, for all whose id is divisible by 50; no SQL: singular vectors."""
    _, docs = learning.latent_index(table(spark, d, "documents"), k=10)
    return learning.nearest_vectors(docs, "doc_id", "vector", F.col("doc_id") % 50 == 0, 20)


def forest_importance(spark, d):
    """Feature importances of a forest that predicts the largest price class; no SQL: MLlib's trees."""
    rows = table(spark, d, "lineitem").selectExpr("l_quantity", "l_discount", "l_tax", "CAST(l_extendedprice > 50000 AS DOUBLE) AS label")
    features = ["l_quantity", "l_discount", "l_tax"]
    return spark.createDataFrame(learning.importances(learning.forest(rows, features, "label", 5, 4), features, 3), "feature string, importance double")


SQL = {
    "code_procedures": "SELECT p_partkey AS file, 'proc_' || p_partkey AS name, 'PROC' AS kind, 'INT' AS return_type, 2 AS start_line, 7 AS end_line FROM part UNION ALL SELECT p_partkey, 'last_' || p_partkey, 'PROC', NULL, 8, 12 FROM part",
    "code_calls": "SELECT p_partkey AS file, 'proc_' || p_partkey AS procedure, 'PROC_' || p_partkey * 7 % 1000 AS target, 'call' AS kind, 5 AS line_no FROM part WHERE p_partkey * 7 % 1000 <> p_partkey UNION ALL SELECT p_partkey, 'proc_' || p_partkey, '$LEN', 'system', 6 FROM part UNION ALL SELECT p_partkey, 'last_' || p_partkey, 'PROC_' || p_partkey, 'call', 10 FROM part",
    "code_statements": "SELECT unnest(['if', 'assign', 'call', 'other']) AS kind, unnest([1, 1, 1, 9]) * count(*) AS n FROM part",
    "code_symbols": "SELECT p_partkey AS file, 'INT' AS data_type, unnest(['a', 'b']) AS name, unnest([false, true]) AS is_pointer, unnest([NULL, '0:' || p_size]) AS bounds FROM part",
    "code_sql": "SELECT 'UPDATE' AS operation, count(*) AS n FROM part",
    "code_complexity": "SELECT p_partkey AS file, round((173 + length(p_name) + 3 * length(CAST(p_partkey AS VARCHAR)) + length(CAST(p_size AS VARCHAR)) + length(CAST(p_partkey * 7 % 1000 AS VARCHAR))) / 1000 + 0.9 + 0.2, 6) AS score FROM part",
    "code_balance": "SELECT 0 AS balance, 12 * count(*) AS n FROM part",
    "message_amounts": "SELECT 'SWF' AS source_code, 'USD' AS currency, false AS amounts_differ, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders",
    "message_parties": "WITH o AS (SELECT o_orderkey AS k, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['cdt', 'dbt'] ELSE ['cdt'] END) AS party FROM orders), a AS (SELECT *, lpad(CAST(k AS VARCHAR), 9, '0') AS a FROM o) SELECT party, true AS has_bic, k % 4 > 0 AS has_name, k % 3 = 0 AS has_account, CASE WHEN k % 3 = 0 AND (" + " + ".join(f"{w} * CAST(substr(a, {i + 1}, 1) AS INT)" for i, w in enumerate((3, 7, 1) * 3)) + ") % 10 = 0 THEN 'FEDABA' ELSE 'none' END AS account_type, count(*) AS n FROM a GROUP BY ALL",
    "message_codes": "SELECT '80' || lpad(CAST(o_orderkey % 7 AS VARCHAR), 2, '0') || CASE WHEN o_orderkey % 5 = 0 THEN '_CDTPTY' ELSE '' END AS composite, 'E' AS severity, count(*) AS n FROM orders GROUP BY 1",
    "nearest_embeddings": "WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 50 = 0) SELECT query, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE vec_id <> query QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) DESC, vec_id) <= 20",
}

QUERIES = {f.__name__: f for f in (code_procedures, code_calls, code_statements, code_symbols, code_sql, code_complexity, code_balance, message_amounts, message_parties, message_codes, nearest_embeddings, latent_neighbours, forest_importance)}
