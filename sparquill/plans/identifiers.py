"""Identifier checks on strings derived from keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.functions import identifiers as ids
from sparquill.sources.tables import table

COUNTRIES = ["DE", "FR", "GB", "US"]
NUM = "CAST(CAST(c_custkey AS BIGINT) * 7919 % 1000000007 AS VARCHAR)"
IBAN = f"'GB' || lpad(CAST(2 + c_custkey % 97 AS VARCHAR), 2, '0') || 'WEST' || lpad({NUM}, 14, '0')"


def _customers(spark, d):
    number = (F.col("c_custkey").cast("long") * 7919 % 1000000007).cast("string")
    iban = F.concat(F.lit("GB"), F.lpad((F.col("c_custkey") % 97 + 2).cast("string"), 2, "0"), F.lit("WEST"), F.lpad(number, 14, "0"))
    return table(spark, d, "customer").select("c_custkey", number.alias("number"), F.lpad(number, 9, "0").alias("aba"), iban.alias("iban"))


def iban_checks(spark, d):
    ok, check = ids.iban_valid(F.col("iban"))
    return _customers(spark, d).select("c_custkey", ok.alias("format_valid"), check.alias("checksum_valid"))


def aba_checks(spark, d):
    ok, check = ids.aba_valid(F.col("aba"))
    return _customers(spark, d).select("c_custkey", ok.alias("format_valid"), check.alias("checksum_valid"))


def bic_checks(spark, d):
    bic = F.concat(F.lit("BANK"), F.element_at(F.array(*[F.lit(c) for c in (*COUNTRIES, "XX")]), (F.col("c_custkey") % 5 + 1).cast("int")), F.lit("2"), F.when(F.col("c_custkey") % 3 == 0, "L").otherwise(""))
    ok, country = ids.bic_valid(bic, COUNTRIES)
    return _customers(spark, d).select("c_custkey", ok.alias("format_valid"), country.alias("country_valid"), ids.looks_like_bic(bic).alias("looks_like"))


def polish_checks(spark, d):
    return _customers(spark, d).select("c_custkey", ids.polish_digit(F.substring(F.lpad("number", 8, "0"), 1, 8)).alias("valid"))


def belgian_checks(spark, d):
    n = F.lpad("number", 10, "0")
    stated = F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0")
    return _customers(spark, d).select("c_custkey", ids.belgian_digits(F.substring(n, 1, 3), F.substring(n, 4, 7), stated).alias("valid"))


def mod97_rests(spark, d):
    return _customers(spark, d).select("c_custkey", ids.mod97(F.concat("number", "number")).alias("rest"))


def account_types(spark, d):
    c = F.when(F.col("c_custkey") % 3 == 0, F.col("aba")).when(F.col("c_custkey") % 3 == 1, F.lpad("number", 18, "0")).otherwise(F.lpad(F.substring("number", 1, 6), 6, "0"))
    return _customers(spark, d).groupBy(F.coalesce(ids.account_type(c), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


def amounts(spark, d):
    c = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".5")))
    return table(spark, d, "orders").select(ids.amount(c).alias("amount")).groupBy("amount").agg(F.count("*").alias("n"))


def cleaning_reasons(spark, d):
    c = F.concat(F.lit("AB"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(""), F.when(F.col("c_custkey") % 3 == 0, "-").otherwise(""), F.when(F.col("c_custkey") % 5 == 0, "x").otherwise("1"))
    return _customers(spark, d).select(ids.cleaning_reason(c).alias("reason"), ids.dirty(c).alias("dirty")).groupBy("reason", "dirty").agg(F.count("*").alias("n"))


def bank_codes(spark, d):
    return _customers(spark, d).groupBy(ids.bank_code(F.col("iban")).alias("bank")).agg(F.count("*").alias("n"))


def domestic_accounts(spark, d):
    country = F.element_at(F.array(*[F.lit(c) for c in ("US", "PL", "GB", "DE", "FR")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return _customers(spark, d).groupBy(country.alias("country"), ids.domestic_account_valid(F.col("number"), country).alias("valid")).agg(F.count("*").alias("n"))


def _mod97(digits, length):
    """Remainder of a digit string by two steps that stay within 64 bits."""
    return f"((CAST(left({digits}, {length} - 8) AS BIGINT) % 97) * 100000000 + CAST(right({digits}, 8) AS BIGINT)) % 97"


# GB82WEST...: the rearranged number is WEST = 32142829, 14 digits, GB = 1611, two digits.
IBAN_REST = f"((32142829 % 97 * 100000000000000 + CAST(lpad({NUM}, 14, '0') AS HUGEINT)) % 97 * 1000000 + 161100 + (2 + c_custkey % 97)) % 97"
ABA_SUM = " + ".join(f"CAST(substr(a, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(ids.ABA_WEIGHTS))
PL_SUM = " + ".join(f"CAST(substr(p, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(ids.POLISH_WEIGHTS))
BIC = "'BANK' || (['DE', 'FR', 'GB', 'US', 'XX'])[c_custkey % 5 + 1] || '2' || CASE WHEN c_custkey % 3 = 0 THEN 'L' ELSE '' END"

SQL = {
    "iban_checks": f"SELECT c_custkey, true AS format_valid, {IBAN_REST} = 1 AS checksum_valid FROM customer",
    "aba_checks": f"WITH x AS (SELECT c_custkey, lpad({NUM}, 9, '0') AS a FROM customer) SELECT c_custkey, true AS format_valid, ({ABA_SUM}) % 10 = 0 AS checksum_valid FROM x",
    "bic_checks": f"WITH x AS (SELECT c_custkey, {BIC} AS b FROM customer) SELECT c_custkey, length(b) = 8 AS format_valid, length(b) = 8 AND substr(b, 5, 2) <> 'XX' AS country_valid, length(b) = 8 AS looks_like FROM x",
    "polish_checks": f"WITH x AS (SELECT c_custkey, left(lpad({NUM}, 8, '0'), 8) AS p FROM customer) SELECT c_custkey, CAST(substr(p, 8, 1) AS INT) = (10 - ({PL_SUM}) % 10) % 10 AS valid FROM x",
    "belgian_checks": f"WITH x AS (SELECT c_custkey, CAST({NUM} AS BIGINT) % 97 AS r FROM customer) SELECT c_custkey, c_custkey % 97 = CASE WHEN r = 0 THEN 97 ELSE r END AS valid FROM x",
    "mod97_rests": f"SELECT c_custkey, CAST(CAST({NUM} || {NUM} AS HUGEINT) % 97 AS INT) AS rest FROM customer",
    "account_types": f"WITH x AS (SELECT c_custkey % 3 AS k, lpad({NUM}, 9, '0') AS a FROM customer) SELECT CASE WHEN k = 1 THEN 'CLABE' WHEN k = 2 THEN 'CHIPS' WHEN ({ABA_SUM}) % 10 = 0 THEN 'FEDABA' ELSE 'none' END AS kind, count(*) AS n FROM x GROUP BY 1",
    "amounts": "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE CAST(1000 + o_orderkey % 1000 + 0.5 AS DOUBLE) END AS amount, count(*) AS n FROM orders GROUP BY 1",
    "cleaning_reasons": "WITH x AS (SELECT c_custkey % 2 = 0 AS s, c_custkey % 3 = 0 AS d, c_custkey % 5 = 0 AS l FROM customer) SELECT concat_ws(', ', CASE WHEN s THEN 'spaces' END, CASE WHEN d THEN 'dashes' END, CASE WHEN l THEN 'lowercase' END) AS reason, s OR d AS dirty, count(*) AS n FROM x GROUP BY 1, 2",
    "bank_codes": "SELECT 'WEST' AS bank, count(*) AS n FROM customer",
    "domestic_accounts": f"WITH x AS (SELECT (['US', 'PL', 'GB', 'DE', 'FR'])[c_custkey % 5 + 1] AS country, length({NUM}) AS n FROM customer) SELECT country, CASE country WHEN 'US' THEN n BETWEEN 4 AND 17 WHEN 'PL' THEN n = 26 WHEN 'GB' THEN n = 8 WHEN 'DE' THEN n <= 10 ELSE n BETWEEN 4 AND 20 END AS valid, count(*) AS n FROM x GROUP BY 1, 2",
}

QUERIES = {f.__name__: f for f in (iban_checks, aba_checks, bic_checks, polish_checks, belgian_checks, mod97_rests, account_types, amounts, cleaning_reasons, bank_codes, domestic_accounts)}
