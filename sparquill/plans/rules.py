"""Rule queries over party features derived from orders and customers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import rules as op
from sparquill.sources.tables import table

PARTIES = ("bnf", "cdt", "dbt")
#: feature: SQL that both engines run on the order key k and the customer key c, shifted by party.
FLAGS = {
    "needs_iban": "(k + {s}) % 5 = 0", "has_iban": "CASE WHEN (k + {s}) % 11 = 0 THEN NULL ELSE (k + {s}) % 3 = 0 END", "has_account": "(c + {s}) % 2 = 0", "has_bic": "CASE WHEN c % 13 = 0 THEN NULL ELSE (k + c + {s}) % 4 <> 0 END",
    "bic_valid_country": "CASE WHEN (c + {s}) % 6 = 0 THEN NULL ELSE (c + {s}) % 7 <> 0 END", "account_has_dirty_chars": "(k + 2 * {s}) % 17 = 0", "iban_checksum_valid": "CASE WHEN c % 5 = 0 THEN NULL ELSE (c + {s}) % 9 <> 0 END", "is_international": "(c + {s}) % 8 = 0",
}
CODES = ["8004", "8022", "8026", "8027", "8029", "8851", "8852", "8894", "8895"]


def _wide(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c")
    return o.select("k", *[F.expr(sql.format(s=s)).alias(f"{p}_{name}") for s, p in enumerate(PARTIES) for name, sql in FLAGS.items()])


def _long(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c")
    features = [F.struct(F.lit(p).alias("party"), F.create_map(*[x for name, sql in FLAGS.items() for x in (F.lit(name), F.expr(sql.format(s=s)))]).alias("features")) for s, p in enumerate(PARTIES)]
    return o.select("k", F.explode(F.array(*features)).alias("p")).select("k", "p.party", "p.features")


PROGRAM = [("A1", ["has_iban"], ["iban_checksum_valid"], None), ("A2", ["has_bic", "has_account"], ["bic_valid_country", "has_iban"], None), ("A3", ["needs_iban"], [], "bnf"), ("A4", [], ["has_bic"], "cdt")]


def _program(spark):
    return spark.createDataFrame(PROGRAM, "code string, require_true array<string>, require_false array<string>, only string")


def rule_reasons(spark, d):
    return op.fired_codes(_wide(spark, d), "k", CODES).groupBy("code").agg(F.count("*").alias("fired"), F.sum(F.size("reasons")).alias("reasons"))


def rule_fired(spark, d):
    return op.fired_codes(_wide(spark, d), "k", ["8004", "8894"]).select("k", "code", F.size("reasons").alias("n"))


def rule_program(spark, d):
    return op.evaluate_all(_long(spark, d), _program(spark), ["k"]).groupBy("party", "code", "status").agg(F.count("*").alias("n"))


def rule_first_party(spark, d):
    return op.first_by_party(op.evaluate_all(_long(spark, d), _program(spark), ["k"]), ["k"], list(PARTIES))


def _party_rows(spark, d):
    c = table(spark, d, "customer")
    return c.selectExpr(
        "c_custkey AS k", "'cdt' AS party", "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN '02100-0021' ELSE lpad(CAST(c_custkey AS STRING), 9, '0') END AS nch", "CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN '12 34/5' ELSE CAST(c_custkey AS STRING) END AS account",
        "CASE WHEN c_custkey % 6 = 0 THEN 'gb82 west' WHEN c_custkey % 6 = 1 THEN 'GB82WEST' END AS iban", "CASE WHEN c_custkey % 9 = 0 THEN 'A/B' ELSE 'AB1' END AS id", "c_custkey % 2 = 0 AS is_domestic", "c_custkey % 10 = 0 AS has_multiple_ids", "c_custkey % 8 = 0 AS is_clabe", "c_custkey % 4 < 2 AS needs_iban", "c_custkey % 12 = 1 AS id_is_compound", "c_custkey % 4 < 2 AS is_fedaba", "c_custkey % 14 = 3 AS has_domestic_account", "c_custkey % 15 = 2 AS account_needs_length_fix", "c_custkey % 16 = 5 AS nch_in_wrong_field", "c_custkey % 18 = 7 AS id_has_bic_and_nch", "c_custkey % 5 < 2 AS has_bic", "c_custkey % 3 < 2 AS derivable",
    )


def rule_repairs(spark, d):
    return op.repair_codes(_party_rows(spark, d), ["k"]).groupBy("code", "status", "confidence").agg(F.count("*").alias("n"))


def rule_duplicates(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c")
    p = o.select("k", F.explode(F.array(*[F.struct(F.lit(p).alias("party"), F.expr(f"'B' || (c + {s} * k) % 4").alias("bic")) for s, p in enumerate(PARTIES)])).alias("p")).select("k", "p.party", "p.bic")
    return op.duplicate_party_values(p, ["k"], list(PARTIES))


def _predicted(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS k", "stack(3, 'X' || o_orderkey % 4, round(o_orderkey % 10 / 10D, 1), 'Y' || o_custkey % 3, round(o_custkey % 10 / 10D, 1), 'Z', 0.5D) AS (code, p)")


def rule_exclusive(spark, d):
    pairs = spark.createDataFrame([("X0", "Y1"), ("X1", "Z"), ("Y2", "Z")], "code1 string, code2 string")
    return op.exclusive(_predicted(spark, d), pairs, ["k"])


def rule_accuracy(spark, d):
    actual = table(spark, d, "orders").selectExpr("o_orderkey AS k", "explode(array('X' || o_orderkey % 3, 'Y' || o_custkey % 3)) AS code")
    return op.compare_codes(_predicted(spark, d), actual, ["k"]).select("code", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def iban_lengths(spark, d):
    c = F.concat(F.element_at(F.array(F.lit("GB"), F.lit("NO"), F.lit("ZZ")), (F.col("c_custkey") % 3 + 1).cast("int")), F.lpad(F.col("c_custkey").cast("string"), 13, "0"), F.when(F.col("c_custkey") % 2 == 0, "1234567").otherwise(""))
    return table(spark, d, "customer").groupBy(op.iban_length_valid(c).alias("valid")).agg(F.count("*").alias("n"))


def _condition(party, tests):
    out = []
    for feature, test in tests.items():
        name = f"{party}_{feature}" if party else feature
        if party in PARTIES and feature in FLAGS:
            out.append({True: f"({name} IS TRUE)", False: f"({name} IS FALSE)", op.NOT_TRUE: f"({name} IS NOT TRUE)"}[test])
        else:
            out.append({op.NOT_TRUE: "true", op.ZERO: "true"}.get(test, "false"))
    return " AND ".join(out)


WIDE = "w AS (SELECT o_orderkey AS k, " + ", ".join(f"{sql.format(s=s).replace('k +', 'o_orderkey +').replace('(k ', '(o_orderkey ').replace('c +', 'o_custkey +').replace('+ c', '+ o_custkey').replace(' c %', ' o_custkey %')} AS {p}_{n}" for s, p in enumerate(PARTIES) for n, sql in FLAGS.items()) + " FROM orders)"
COUNTS = {code: " + ".join(f"CAST({_condition(p, r.tests)} AS INT)" for r in op.REASONS if r.code == code for p in r.parties) for code in CODES}
LONG = "l AS (" + " UNION ALL ".join(f"SELECT k, '{p}' AS party, {s} AS place, {', '.join(f'{p}_{n} AS {n}' for n in FLAGS)} FROM w" for s, p in enumerate(PARTIES)) + ")"
STATUS = {
    "A1": ("has_iban IS TRUE", "iban_checksum_valid IS FALSE", "iban_checksum_valid IS NULL", None), "A2": ("has_bic IS TRUE AND has_account IS TRUE", "bic_valid_country IS FALSE OR has_iban IS FALSE", "bic_valid_country IS NULL AND has_iban IS NULL", None),
    "A3": ("needs_iban IS TRUE", "false", "true", "bnf"), "A4": ("true", "has_bic IS FALSE", "has_bic IS NULL", "cdt"),
}
EVAL = "s AS (" + " UNION ALL ".join(f"SELECT k, party, place, '{c}' AS code, CASE WHEN NOT ({t}) THEN 'cannot_fire' WHEN {f} THEN 'fires' WHEN {n} THEN 'eligible' ELSE 'cannot_fire' END AS status FROM l{f' WHERE party = {chr(39)}{o}{chr(39)}' if o else ''}" for c, (t, f, n, o) in STATUS.items()) + ")"
PARTY = """p AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN '02100-0021' ELSE lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS nch, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN '12 34/5' ELSE CAST(c_custkey AS VARCHAR) END AS account,
  CASE WHEN c_custkey % 6 = 0 THEN 'gb82 west' WHEN c_custkey % 6 = 1 THEN 'GB82WEST' END AS iban, CASE WHEN c_custkey % 9 = 0 THEN 'A/B' ELSE 'AB1' END AS id, c_custkey % 2 = 0 AS dom, c_custkey % 10 = 0 AS mult, c_custkey % 8 = 0 AS clabe, c_custkey % 4 < 2 AS needs, c_custkey % 12 = 1 AS compound, c_custkey % 4 < 2 AS fed, c_custkey % 14 = 3 AS domacc, c_custkey % 15 = 2 AS fix, c_custkey % 16 = 5 AS wrong, c_custkey % 18 = 7 AS twofold, c_custkey % 5 < 2 AS bic, c_custkey % 3 < 2 AS der FROM customer)"""
REPAIR = {
    "9000": "nch LIKE '%-%'", "9002": "regexp_matches(account, '[^A-Za-z0-9]') AND NOT dom", "9006": "iban LIKE 'gb%'", "9015": "regexp_matches(account, '[^A-Za-z0-9]') AND (dom OR domacc)", "9017": "mult OR compound", "9019": "id LIKE '%/%' OR regexp_matches(account, '[^A-Za-z0-9]')",
    "9021": "nch IS NOT NULL AND fed AND (length(regexp_replace(nch, '[ -]', '', 'g')) <> 9 OR nch LIKE '%-%')", "9022": "account <> '' AND (fix OR CASE WHEN clabe THEN length(regexp_replace(account, '[ -]', '', 'g')) <> 18 WHEN fed THEN length(regexp_replace(account, '[ -]', '', 'g')) <> 9 ELSE false END)", "9025": "clabe", "9028": "nch IS NOT NULL AND (wrong OR twofold)",
    "9004": "needs AND iban IS NULL AND account <> '' AND der", "9005": "nch IS NOT NULL AND NOT bic", "9007": "needs AND iban IS NULL AND account <> '' AND der", "9008": "iban IS NOT NULL AND NOT bic", "9477": "nch IS NOT NULL OR fed", "9479": "bic", "9480": "bic",
}
PRED = "pr AS (SELECT o_orderkey AS k, 'X' || o_orderkey % 4 AS code, round(o_orderkey % 10 / 10, 1) AS p FROM orders UNION ALL SELECT o_orderkey, 'Y' || o_custkey % 3, round(o_custkey % 10 / 10, 1) FROM orders UNION ALL SELECT o_orderkey, 'Z', 0.5 FROM orders)"

SQL = {
    "rule_reasons": f"WITH {WIDE}, n AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS code, {COUNTS[c]} AS n FROM w' for c in CODES)}) SELECT code, count(*) AS fired, CAST(sum(n) AS BIGINT) AS reasons FROM n WHERE n > 0 GROUP BY 1",
    "rule_fired": f"WITH {WIDE}, n AS ({' UNION ALL '.join(f'SELECT k, {chr(39)}{c}{chr(39)} AS code, {COUNTS[c]} AS n FROM w' for c in ('8004', '8894'))}) SELECT k, code, n FROM n WHERE n > 0",
    "rule_program": f"WITH {WIDE}, {LONG}, {EVAL} SELECT party, code, status, count(*) AS n FROM s GROUP BY ALL",
    "rule_first_party": f"WITH {WIDE}, {LONG}, {EVAL} SELECT k, code, arg_min(status, [CASE status WHEN 'fires' THEN 0 ELSE 1 END, place]) AS status, arg_min(party, [CASE status WHEN 'fires' THEN 0 ELSE 1 END, place]) AS party FROM s WHERE status <> 'cannot_fire' GROUP BY 1, 2",
    "rule_repairs": f"WITH {PARTY} " + " UNION ALL ".join(f"SELECT '{c}' AS code, '{'eligible' if c in op.CONFIDENCE else 'fires'}' AS status, CAST({op.CONFIDENCE.get(c, 1.0)} AS DOUBLE) AS confidence, count(*) AS n FROM p WHERE {t}" for c, t in REPAIR.items()),
    "rule_duplicates": "WITH x AS (SELECT o_orderkey AS k, 'B' || o_custkey % 4 AS a, 'B' || (o_custkey + o_orderkey) % 4 AS b, 'B' || (o_custkey + 2 * o_orderkey) % 4 AS c FROM orders) SELECT k, CASE WHEN a = b OR a = c THEN 'bnf' ELSE 'cdt' END AS first, CASE WHEN a = b THEN 'cdt' ELSE 'dbt' END AS second, CASE WHEN a = b OR a = c THEN a ELSE b END AS bic FROM x WHERE a = b OR a = c OR b = c",
    "rule_exclusive": f"WITH {PRED}, e(c1, c2) AS (VALUES ('X0', 'Y1'), ('X1', 'Z'), ('Y2', 'Z'), ('Y1', 'X0'), ('Z', 'X1'), ('Z', 'Y2')) SELECT k, code, CAST(p AS DOUBLE) AS p FROM pr WHERE NOT EXISTS (SELECT 1 FROM e JOIN pr o ON o.code = e.c2 WHERE e.c1 = pr.code AND o.k = pr.k AND (o.p > pr.p OR (o.p = pr.p AND o.code < pr.code)))",
    "rule_accuracy": f"""WITH {PRED}, a AS (SELECT o_orderkey AS k, 'X' || o_orderkey % 3 AS code FROM orders UNION SELECT o_orderkey, 'Y' || o_custkey % 3 FROM orders),
      j AS (SELECT coalesce(pr.code, a.code) AS code, count(*) FILTER (pr.code IS NOT NULL AND a.code IS NOT NULL) AS tp, count(*) FILTER (a.code IS NULL) AS fp, count(*) FILTER (pr.code IS NULL) AS fn FROM pr FULL JOIN a ON pr.k = a.k AND pr.code = a.code GROUP BY 1),
      r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM j) SELECT code, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""",
    "iban_lengths": "SELECT CASE c_custkey % 3 WHEN 0 THEN c_custkey % 2 = 0 WHEN 1 THEN c_custkey % 2 = 1 END AS valid, count(*) AS n FROM customer GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (rule_reasons, rule_fired, rule_program, rule_first_party, rule_repairs, rule_duplicates, rule_exclusive, rule_accuracy, iban_lengths)}
