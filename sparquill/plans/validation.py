"""Validation queries: features of messages and parties are derived from orders, the same way in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.functions.identifiers import IBAN_LENGTHS
from sparquill.operators import rules
from sparquill.operators import validation as op
from sparquill.plans.rules import PARTY, REPAIR, _party_rows
from sparquill.sources.tables import table

PARTIES = ("bnf", "cdt", "dbt", "orig", "send", "intm")
FLAGS = (
    "has_iban needs_iban id_has_bic_and_nch has_bic bic_valid_country has_account bic_party_country_match bic_iban_match is_international is_domestic id_has_slash id_has_nch_pattern "
    "account_has_dirty_chars has_name nch_valid has_nch iban_checksum_valid iban_length_valid iban_country_valid iban_format_valid present has_length_violation iban_valid_format has_id bic_valid_format"
).split()
NUMBERS = ("nch_sources", "account_length", "bic_length")
MESSAGE_FLAGS = "has_multiple_nch_sources primary_amount nch_validation_applicable has_instructed_amount has_invalid_iban has_nch_issue invalid_nch_format missing_required_iban missing_bnf_bic".split()
MESSAGE_NUMBERS = ("iban_checksum_valid_count", "bic_iban_mismatch_count", "total_nch_sources")


def _flag(nr):
    return f"CASE WHEN (k * 7 + c * 3 + {nr}) % 11 = 0 THEN NULL ELSE (k * {nr % 5 + 1} + c * 5 + {nr}) % 13 < {nr % 4 + 1} END"


def _number(nr):
    return f"CASE WHEN (k + {nr}) % 9 = 0 THEN NULL ELSE (k * 3 + c + {nr}) % 12 END"


#: Feature: SQL over the order key k and the customer key c.
FEATURES = {f"{p}_{f}": _flag(31 * i + j) for i, p in enumerate(PARTIES) for j, f in enumerate(FLAGS)}
FEATURES |= {f"{p}_{f}": _number(17 * i + j) for i, p in enumerate(PARTIES) for j, f in enumerate(NUMBERS)}
FEATURES |= {f: _flag(400 + j) for j, f in enumerate(MESSAGE_FLAGS)} | {f: _number(500 + j) for j, f in enumerate(MESSAGE_NUMBERS)}
CODES = ("8022", "8026", "8027", "8029", "8851", "8852", "8895", "8896")


def _wide(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c").select("k", *[F.expr(sql).alias(name) for name, sql in FEATURES.items()])


def own_reasons(spark, d):
    return rules.fired_codes(_wide(spark, d), "k", list(CODES), op.OWN_REASONS).groupBy("code").agg(F.count("*").alias("fired"), F.sum(F.size("reasons")).alias("reasons"))


def iban_strict(spark, d):
    return op.invalid_iban(_wide(spark, d), "k").select("k", "code", F.size("reasons").alias("n"))


def iban_loose(spark, d):
    return op.invalid_iban(_wide(spark, d), "k", op.LOOSE_IBAN).select("k", "code", F.size("reasons").alias("n"))


COUNTRIES = ["US", "NY", "FR", "CA", "DE", "JP", "", "BR"]
PICK = "CASE ({x}) % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(COUNTRIES)) + " END"


def iban_underivable(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c")
    fires = op.underivable_iban(*[F.expr(PICK.format(x=x)) for x in ("k", "k + c", "c")], F.expr(_flag(1)), F.expr("k % 4 <> 0"))
    return o.select("k", fires.alias("fires"))


MESSAGE = {
    "amount_decimals_valid": _flag(3), "has_currency": _flag(6), "currency_valid": _flag(9), "has_duplicate_party_info": _flag(7), "intm_has_multiple": _flag(15), "intm_has_redundant_info": _flag(18), "cross_party_dup_detected": "k % 2 = 0",
    "dup_first": "CASE k % 5 WHEN 0 THEN 'bnf_bank' WHEN 1 THEN 'intm_0' WHEN 2 THEN 'snd_bank' WHEN 3 THEN 'dbt_bank' END", "dup_second": "CASE c % 5 WHEN 0 THEN 'bnf_bank' WHEN 1 THEN 'intm_1' WHEN 2 THEN 'cdt_wirekey' WHEN 3 THEN 'other' END",
    "intm_count": _number(4), "has_intermediary": _flag(21), "intm_present": _flag(24), "intm_entries_share_adr_bank_id": _flag(27), "intm_entries_share_country": _flag(30), "intm_entries_share_bic_prefix": _flag(33), "intm_has_multiple_types": _flag(36),
}


def _messages(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c").select("k", *[F.expr(sql).alias(name) for name, sql in MESSAGE.items()])


def message_checks(spark, d):
    return op.message_codes(_messages(spark, d), ["k"])


def intermediary_checks(spark, d):
    return op.intermediary_status(_messages(spark, d), ["k"])


PARTY_ENDINGS = {"bnf": "BNPPTY", "cdt": "CDTPTY", "send": "SNDBNK"}
PARTY_FLAGS = "present needs_iban has_iban iban_is_attempt iban_valid_format iban_checksum_valid has_country country_valid has_long_address has_nch fedaba_checksum_valid".split()
PARTY_TEXTS = {"name": "repeat('n', 100 + (k + c) % 60)", "account": "CASE WHEN k % 3 = 0 THEN '' ELSE repeat('1', 20 + c % 30) END", "iban": "CASE WHEN k % 2 = 0 THEN repeat('A', 30 + c % 9) END"}


def _party(i, party):
    flags = ", ".join(f"{_flag(40 * i + 3 * j + 1)} AS {f}" for j, f in enumerate(PARTY_FLAGS))
    return f"SELECT k, '{PARTY_ENDINGS[party]}' AS party, {'true' if party == 'send' else 'false'} AS is_bank, {flags}, {', '.join(f'{sql} AS {name}' for name, sql in PARTY_TEXTS.items())} FROM {{o}}"


def _parties(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c")
    out = None
    for i, p in enumerate(PARTY_ENDINGS):
        own = spark.sql(_party(i, p), o=o)
        out = own if out is None else out.unionAll(own)
    return out


def party_checks(spark, d):
    return op.party_codes(_parties(spark, d), ["k"]).groupBy("code", "party").agg(F.count("*").alias("n"), F.count_distinct("k").alias("messages"))


def combined_codes(spark, d):
    a = op.intermediary_status(_messages(spark, d), ["k"])
    b = op.message_codes(_messages(spark, d), ["k"]).select("k", "code", F.lit("fires").alias("status"))
    return op.combined([a, b], ["k"]).select("k", *[F.array_join(c, ",").alias(c) for c in ("fired", "eligible", "cannot_fire")])


PREDICTED = "SELECT k, unnest(['8004_BNPPTY', '8022', '8895_DBTPTY', '8896', '8001', '8894_CDTPTY', '9018']) AS code FROM o"


def _predicted(spark, d):
    codes = ["8004_BNPPTY", "8022", "8895_DBTPTY", "8896", "8001", "8894_CDTPTY", "9018"]
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.array(*[F.lit(c) for c in codes])).alias("code"))


def semantic_codes(spark, d):
    return op.semantic_filter(_predicted(spark, d), _wide(spark, d), "k")


PROGRAM = {"8004": (["has_account"], ["has_iban"]), "8022": (["has_bic", "has_iban"], []), "8894": (["has_iban"], ["iban_checksum_valid", "iban_format_valid"]), "8896": ([], ["iban_valid_format", "has_multiple_nch_sources"])}


def precondition_codes(spark, d):
    return op.precondition_filter(_predicted(spark, d), _wide(spark, d), "k", PROGRAM)


def _likely(spark, d):
    return _predicted(spark, d).withColumn("p", F.round((F.col("k") * 7 + F.length("code") * 3 + F.substring("code", 4, 1).cast("int")) % 10 / 10, 1))


PAIRS = [("8894_CDTPTY", "8896", "Use is_international feature: True->8894, False->8896"), ("8001", "8022", ""), ("8895_DBTPTY", "8001", "bic_length"), ("8004_BNPPTY", "9018", "is_international")]


def conflict_codes(spark, d):
    pairs = spark.createDataFrame(PAIRS, "code1 string, code2 string, hint string")
    return op.settled_conflicts(_likely(spark, d), _wide(spark, d), pairs, "k")


def risk_codes(spark, d):
    more = _likely(spark, d).unionAll(_likely(spark, d).where("code = '8022'").select("k", F.lit("__OTHER__"), F.lit(1.0)))
    return op.top_risks(more, "k", 3)


def suffixed_codes(spark, d):
    out = op.suffixed(rules.repair_codes(_party_rows(spark, d), ["k"]), rules.SUFFIXES)
    return out.groupBy("code", "status").agg(F.count("*").alias("n"))


O = "o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)"
W = f"{O}, w AS (SELECT k, {', '.join(f'{sql} AS {name}' for name, sql in FEATURES.items())} FROM o)"
M = f"{O}, m AS (SELECT k, {', '.join(f'{sql} AS {name}' for name, sql in MESSAGE.items())} FROM o)"
_TEST = {True: "{} IS TRUE", False: "{} IS FALSE", rules.NOT_TRUE: "{} IS NOT TRUE", rules.OVER_ZERO: "coalesce({}, 0) > 0", rules.OVER_ONE: "coalesce({}, 0) > 1", rules.ZERO: "coalesce({}, 0) = 0", rules.BAD_LENGTH: "coalesce({}, 0) NOT IN (0, 8, 11)"}


def _count(table_, code, parties=None):
    met = [" AND ".join(_TEST[t].format(f"{p}_{f}" if p else f) for f, t in r.tests.items()) for r in table_ if r.code == code for p in r.parties if parties is None or p in parties]
    return " + ".join(f"CAST({x} AS INT)" for x in met) or "0"


def _iban(table_):
    n = {p: _count(table_, "8894", (p,)) for p in ("bnf", "cdt", "dbt")}
    return f"WITH {W}, n AS (SELECT k, {n['bnf']} AS b, {n['cdt']} AS c, {n['dbt']} AS d FROM w) SELECT k, CASE WHEN b > 0 THEN '8894_BNPPTY' WHEN c > 0 THEN '8894_CDTPTY' ELSE '8894_DBTPTY' END AS code, b + c + d AS n FROM n WHERE b + c + d > 0"


def _passes(code, parties):
    must, one = PROGRAM[code]
    value = lambda p, f: f"coalesce({p}_{f}, {f})" if f"{p}_{f}" in FEATURES and f in FEATURES else f"{p}_{f}" if f"{p}_{f}" in FEATURES else f if f in FEATURES else "NULL"
    each = ["(" + " AND ".join([f"{value(p, f)} IS TRUE" for f in must] + ([f"({' OR '.join(f'{value(p, f)} IS NOT TRUE' for f in one)})"] if one else [])) + ")" for p in parties]
    return " OR ".join(each)


def _any(f):
    return "(" + " OR ".join(f"{p}_{f} IS TRUE" for p in ("cdt", "bnf", "dbt", "orig", "send", "intm")) + ")"


LIKELY = f"pr AS (SELECT k, code, round((k * 7 + length(code) * 3 + CAST(substr(code, 4, 1) AS INT)) % 10 / 10, 1) AS p FROM ({PREDICTED}))"
REMOVED = "coalesce(intm_count, 0) >= 1 AND (intm_has_multiple IS TRUE OR intm_count > 1) AND (intm_has_redundant_info IS TRUE OR CAST(intm_entries_share_adr_bank_id IS TRUE AS INT) + CAST(intm_entries_share_country IS TRUE AS INT) + CAST(intm_entries_share_bic_prefix IS TRUE AS INT) >= 2)"
ANY = "(has_intermediary IS TRUE OR intm_present IS TRUE OR coalesce(intm_count, 0) > 0)"
INTERMEDIARY = f"""i AS (SELECT k, '9018' AS code, CASE WHEN {REMOVED} THEN 'fires' ELSE 'cannot_fire' END AS status FROM m
  UNION ALL SELECT k, '9024', CASE WHEN {ANY} AND (intm_has_redundant_info IS TRUE OR intm_has_multiple_types IS TRUE) THEN 'fires' WHEN {ANY} AND intm_has_multiple IS TRUE THEN 'eligible' ELSE 'cannot_fire' END FROM m)"""
TOLD = """CASE WHEN intm_has_multiple IS TRUE AND intm_has_redundant_info IS TRUE THEN 'INTBNK' WHEN cross_party_dup_detected IS TRUE AND dup_first IS NOT NULL AND dup_second IS NOT NULL THEN
  CASE WHEN contains(dup_first, 'bnf') OR contains(dup_second, 'bnf') THEN 'BNFBNK' WHEN contains(dup_first, 'intm') OR contains(dup_second, 'intm') THEN 'INTBNK' WHEN dup_second = 'cdt_wirekey' THEN 'CDTPTY' WHEN dup_first = 'snd_bank' THEN 'SNDBNK' WHEN dup_first = 'dbt_bank' THEN 'DBTPTY' ELSE 'INTBNK' END END"""
MESSAGES = f"g AS (SELECT k, '8007' AS code, NULL AS party FROM m WHERE amount_decimals_valid IS FALSE UNION ALL SELECT k, '8124', NULL FROM m WHERE has_currency AND currency_valid IS FALSE UNION ALL SELECT k, '9018', {TOLD} FROM m WHERE has_duplicate_party_info)"
PARTY_ROWS = "p AS (" + " UNION ALL ".join(_party(i, p).format(o="o") for i, p in enumerate(PARTY_ENDINGS)) + ")"
CHECKS = {
    "8004": "NOT is_bank AND (needs_iban IS TRUE AND has_iban IS NOT TRUE OR has_iban IS TRUE AND (iban_is_attempt IS NOT TRUE OR iban_valid_format IS FALSE))", "8006": "has_country AND country_valid IS FALSE", "8852": None,
    "8894": "has_iban AND iban_is_attempt AND iban_valid_format IS NOT FALSE AND iban_checksum_valid IS FALSE", "8895": "has_nch AND fedaba_checksum_valid IS FALSE",
}
LONG = ("length(name) > 140", "length(CASE WHEN account <> '' THEN account ELSE coalesce(iban, '') END) > 34", "has_long_address")
FOUND = " UNION ALL ".join(f"SELECT k, '{code}' AS code, party FROM p WHERE present AND {test}" for code, tests in CHECKS.items() for test in ([tests] if tests else LONG))
LISTED = ", ".join(f"'{c}'" for c in ("US", *IBAN_LENGTHS))

SQL = {
    "own_reasons": f"WITH {W}, n AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS code, {_count(op.OWN_REASONS, c)} AS n FROM w' for c in CODES)}) SELECT code, count(*) AS fired, CAST(sum(n) AS BIGINT) AS reasons FROM n WHERE n > 0 GROUP BY 1",
    "iban_strict": _iban(op.STRICT_IBAN),
    "iban_loose": _iban(op.LOOSE_IBAN),
    "iban_underivable": f"""WITH {O}, x AS (SELECT k, coalesce(nullif({PICK.format(x='k')}, ''), nullif({PICK.format(x='k + c')}, '')) AS d0, nullif({PICK.format(x='c')}, '') AS t, {_flag(1)} AS has, k % 4 <> 0 AS acc FROM o), y AS (SELECT *, CASE WHEN d0 IN ('NY', 'CA', 'DE') THEN 'US' ELSE d0 END AS d FROM x)
      SELECT k, coalesce(t IS NOT NULL AND has IS NOT TRUE AND acc AND NOT coalesce(d = 'US' AND t = 'US', false) AND (t IN ({LISTED}) OR coalesce(d <> t, t <> 'US')), false) AS fires FROM y""",
    "message_checks": f"WITH {M}, {MESSAGES} SELECT * FROM g",
    "intermediary_checks": f"WITH {M}, {INTERMEDIARY} SELECT *, CAST(CASE status WHEN 'fires' THEN 1.0 WHEN 'eligible' THEN 0.6 ELSE 0.0 END AS DOUBLE) AS confidence FROM i",
    "party_checks": f"WITH {O}, {PARTY_ROWS}, f AS ({FOUND}) SELECT code, party, count(*) AS n, count(DISTINCT k) AS messages FROM f GROUP BY 1, 2",
    "combined_codes": f"""WITH {M}, {INTERMEDIARY}, {MESSAGES}, u AS (SELECT k, code, status FROM i UNION ALL SELECT k, code, 'fires' FROM g WHERE code <> '9018'),
      s AS (SELECT k, status, string_agg(code, ',' ORDER BY code) AS codes FROM u GROUP BY 1, 2) SELECT k, coalesce(max(codes) FILTER (status = 'fires'), '') AS fired, coalesce(max(codes) FILTER (status = 'eligible'), '') AS eligible, coalesce(max(codes) FILTER (status = 'cannot_fire'), '') AS cannot_fire FROM s GROUP BY 1""",
    "semantic_codes": f"WITH {W}, pr AS ({PREDICTED}) SELECT k, code FROM pr JOIN w USING (k) WHERE NOT CASE WHEN left(code, 4) IN ('8004', '8022', '8894') THEN {_any('is_domestic')} AND NOT {_any('is_international')} AND NOT {_any('has_iban')} WHEN left(code, 4) IN ('8895', '8896') THEN {_any('is_international')} AND NOT {_any('is_domestic')} WHEN code = '8001' THEN NOT {_any('has_bic')} ELSE false END",
    "precondition_codes": f"WITH {W}, pr AS ({PREDICTED}) SELECT k, code FROM pr JOIN w USING (k) WHERE CASE code WHEN '8004_BNPPTY' THEN {_passes('8004', ['bnf'])} WHEN '8022' THEN {_passes('8022', op.EVERY_PARTY)} WHEN '8894_CDTPTY' THEN {_passes('8894', ['cdt'])} WHEN '8896' THEN {_passes('8896', op.EVERY_PARTY)} ELSE true END",
    "conflict_codes": f"""WITH {W}, {LIKELY}, f AS (SELECT k, cdt_is_international IS TRUE OR bnf_is_international IS TRUE OR dbt_is_international IS TRUE OR orig_is_international IS TRUE AS intl, greatest(coalesce(cdt_bic_length, 0), coalesce(bnf_bic_length, 0), coalesce(dbt_bic_length, 0), coalesce(orig_bic_length, 0)) AS len FROM w),
      l AS (SELECT k, CASE WHEN intl THEN '8896' ELSE '8894_CDTPTY' END AS code FROM f UNION SELECT a.k, CASE WHEN a.p >= b.p THEN '8022' ELSE '8001' END FROM pr a JOIN pr b ON a.k = b.k WHERE a.code = '8001' AND b.code = '8022' UNION SELECT k, '8001' FROM f WHERE len <= 4)
      SELECT k, code, CAST(p AS DOUBLE) AS p FROM pr WHERE (k, code) NOT IN (SELECT (k, code) FROM l)""",
    "suffixed_codes": f"WITH {PARTY} " + " UNION ALL ".join(f"SELECT '{c}_CDTPTY' AS code, '{'eligible' if c in rules.CONFIDENCE else 'fires'}' AS status, count(*) AS n FROM p WHERE {t}" for c, t in REPAIR.items()),
    "risk_codes": f"WITH {O}, {LIKELY}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, code) AS place FROM pr) SELECT k, code, CAST(p AS DOUBLE) AS p, place FROM r WHERE place <= 3",
}

QUERIES = {f.__name__: f for f in (
    own_reasons, iban_strict, iban_loose, iban_underivable, message_checks, intermediary_checks, party_checks, combined_codes, semantic_codes, precondition_codes, conflict_codes, risk_codes, suffixed_codes,
)}
