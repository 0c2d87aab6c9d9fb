"""Payment messages: from nested request and response JSON to party rows, features and codes.

Messages are VARIANT columns; each fact is the first of its alternative paths. Objects that stand where arrays are
expected count as arrays of one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions import identifiers as ids

# Where a message may lie, and the names of parties.
MESSAGE_PATHS = ("$.Request.IFML.File.Message", "$.IFML.File.Message", "$.File.Message", "$.Message", "$")
RESPONSE_PATHS = ("$.Response.IFML.File.Message.AuditTrail", "$.Response.IFML.File.AuditTrail", "$.IFML.File.Message.AuditTrail", "$.IFML.File.AuditTrail")
PARTY_NAMES = {"cdt": ("CreditPartyInf", "CreditPartyInfo"), "dbt": ("DebitPartyInf", "DebitPartyInfo"), "bnf": ("BeneficiaryPartyInf", "BeneficiaryPartyInfo"), "bbk": ("BeneficiaryBankInf", "BeneficiaryBankInfo"), "orig": ("OriginatingPartyInf", "OriginatingPartyInfo"), "intm": ("IntermediaryBankInf", "IntermediaryBankInfo")}
PARTY_HINTS = ("BNFBNK", "BNPPTY", "CDTPTY", "DBTPTY", "INTBNK", "ORGPTY", "SNDBNK")
SERIES = "^[6789][0-9]{3}"


def path(v: Column, *paths: str, kind: str = "string") -> Column:
    """The first of some paths that is there."""
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def as_array(v: Column, *paths: str) -> Column:
    """The elements at the first path that is there; an object is one element; an empty array if none is."""
    some = [F.coalesce(F.try_variant_get(v, p, "array<variant>"), F.when(F.try_variant_get(v, p, "variant").isNotNull(), F.array(F.try_variant_get(v, p, "variant")))) for p in paths]
    return F.coalesce(*some, F.array().cast("array<variant>"))


def located(rows: DataFrame, document: str = "message") -> DataFrame:
    """rows with `body` (the BasicPayment) and `audit` (the response's AuditTrail), null if absent."""
    v = F.col(document)
    body = F.coalesce(*[F.try_variant_get(v, p.rstrip(".") + ".BasicPayment", "variant") for p in MESSAGE_PATHS])
    audit = F.coalesce(*[F.try_variant_get(v, p, "variant") for p in RESPONSE_PATHS])
    return rows.withColumns({"body": body, "audit": audit})


def basics(rows: DataFrame, key: str) -> DataFrame:
    """(key, source_code, msg_type, operation, currency, amount, instructed, amounts_differ): the last amount of a type counts."""
    b = F.col("body")
    amounts = F.transform(as_array(b, "$.MonetaryAmount"), lambda a: F.struct(F.try_variant_get(a, "$['@Type']", "string").alias("type"), F.try_variant_get(a, "$['@Currency']", "string").alias("currency"), ids.amount(F.try_variant_get(a, "$.Amount", "string")).alias("amount")))
    of = lambda t: F.try_element_at(F.filter("amounts", lambda a: a["type"] == t), F.lit(-1))
    r = rows.select(key, path(b, "$.SourceCode").alias("source_code"), path(b, "$.IncomingMsgType").alias("msg_type"), path(b, "$.BankOperationCode").alias("operation"), amounts.alias("amounts"))
    first = F.coalesce(of("Amount"), F.get("amounts", F.lit(0)))
    return r.select(key, "source_code", "msg_type", "operation", first["currency"].alias("currency"), first["amount"].alias("amount"), of("Instructed")["amount"].alias("instructed"), F.coalesce(F.abs(first["amount"] - of("Instructed")["amount"]) > 0.01, F.lit(False)).alias("amounts_differ"))


def parties(rows: DataFrame, key: str) -> DataFrame:
    """(key, party, nr, details): a row for each party found, repeats numbered from 0."""
    roots = ("$.PartyInf", "$.PartyInfo")
    found = []
    for party, names in PARTY_NAMES.items():
        listed = as_array(F.col("body"), *[f"{r}.{n}" for r in roots for n in names])
        found.append(_tagged(listed, party))
    one = rows.select(key, F.explode(F.concat(*found)).alias("p"))
    return one.select(key, "p.party", "p.nr", "p.details")


def _tagged(listed: Column, party: str) -> Column:
    return F.transform(listed, lambda v, k: F.struct(F.lit(party).alias("party"), k.alias("nr"), v.alias("details")))


def party_features(rows: DataFrame, keys: list[str], countries: list[str]) -> DataFrame:
    """The attributes of parties() rows: identifiers, names, addresses, and what the checks say of them."""
    d = F.col("details")
    inner = ("AccountPartyInf", "BasicPartyInf", "AccountPartyInfo", "BasicPartyInfo")
    at = lambda *leaves: path(d, *[f"$.{i}.{leaf}" for i in inner for leaf in leaves], *[f"$.{leaf}" for leaf in leaves])
    id_value = at("ID['#text']", "ID")
    account = at("AcctIDInf.ID['#text']", "AcctIDInf.ID", "WireKey.AcctIDInf.ID['#text']")
    bank = at("AdrBankID['#text']", "AdrBankID")
    lines = F.coalesce(*[F.try_variant_get(d, f"$.{i}.AddressInf", "array<variant>") for i in inner], F.array().cast("array<variant>"))
    r = rows.select(*keys, id_value.alias("id"), account.alias("account"), bank.alias("bank"), at("Name").alias("name"), at("Country").alias("country"), F.size(lines).alias("address_lines"))
    iban = F.when(ids.looks_like_iban(F.col("account")), F.col("account"))
    bic = F.when(ids.looks_like_bic(F.col("bank")), F.col("bank")).when(ids.looks_like_bic(F.col("id")), F.col("id"))
    r = r.withColumns({"iban": iban, "bic": bic})
    parts, part_bic, part_nch = ids.compound_parts(F.col("id"))
    flags = {
        "has_id": F.col("id").isNotNull(), "has_account": F.col("account").isNotNull(), "has_iban": F.col("iban").isNotNull(), "has_bic": F.col("bic").isNotNull(), "has_name": F.col("name").isNotNull(), "account_has_dirty_chars": ids.dirty(F.col("account")),
        "iban_checksum_valid": F.when(F.col("iban").isNotNull(), ids.iban_valid(F.col("iban"))[1]), "bic_valid_country": F.when(F.col("bic").isNotNull(), ids.bic_valid(F.col("bic"), countries)[1]), "id_is_compound": parts > 1, "id_has_bic_and_nch": part_bic & part_nch,
        "bic_iban_country_match": F.substring("bic", 5, 2) == F.upper(F.substring("iban", 1, 2)), "account_type": ids.account_type(F.col("account")),
    }
    return r.withColumns(flags)


def wide(features: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key: party_column for each known party, from its first occurrence."""
    first = features.where("nr = 0")
    every = [F.first(F.when(F.col("party") == p, F.col(c)), ignorenulls=True).alias(f"{p}_{c}") for p in PARTY_NAMES for c in columns]
    return first.groupBy(key).agg(*every)


def intermediaries(features: DataFrame, key: str) -> DataFrame:
    """(key, count, signals, redundant): intermediaries that share a bank id, a country or the first six of a BIC; two signals make them redundant."""
    i = features.where("party = 'intm'")
    shared = lambda c: (F.count(c) > F.count_distinct(c)).cast("int")
    g = i.groupBy(key).agg(F.count("*").alias("count"), (shared(F.col("bank")) + shared(F.col("country")) + shared(F.substring("bic", 1, 6))).alias("signals"))
    return g.withColumn("redundant", F.col("signals") >= 2)


def response_codes(rows: DataFrame, key: str) -> DataFrame:
    """(key, code, severity, party, composite): statuses of the audit trail of series 6 to 9; the party is named or leads the text."""
    s = rows.select(key, F.explode(as_array(F.col("audit"), "$.MsgStatus")).alias("s"))
    info = F.coalesce(path(F.col("s"), "$.InformationalData"), F.lit(""))
    hint = F.nullif(F.regexp_extract(F.upper(info), f"^({'|'.join(PARTY_HINTS)})", 1), F.lit(""))
    r = s.select(key, path(F.col("s"), "$.Code").alias("code"), path(F.col("s"), "$.Severity").alias("severity"), F.coalesce(path(F.col("s"), "$.Party"), hint).alias("party")).where(F.col("code").rlike(SERIES))
    return r.withColumn("composite", F.concat_ws("_", "code", "party"))


def derived_counts(row: DataFrame, suffix: str) -> Column:
    """How many of a wide row's flags party_suffix are true."""
    names = [c for c in row.columns if c.endswith(f"_{suffix}")]
    return reduce(Column.__add__, [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in names], F.lit(0))


def cross_party(parties: DataFrame, key: str) -> DataFrame:
    """(key, originator_country, beneficiary_country, is_cross_border, has_intermediary, has_beneficiary_bank) of party rows (key,
    party: orig, cdt, bnf_bank, intm or others, country, mailing_country): the beneficiary's country is the credit
    party's, else its mailing country, else the beneficiary bank's; unknown countries cross no border.
    """
    of = lambda party, c: F.max(F.when(F.col("party") == party, F.nullif(F.col(c), F.lit(""))))
    has = lambda party: F.max((F.col("party") == party).cast("int")) == 1
    out = parties.groupBy(key).agg(of("orig", "country").alias("originator_country"), F.coalesce(of("cdt", "country"), of("cdt", "mailing_country"), of("bnf_bank", "country")).alias("beneficiary_country"), has("intm").alias("has_intermediary"), has("bnf_bank").alias("has_beneficiary_bank"))
    return out.withColumn("is_cross_border", F.coalesce(F.col("originator_country") != F.col("beneficiary_country"), F.lit(False)))
