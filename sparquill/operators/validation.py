"""Validation codes of messages and their parties, and filters on predicted codes.

Wide rows hold a message's features, those of a party as party_feature; long rows have one party each. All checks
are column expressions on one row, so a table of messages is scanned once for all codes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions.identifiers import IBAN_LENGTHS
from sparquill.operators.rules import BAD_LENGTH, NOT_TRUE, OVER_ONE, OVER_ZERO, ZERO, Reason, reasons

# The narrower reasons of each code's own check.
OWN_REASONS = [
    Reason("8022", "bnf", has_iban=True),
    Reason("8022", "bnf", needs_iban=True),
    Reason("8022", "bnf", id_has_bic_and_nch=True),
    Reason("8022", "bnf cdt send intm", has_bic=True, bic_valid_country=False),
    Reason("8022", "bnf", has_account=True),
    Reason("8026", "bnf cdt orig dbt intm", needs_iban=True),
    Reason("8026", "bnf cdt dbt", has_bic=True, has_iban=True, bic_party_country_match=False),
    Reason("8026", "bnf cdt dbt", has_bic=True, has_iban=True, bic_iban_match=False),
    Reason("8026", "bnf cdt dbt", has_bic=True, has_iban=NOT_TRUE),
    Reason("8026", "bnf cdt dbt", has_iban=True, has_bic=NOT_TRUE),
    Reason("8026", "bnf cdt dbt", has_bic=True, has_iban=True),
    Reason("8026", "cdt", is_international=True),
    Reason("8026", "bnf", has_bic=NOT_TRUE, has_iban=NOT_TRUE),
    Reason("8027", "", iban_checksum_valid_count=OVER_ZERO),
    Reason("8027", "bnf cdt dbt orig", has_iban=True),
    Reason("8027", "bnf", nch_sources=OVER_ZERO),
    Reason("8027", "bnf", has_iban=NOT_TRUE, account_length=ZERO),
    Reason("8027", "bnf", present=True, has_iban=NOT_TRUE, has_bic=NOT_TRUE),
    Reason("8029", "", primary_amount=False),
    Reason("8029", "bnf", id_has_slash=True),
    Reason("8029", "bnf", id_has_nch_pattern=True),
    Reason("8029", "", has_multiple_nch_sources=True),
    Reason("8029", "cdt dbt", is_international=True),
    Reason("8851", "cdt bnf dbt", account_has_dirty_chars=True),
    Reason("8851", "", nch_validation_applicable=True),
    Reason("8851", "", has_instructed_amount=True),
    Reason("8851", "bnf", has_account=True, has_bic=True, has_name=True),
    Reason("8851", "dbt", nch_valid=True),
    Reason("8852", "bnf cdt dbt orig", has_iban=True, iban_length_valid=False),
    Reason("8852", "bnf cdt dbt orig", has_length_violation=True),
    Reason("8852", "orig", present=True),
    Reason("8852", "bnf cdt dbt", account_length=OVER_ZERO),
    Reason("8852", "bnf cdt dbt send intm", bic_length=BAD_LENGTH),
    Reason("8895", "", has_invalid_iban=True),
    Reason("8895", "", bic_iban_mismatch_count=OVER_ZERO),
    Reason("8895", "bnf cdt dbt orig", nch_valid=False),
    Reason("8895", "bnf cdt dbt", has_nch=True, nch_valid=False),
    Reason("8895", "", total_nch_sources=OVER_ONE),
    Reason("8895", "", dbt_is_domestic=True, has_nch_issue=True),
    Reason("8895", "bnf cdt dbt", nch_sources=OVER_ZERO, bic_iban_match=False),
    Reason("8895", "", invalid_nch_format=True),
    Reason("8896", "bnf", iban_valid_format=True),
    Reason("8896", "bnf", is_international=True),
    Reason("8896", "bnf", has_id=True),
    Reason("8896", "", missing_bnf_bic=True),
    Reason("8896", "bnf", has_bic=True, bic_valid_format=False),
    Reason("8896", "", missing_required_iban=True),
    Reason("8896", "bnf", needs_iban=True),
    Reason("8896", "bnf", has_bic=True),
]
# Reasons of an invalid IBAN, by direct evidence alone, and for few misses.
STRICT_IBAN = [
    Reason("8894", "bnf cdt dbt", has_iban=True, iban_checksum_valid=False),
    Reason("8894", "bnf cdt dbt", account_has_dirty_chars=True),
    Reason("8894", "bnf cdt dbt", has_iban=True, iban_length_valid=False),
    Reason("8894", "bnf cdt dbt", has_iban=True, iban_country_valid=False),
    Reason("8894", "bnf cdt dbt", has_iban=True, iban_format_valid=False),
]
LOOSE_IBAN = [
    Reason("8894", "bnf cdt dbt", has_iban=True, iban_checksum_valid=False),
    Reason("8894", "bnf cdt dbt", account_has_dirty_chars=True),
    Reason("8894", "bnf cdt dbt", needs_iban=True),
    Reason("8894", "dbt", is_international=True),
    Reason("8894", "bnf cdt dbt", has_bic=True, has_iban=True),
]
# Two-letter codes of states and territories, which count as US in a debtor's country.
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ "
    "NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR VI GU AS MP"
).split()
# Most characters of a party's name and account; the codes that each semantic test is for.
MOST_NAME, MOST_ACCOUNT = 140, 34
IBAN_CODES, DOMESTIC_CODES, BIC_CODES = ("8004", "8022", "8894"), ("8895", "8896"), ("8001", "8005", "8006")
# The party that a code's ending stands for.
ENDINGS = {"ORGPTY": "orig", "SNDBNK": "send", "DBTPTY": "dbt", "CDTPTY": "cdt", "INTBNK": "intm", "BNFBNK": "bnf", "BNPPTY": "bnf"}
EVERY_PARTY = ("orig", "send", "dbt", "cdt", "intm", "bnf", "ordi", "acwi")


def invalid_iban(rows: DataFrame, key: str, table: list[Reason] = STRICT_IBAN) -> DataFrame:
    """(key, code, reasons): 8894 with the ending of the first party, of bnf, cdt and dbt, that has a reason."""
    found = rows.select(key, reasons(rows, "8894", table).alias("reasons")).where(F.size("reasons") > 0)
    has = lambda party: F.exists("reasons", lambda r: F.startswith(r, F.lit(f"{party}:")))
    ending = F.when(has("BNF"), "BNPPTY").when(has("CDT"), "CDTPTY").when(has("DBT"), "DBTPTY").otherwise("BNFBNK")
    return found.select(key, F.concat(F.lit("8894_"), ending).alias("code"), "reasons")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def underivable_iban(debtor: Column, originator: Column, creditor: Column, has_iban: Column, has_account: Column) -> Column:
    """Whether 8004 fires: a creditor with a country and an account but no IBAN, unless both sides are in the US; a country
    with IBANs, or the US, suffices, any other one must differ from the debtor's, else the originator's, country.
    """
    own = F.coalesce(_filled(debtor), _filled(originator))
    own = F.when(own.isin(*STATES), "US").otherwise(own)
    ready = _filled(creditor).isNotNull() & ~has_iban.eqNullSafe(True) & has_account.eqNullSafe(True) & ~(own.eqNullSafe("US") & (creditor == "US"))
    crossing = F.coalesce(own != creditor, creditor != "US")
    return F.coalesce(ready & (creditor.isin("US", *IBAN_LENGTHS) | crossing), F.lit(False))


def _codes(rows: DataFrame, keys: list[str], checks: list[tuple[str, Column, Column]]) -> DataFrame:
    every = F.array(*[F.struct(F.lit(code).alias("code"), party.alias("party"), test.alias("fires")) for code, party, test in checks])
    return rows.select(*keys, F.explode(every).alias("c")).where("c.fires").select(*keys, "c.code", "c.party")


def duplicate_tag(first: Column, second: Column) -> Column:
    """The party that a duplicate of two is told of: a beneficiary's bank, else an intermediary's, else by the second's, the first's name."""
    has = lambda c, text: F.coalesce(F.contains(c, F.lit(text)), F.lit(False))
    known = lambda c: F.when(c == "snd_bank", "SNDBNK").when(c == "dbt_bank", "DBTPTY").when(c == "cdt_wirekey", "CDTPTY")
    return F.when(has(first, "bnf") | has(second, "bnf"), "BNFBNK").when(has(first, "intm") | has(second, "intm"), "INTBNK").otherwise(F.coalesce(known(second), known(first), F.lit("INTBNK")))


def message_codes(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, party) of messages (amount_decimals_valid, has_currency, currency_valid, has_duplicate_party_info,
    intm_has_multiple, intm_has_redundant_info, cross_party_dup_detected, dup_first, dup_second): 8007 too many decimals,
    8124 an invalid currency, 9018 a duplicate party with the one it is told of, null if unknown.
    """
    c, none = F.col, F.lit(None).cast("string")
    is_ = lambda name, value=True: c(name).eqNullSafe(value)
    redundant = is_("intm_has_multiple") & is_("intm_has_redundant_info")
    crossed = is_("cross_party_dup_detected") & c("dup_first").isNotNull() & c("dup_second").isNotNull()
    told = F.when(redundant, "INTBNK").when(crossed, duplicate_tag(c("dup_first"), c("dup_second")))
    return _codes(messages, keys, [("8007", none, is_("amount_decimals_valid", False)), ("8124", none, is_("has_currency") & is_("currency_valid", False)), ("9018", told, is_("has_duplicate_party_info"))])


def party_codes(parties: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, party) of party rows (party: its ending, is_bank, present, needs_iban, has_iban, iban_is_attempt,
    iban_valid_format, iban_checksum_valid, has_country, country_valid, name, account, iban, has_long_address, has_nch,
    fedaba_checksum_valid): 8004 no IBAN to be had, 8006 an invalid country, 8852 a text too long (once for each), 8894 an
    IBAN of the right length with a wrong checksum, 8895 an invalid routing number. Unknown checks count as passed.
    """
    c, party = F.col, F.col("party")
    is_ = lambda name, value=True: c(name).eqNullSafe(value)
    length = lambda column: F.coalesce(F.length(column), F.lit(0))
    failed = is_("iban_valid_format", False)
    checks = [
        ("8004", party, ~is_("is_bank") & (is_("needs_iban") & ~is_("has_iban") | is_("has_iban") & (~is_("iban_is_attempt") | failed))),
        ("8006", party, is_("has_country") & is_("country_valid", False)),
        ("8852", party, length(c("name")) > MOST_NAME),
        ("8852", party, length(F.coalesce(_filled(c("account")), c("iban"))) > MOST_ACCOUNT),
        ("8852", party, is_("has_long_address")),
        ("8894", party, is_("has_iban") & is_("iban_is_attempt") & ~failed & is_("iban_checksum_valid", False)),
        ("8895", party, is_("has_nch") & is_("fedaba_checksum_valid", False)),
    ]
    return _codes(parties.where("present"), keys, checks)


def intermediary_status(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, status, confidence) of messages (intm_count, has_intermediary, and the flags intm_...) for the two codes
    about all intermediaries: 9018, one is removed as its information is redundant or two of three signals agree; 9024,
    one is pushed up as there is redundancy or several types, or may be if there are several (0.6).
    """
    is_ = lambda name: F.col(name).eqNullSafe(True)
    count = F.coalesce("intm_count", F.lit(0))
    signals = reduce(Column.__add__, [is_(f"intm_entries_share_{x}").cast("int") for x in ("adr_bank_id", "country", "bic_prefix")])
    several = is_("intm_has_multiple") | (count > 1)
    removed = F.when((count >= 1) & several & (is_("intm_has_redundant_info") | (signals >= 2)), "fires").otherwise("cannot_fire")
    any_ = is_("has_intermediary") | is_("intm_present") | (count > 0)
    pushed = F.when(any_ & (is_("intm_has_redundant_info") | is_("intm_has_multiple_types")), "fires").when(any_ & is_("intm_has_multiple"), "eligible").otherwise("cannot_fire")
    every = F.array(F.struct(F.lit("9018").alias("code"), removed.alias("status")), F.struct(F.lit("9024").alias("code"), pushed.alias("status")))
    out = messages.select(*keys, F.explode(every).alias("c")).select(*keys, "c.code", "c.status")
    return out.withColumn("confidence", F.when(F.col("status") == "fires", 1.0).when(F.col("status") == "eligible", 0.6).otherwise(0.0))


def combined(results: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, fired, eligible, cannot_fire) of results (keys, code, status): sorted codes, each by the first result that has it."""
    every = None
    for k, df in enumerate(results):
        own = df.select(*keys, "code", "status", F.lit(k).alias("nr"))
        every = own if every is None else every.unionAll(own)
    rank = F.when(F.col("status") == "fires", 0).when(F.col("status") == "eligible", 1).otherwise(2)
    first = every.groupBy(*keys, "code").agg(F.min_by("status", F.struct("nr", rank)).alias("status"))
    listed = lambda status: F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("code")))).alias({"fires": "fired"}.get(status, status))
    return first.groupBy(*keys).agg(*map(listed, ("fires", "eligible", "cannot_fire")))


def semantic_filter(predicted: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """predicted (key, code) without codes that make no sense for the message (key and flags party_feature): IBAN codes of a
    domestic payment without IBAN, domestic codes of an international one, BIC codes without a BIC. A message without
    features keeps what needs no BIC.
    """
    flag = lambda f: reduce(Column.__or__, [F.col(f"{p}_{f}").eqNullSafe(True) for p in ("cdt", "bnf", "dbt", "orig", "send", "intm") if f"{p}_{f}" in features.columns], F.lit(False))
    flags = features.select(key, *[flag(f).alias(f"any_{f}") for f in ("is_domestic", "is_international", "has_iban", "has_bic")])
    j = predicted.join(flags, key, "left")
    any_ = lambda f: F.coalesce(f"any_{f}", F.lit(False))
    base = F.element_at(F.split("code", "_"), 1)
    dropped = F.when(base.isin(*IBAN_CODES), any_("is_domestic") & ~any_("is_international") & ~any_("has_iban")).when(base.isin(*DOMESTIC_CODES), any_("is_international") & ~any_("is_domestic")).when(base.isin(*BIC_CODES), ~any_("has_bic")).otherwise(False)
    return j.where(~dropped).select(*predicted.columns)


def precondition_filter(predicted: DataFrame, features: DataFrame, key: str, program: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """predicted (key, code[_ending]) whose preconditions some party meets; codes without any stay.

    program: code to the features that must all be true and those of which one must be false or unknown. A feature
    of a party is its own, else the message's. A code with an ending is for that party alone.
    """
    have = set(features.columns)

    def value(party: str, name: str) -> Column:
        known = [F.col(f"m.{c}") for c in (f"{party}_{name}", name) if c in have]
        return F.coalesce(*known) if known else F.lit(None).cast("boolean")

    base, ending = F.element_at(F.split("code", "_"), 1), F.get(F.split("code", "_"), F.lit(1))
    named = F.when(reduce(Column.__or__, [ending == e for e in ENDINGS]), ending)
    met = F.lit(True)
    for code, (must, one_false) in program.items():
        if not must and not one_false:
            continue
        passes = F.lit(False)
        for party in EVERY_PARTY:
            own = reduce(Column.__and__, [value(party, f).eqNullSafe(True) for f in must], F.lit(True))
            if one_false:
                own = own & reduce(Column.__or__, [~value(party, f).eqNullSafe(True) for f in one_false])
            passes = passes | own & (named.isNull() | named.isin(*[e for e, p in ENDINGS.items() if p == party]))
        met = F.when(base == code, passes).otherwise(met)
    return predicted.join(features.alias("m"), key, "left").where(met).select(*[predicted[c] for c in predicted.columns])


def settled_conflicts(predicted: DataFrame, features: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """predicted (key, code, p) without the loser of each exclusive pair (code1, code2, hint): by the hint is_international an
    international payment loses 8896 and any other 8894, by bic_length a BIC of at most four characters loses 8001 and
    any other 8005; where the hint names none of the two none is lost; without a hint the less likely one, code2 if equal.
    """
    wide = lambda f, kind: [F.coalesce(F.col(f"{p}_{f}").cast(kind), F.lit(0).cast(kind)) for p in ("cdt", "bnf", "dbt", "orig") if f"{p}_{f}" in features.columns]
    flags = features.select(key, F.greatest(*wide("is_international", "int"), F.lit(0)).alias("intl"), F.greatest(*wide("bic_length", "int"), F.lit(0)).alias("bic_len"), F.lit(True).alias("known"))
    a = predicted.select(key, F.col("code").alias("code1"), F.col("p").alias("p1"))
    b = predicted.select(key, F.col("code").alias("code2"), F.col("p").alias("p2"))
    # Well packed files look small, so without these hints a side with all payments may be broadcast.
    met = a.join(F.broadcast(pairs), "code1").join(b.hint("merge"), [key, "code2"]).join(flags.hint("merge"), key, "left")
    base1, base2 = (F.element_at(F.split(c, "_"), 1) for c in ("code1", "code2"))
    unwanted = F.when(F.contains("hint", F.lit("is_international")), F.when(F.coalesce("intl", F.lit(0)) > 0, "8896").otherwise("8894")).when(F.contains("hint", F.lit("bic_length")), F.when(F.coalesce("bic_len", F.lit(0)) <= 4, "8001").otherwise("8005"))
    likelier = F.when(F.col("p1") >= F.col("p2"), F.col("code2")).otherwise(F.col("code1"))
    loser = F.when(F.coalesce("hint", F.lit("")) == "", likelier).when(base2 == unwanted, F.col("code2")).when(base1 == unwanted, F.col("code1"))
    return predicted.join(met.select(key, loser.alias("code")).where("code IS NOT NULL").distinct().hint("merge"), [key, "code"], "left_anti")


def top_risks(predicted: DataFrame, key: str, n: int = 5) -> DataFrame:
    """predicted (key, code, p): each key's n likeliest codes with their places, without codes that begin with two underscores."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "code"))
    return predicted.where(~F.startswith("code", F.lit("__"))).withColumn("place", place).where(F.col("place") <= n)


def suffixed(results: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """results (party, code, status, ...) with the party's ending on each code that fires or is eligible."""
    ending = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in suffixes.items() for x in kv]), F.col("party")), F.lit("UNKNOWN"))
    return results.withColumn("code", F.when(F.col("status").isin("fires", "eligible"), F.concat_ws("_", "code", ending)).otherwise(F.col("code")))
