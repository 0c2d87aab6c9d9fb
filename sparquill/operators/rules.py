"""Rule programs over party features, as tables of conditions compiled to column expressions.

Features are tri-state: true, false or null (unknown). `IS TRUE` and `IS FALSE` never confuse unknown with false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions.identifiers import IBAN_LENGTHS, cleaned, dirty

NOT_TRUE, OVER_ZERO, OVER_ONE, ZERO, BAD_LENGTH = "not true", "over zero", "over one", "zero or unknown", "known, and neither 8 nor 11"


class Reason:
    """A reason for a code to fire: all tests hold for one of the parties, or for the message if no party is named.

    A test names a feature, and what it must be: True, False (not unknown), or one of the words above.
    """

    def __init__(self, code: str, parties: str, **tests: bool | str):
        self.code, self.parties, self.tests = code, parties.split() or [""], tests

    def label(self, party: str) -> str:
        text = " and ".join(f"{name} is {test}" for name, test in self.tests.items())
        return f"{party.upper()}: {text}" if party else text


# Reasons of the validation codes.
REASONS = [
    Reason("8004", "bnf cdt dbt orig", needs_iban=True, has_iban=NOT_TRUE),
    Reason("8004", "bnf cdt dbt", has_account=True, has_iban=NOT_TRUE),
    Reason("8004", "", missing_required_iban=True),
    Reason("8022", "bnf", has_iban=True),
    Reason("8022", "bnf", needs_iban=True),
    Reason("8022", "bnf", id_has_bic_and_nch=True),
    Reason("8022", "bnf cdt send intm", has_bic=True, bic_valid_country=False),
    Reason("8022", "bnf cdt dbt", account_needs_length_fix=True),
    Reason("8022", "bnf", has_account=True),
    Reason("8026", "bnf cdt dbt orig", needs_iban=True),
    Reason("8026", "bnf cdt dbt", bic_party_country_match=False),
    Reason("8026", "bnf cdt dbt", has_bic=True, has_iban=True, bic_iban_country_match=False),
    Reason("8026", "bnf cdt dbt", has_bic=True, has_iban=True),
    Reason("8026", "bnf cdt dbt", has_iban=True, has_bic=NOT_TRUE),
    Reason("8026", "cdt", is_international=True),
    Reason("8026", "bnf", has_bic=NOT_TRUE, has_iban=NOT_TRUE),
    Reason("8027", "", iban_checksum_valid_count=OVER_ZERO),
    Reason("8027", "", iban_format_valid_count=OVER_ZERO),
    Reason("8027", "bnf", nch_sources=OVER_ZERO),
    Reason("8027", "bnf cdt dbt orig", has_iban=True),
    Reason("8027", "dbt", is_bic_derivable=True),
    Reason("8027", "orig", nch_validation_applicable=True),
    Reason("8027", "cdt", account_has_dirty_chars=True),
    Reason("8027", "bnf", has_iban=NOT_TRUE, account_length=ZERO),
    Reason("8027", "bnf", present=True, has_iban=NOT_TRUE, has_bic=NOT_TRUE, has_account=NOT_TRUE),
    Reason("8029", "bnf", id_has_slash=True),
    Reason("8029", "bnf", id_has_nch_pattern=True),
    Reason("8029", "", has_multiple_nch_sources=True),
    Reason("8029", "cdt dbt", is_international=True),
    Reason("8851", "bnf cdt dbt", account_has_dirty_chars=True),
    Reason("8851", "", nch_validation_applicable=True),
    Reason("8851", "", missing_required_iban=True),
    Reason("8852", "bnf cdt dbt orig", has_iban=True, iban_length_valid=False),
    Reason("8852", "bnf cdt dbt orig", has_length_violation=True),
    Reason("8894", "bnf cdt dbt", account_has_dirty_chars=True),
    Reason("8894", "bnf cdt dbt", has_iban=True, iban_checksum_valid=False),
    Reason("8894", "bnf cdt dbt", needs_iban=True),
    Reason("8894", "dbt", is_international=True),
    Reason("8894", "bnf cdt dbt", has_bic=True, has_iban=True),
    Reason("8895", "", has_invalid_iban=True),
    Reason("8895", "bnf cdt orig dbt", nch_validation_applicable=True),
    Reason("8895", "", bic_iban_mismatch_count=OVER_ZERO),
    Reason("8895", "", total_nch_sources=OVER_ZERO),
]


def holds(feature: Column, test: bool | str) -> Column:
    """Whether a feature, null if unknown, passes a test; never null."""
    if isinstance(test, bool):
        return feature.eqNullSafe(test)
    known = F.coalesce(feature.cast("int"), F.lit(0))
    return {NOT_TRUE: lambda: ~feature.eqNullSafe(True), OVER_ZERO: lambda: known > 0, OVER_ONE: lambda: known > 1, ZERO: lambda: known == 0, BAD_LENGTH: lambda: (known > 0) & ~known.isin(8, 11)}[test]()


def reasons(rows: DataFrame, code: str, table: list[Reason] = REASONS) -> Column:
    """The array of reasons for a code to fire on wide rows (columns party_feature); features that rows lack are unknown."""
    have = set(rows.columns)
    out = []
    for own in table:
        if own.code != code:
            continue
        for party in own.parties:
            names = {f"{party}_{name}" if party else name: test for name, test in own.tests.items()}
            tests = [holds(F.col(name) if name in have else F.lit(None).cast("boolean" if isinstance(test, bool) or test == NOT_TRUE else "int"), test) for name, test in names.items()]
            out.append(F.when(reduce(Column.__and__, tests), F.lit(own.label(party))))
    return F.array_compact(F.array(*out))


def fired_codes(rows: DataFrame, key: str, codes: list[str], table: list[Reason] = REASONS) -> DataFrame:
    """(key, code, reasons): a row for each code that fires."""
    every = F.array(*[F.struct(F.lit(c).alias("code"), reasons(rows, c, table).alias("reasons")) for c in codes])
    return rows.select(key, F.explode(every).alias("r")).where(F.size("r.reasons") > 0).select(key, "r.code", "r.reasons")


def evaluate(features: Column, require_true: Column, require_false: Column) -> Column:
    """fires, eligible or cannot_fire for a map<string,boolean> of features and two arrays of names.

    All of require_true must be true. Of require_false one false value fires; if all are unknown, or there are
    none, the code is eligible; else it cannot fire.
    """
    get = lambda k: F.try_element_at(features, k)
    ready = F.forall(require_true, lambda k: get(k).eqNullSafe(True))
    return F.when(~ready, "cannot_fire").when(F.size(require_false) == 0, "eligible").when(F.exists(require_false, lambda k: get(k).eqNullSafe(False)), "fires").when(F.forall(require_false, lambda k: get(k).isNull()), "eligible").otherwise("cannot_fire")


def evaluate_all(parties: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, status): every rule (code, require_true, require_false, only) for every party row (keys, party, features).

    `only` is the party a rule is for, null for all. A program is small: a party row meets all its rules as one array.
    """
    program = rules.agg(F.collect_list(F.struct("code", "require_true", "require_false", "only")).alias("program"))
    j = parties.join(program).select(*keys, "party", "features", F.inline("program")).where(F.col("only").isNull() | (F.col("only") == F.col("party")))
    return j.select(*keys, "party", "code", evaluate(F.col("features"), F.col("require_true"), F.col("require_false")).alias("status"))


def first_by_party(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, code, status, party): the first party, in order, for which a code fires, else is eligible; nothing else."""
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("party"))
    rank = F.when(F.col("status") == "fires", 0).when(F.col("status") == "eligible", 1)
    best = results.where(rank.isNotNull()).groupBy(*keys, "code").agg(F.min_by(F.struct("status", "party"), F.struct(rank.alias("r"), place.alias("p"))).alias("b"))
    return best.select(*keys, "code", "b.status", "b.party")


def repair_status(rows: DataFrame) -> dict[str, Column]:
    """Status of each repair code for party rows: fires, eligible or null.

    Texts are nch, account, iban and id; flags, unknown where rows lack them, are is_domestic, has_domestic_account,
    has_multiple_ids, id_is_compound, is_clabe, is_fedaba, account_needs_length_fix, nch_in_wrong_field,
    id_has_bic_and_nch, needs_iban, has_bic and derivable (the party's country supports derivation).
    """
    have = set(rows.columns)
    c = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    has = lambda name: F.coalesce(c(name) != "", F.lit(False))
    true = lambda name: F.col(name).eqNullSafe(True) if name in have else F.lit(False)
    clean = lambda name: F.regexp_replace(F.coalesce(c(name), F.lit("")), "[^A-Za-z0-9]", "")
    messy_iban = dirty(c("iban")) | F.coalesce(c("iban") != F.upper(c("iban")), F.lit(False))
    length = F.length(F.regexp_replace(F.coalesce(c("account"), F.lit("")), "[ -]", ""))
    wrong_length = F.when(true("is_clabe"), length != 18).when(true("is_fedaba"), length != 9).otherwise(False)
    fires = {
        "9000": has("nch") & dirty(c("nch")),
        "9002": has("account") & dirty(c("account")) & ~true("is_domestic"),
        "9006": has("iban") & messy_iban,
        "9015": has("account") & dirty(c("account")) & (true("is_domestic") | true("has_domestic_account")),
        "9017": true("has_multiple_ids") | true("id_is_compound"),
        "9019": has("id") & (F.coalesce(c("id").rlike("[^A-Z0-9]"), F.lit(False)) | dirty(c("account"))),
        "9021": has("nch") & true("is_fedaba") & ((F.length(F.regexp_replace(c("nch"), "[ -]", "")) != 9) | dirty(c("nch"))),
        "9022": has("account") & (true("account_needs_length_fix") | wrong_length),
        "9025": true("is_clabe") & ~clean("account").rlike("^[0-9]{18}$"),
        "9028": has("nch") & (true("nch_in_wrong_field") | true("id_has_bic_and_nch")),
    }
    derived = true("needs_iban") & ~has("iban") & has("account") & true("derivable")
    eligible = {"9004": derived, "9005": has("nch") & ~true("has_bic"), "9007": derived, "9008": has("iban") & ~true("has_bic"), "9477": true("is_fedaba") | has("nch"), "9479": true("has_bic"), "9480": true("has_bic")}
    return {k: F.when(v, "fires") for k, v in fires.items()} | {k: F.when(v, "eligible") for k, v in eligible.items()}


#: Confidence of the codes that are only eligible.
CONFIDENCE = {"9004": 0.85, "9005": 0.75, "9007": 0.85, "9008": 0.90, "9477": 0.70, "9479": 0.80, "9480": 0.75}
#: What a party's codes end in.
SUFFIXES = {"orig": "ORGPTY", "send": "SNDBNK", "dbt": "DBTPTY", "cdt": "CDTPTY", "intm": "INTMBNK", "bnf_bank": "BNFBNK", "bnf": "BNPPTY", "acwi": "ACWI", "ordi": "ORDI"}


def repair_codes(parties: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, party, code, status, confidence): repair codes that fire (1.0) or are eligible."""
    every = F.array(*[F.struct(F.lit(k).alias("code"), v.alias("status"), F.lit(CONFIDENCE.get(k, 1.0)).alias("confidence")) for k, v in repair_status(parties).items()])
    return parties.select(*keys, "party", F.explode(every).alias("r")).where("r.status IS NOT NULL").select(*keys, "party", "r.code", "r.status", "r.confidence")


def iban_length_valid(iban: Column) -> Column:
    """Whether an IBAN has its country's length; null for countries without one."""
    s = cleaned(iban)
    known = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    return F.length(s) == F.try_element_at(known, F.substring(s, 1, 2))


def duplicate_party_values(parties: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, first, second, bic): the first pair of parties, in order, that share a BIC."""
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("party"))
    p = parties.where("bic IS NOT NULL").select(*keys, "bic", "party", place.alias("place"))
    a, b = p.alias("a"), p.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "bic"]]) & (F.col("a.place") < F.col("b.place"))
    pairs = a.join(b, same).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.struct("a.place", F.col("b.place").alias("place2")).alias("o"), F.struct(F.col("a.party").alias("first"), F.col("b.party").alias("second"), F.col("a.bic").alias("bic")).alias("v"))
    return pairs.groupBy(*keys).agg(F.min_by("v", "o").alias("v")).select(*keys, "v.*")


def exclusive(predictions: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """predictions (keys, code, p) without those that an exclusive, likelier code of the same keys beats; ties: the smaller code stays."""
    both = pairs.select("code1", "code2").unionAll(pairs.select(F.col("code2"), F.col("code1")))
    a = predictions.join(both, predictions.code == F.col("code1")).select(*keys, "code", "p", F.col("code2").alias("other"))
    b = predictions.select(*keys, F.col("code").alias("other"), F.col("p").alias("q"))
    losers = a.join(b, [*keys, "other"]).where((F.col("q") > F.col("p")) | (F.col("q") == F.col("p")) & (F.col("other") < F.col("code"))).select(*keys, "code").distinct()
    return predictions.join(losers, [*keys, "code"], "left_anti")


def compare_codes(predicted: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(code, tp, fp, fn, precision, recall, f1) of two (keys, code) tables; 0 where a denominator is."""
    p = predicted.select(*keys, "code").distinct().withColumn("p", F.lit(1))
    a = actual.select(*keys, "code").distinct().withColumn("a", F.lit(1))
    j = p.join(a, [*keys, "code"], "full").groupBy("code").agg(F.count_if(F.col("p").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("a").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return j.select("code", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))
