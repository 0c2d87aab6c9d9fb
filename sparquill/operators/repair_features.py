"""Feature vectors of nested payments, compiled from a table of conditions.

A feature is a name and a SQL condition over facts. The facts that the conditions mention are read off their names
and taken from all nodes of a document in one aggregation; the features are then one projection. So hundreds of
features cost one pass, and another table of features needs no code.

Facts, for a field f (all keys that contain f, in any case), an entity e (a key at the top) and a flag g:

    n_f         how many values        first_f   the first of them       text_f    all, joined by spaces
    kinds_f     different values       cases_f   different ones in upper case
    f_in_e      whether e has a value  f_under_e whether e has such a key
    has_e       whether e is there     top_e     its text, lower case    flag_g    whether flags.g is true
    flags_true, fields, leaves, depth, arrays, empties, entities, agents, parties: counts over the whole
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The groups, names and limits of the features.
_AGENTS = ["cdtrAgt", "dbtrAgt", "instgAgt", "instdAgt"]
_SIDES = ["cdtr", "dbtr"]
_CLEARED = "first_clrsysid"
_CAPITALS = "(upper({0}) = {0} AND lower({0}) <> {0})"
_BANK_WORDS = "'bank|trust|federal|credit union|n\\\\.a\\\\.|association'"


def _within(field: str, entities: list[str]) -> dict[str, str]:
    return {f"in_{e}": f"{field}_in_{e.lower()}" for e in entities}


FEATURES: dict[str, dict[str, str]] = {
    "bic": {
        "has_bic": "n_bic > 0", "length_8": "length(first_bic) = 8", "length_11": "length(first_bic) = 11",
        "valid_format": "length(first_bic) IN (8, 11) AND regexp_like(first_bic, '^[A-Za-z]{6}[A-Za-z0-9]{2}')",
        **_within("bic", _AGENTS), "has_country_code": "length(first_bic) >= 6",
        "country_matches": "length(first_bic) >= 6 AND contains(concat(' ', upper(text_ctry), ' '), concat(' ', upper(substring(first_bic, 5, 2)), ' '))",
        **_within("bic", _SIDES), "multiple_bics": "n_bic > 1", "format_xxx": "length(first_bic) = 8", "format_xxxxxxxxxxx": "length(first_bic) = 11",
    },
    "iban": {
        "has_iban": "n_iban > 0", "valid_format": "length(replace(first_iban, ' ', '')) >= 15 AND regexp_like(replace(first_iban, ' ', ''), '^[A-Za-z]{2}[0-9]{2}')",
        "length_valid": "length(first_iban) BETWEEN 15 AND 34", **_within("iban", ["cdtrAcct", "dbtrAcct"]), "country_code": "regexp_like(first_iban, '^[A-Za-z]{2}')",
        "country_matches": "length(first_iban) >= 2 AND contains(concat(' ', upper(text_ctry), ' '), concat(' ', upper(substring(first_iban, 1, 2)), ' '))",
        "has_iban_no_bic": "n_iban > 0 AND n_bic = 0", "starts_with_letters": "regexp_like(first_iban, '^[A-Za-z]{2}')", "multiple_ibans": "n_iban > 1",
    },
    "clearing": {
        "has_clearing": "n_mmbid > 0", **_within("mmbid", _AGENTS[:3]), "type_usaba": f"contains(lower({_CLEARED}), 'usaba')", "type_fedwire": f"contains(lower({_CLEARED}), 'fed')",
        "type_chips": f"contains(lower({_CLEARED}), 'chips')", "type_other": f"{_CLEARED} <> '' AND NOT regexp_like(lower({_CLEARED}), 'usaba|fed|chips')",
        "has_clearing_no_bic": "n_mmbid > 0 AND n_bic = 0", "has_both": "n_mmbid > 0 AND n_bic > 0", "id_length": "least(length(first_mmbid) / 15.0, 1.0)", "has_system_code": "n_clrsysid > 0 OR n_cd > 0",
    },
    "name": {
        "has_bank_name": "n_nm > 0", "has_party_name": "n_nm > 0", **_within("nm", _AGENTS + _SIDES), "missing_has_bic": "n_nm = 0 AND n_bic > 0", "missing_party": "n_nm = 0",
        "contains_bank_keywords": f"regexp_like(lower(first_nm), {_BANK_WORDS})", "all_caps": _CAPITALS.format("first_nm"), "length_short": "length(first_nm) BETWEEN 1 AND 19",
        "length_medium": "length(first_nm) BETWEEN 20 AND 50", "length_long": "length(first_nm) > 50", "multiple": "n_nm > 1", "has_special_chars": "regexp_like(first_nm, '[^a-zA-Z0-9 ]')", "numeric": "regexp_like(first_nm, '[0-9]')",
    },
    "address": {
        "has_address": "n_adrline > 0", "has_postal": "n_pstladr > 0", "has_structured": "false", **_within("adrline", _AGENTS + _SIDES), "missing_has_bic": "n_adrline = 0 AND n_bic > 0", "multiline": "n_adrline > 1",
        "has_country": "regexp_like(text_adrline, '\\\\b[A-Z]{2}\\\\b')", "has_city": "regexp_like(text_adrline, '[A-Z][a-z]+')", "has_state": "regexp_like(text_adrline, '\\\\b[A-Z]{2}\\\\b')",
        "has_zip": "regexp_like(text_adrline, '[0-9]{5}')", "has_street": "regexp_like(text_adrline, '[0-9]+\\\\s+\\\\w+')", "line_count": "least(n_adrline / 5.0, 1.0)", "total_length": "least(length(text_adrline) / 200.0, 1.0)",
        "needs_standardization": "length(text_adrline) > 140 OR n_adrline > 3", "has_po_box": "regexp_like(lower(text_adrline), 'p\\\\.o\\\\. box|po box')",
    },
    "country": {
        "has_country": "n_ctry > 0", **_within("ctryofres", [*_AGENTS[:3], *_SIDES]), "in_address": "n_ctry > 0", "missing_has_bic": "n_ctry = 0 AND n_bic > 0", "missing_has_iban": "n_ctry = 0 AND n_iban > 0",
        "code_valid": "regexp_like(coalesce(first_ctryofres, first_ctry), '^[A-Za-z]{2}$')", "code_length_2": "length(coalesce(first_ctryofres, first_ctry)) = 2", "multiple": "kinds_ctry > 1", "mismatch": "cases_ctry > 1",
        "from_bic_available": "length(first_bic) >= 6", "from_iban_available": "length(first_iban) >= 2",
    },
    "account": {
        "has_cdtrAcct": "has_cdtracct", "has_dbtrAcct": "has_dbtracct", "has_id": "n_id > 0", "has_type": "n_tp > 0", "type_iban": "contains(lower(first_tp), 'iban')", "type_other": "regexp_like(lower(first_tp), 'othr|other')",
        "type_proprietary": "contains(lower(first_tp), 'prtry')", "has_currency": "n_ccy > 0", "currency_usd": "upper(first_ccy) = 'USD'", "currency_eur": "upper(first_ccy) = 'EUR'",
        "currency_other": "upper(first_ccy) NOT IN ('USD', 'EUR', '')", "multiple": "has_cdtracct AND has_dbtracct",
    },
    "entity": {
        **{f"has_{e}": f"has_{e.lower()}" for e in [*_SIDES, *_AGENTS, "intrmyAgt1", "intrmyAgt2"]}, "has_intrmyAgt": "has_intrmyagt1 OR has_intrmyagt2", "has_rmtInf": "has_rmtinf",
        "has_creditor_side": "has_cdtr OR has_cdtragt", "has_debtor_side": "has_dbtr OR has_dbtragt", "has_instructing_side": "has_instgagt", "has_instructed_side": "has_instdagt",
        "entity_count": "least((" + " + ".join(f"CAST(has_{e} AS INT)" for e in ["cdtr", "dbtr", "cdtragt", "dbtragt", "instgagt", "instdagt", "intrmyagt1", "intrmyagt2", "rmtinf"]) + ") / 10.0, 1.0)",
    },
    "fininstn": {
        "has_fininstnid": "n_fininstnid > 0", "in_multiple_entities": " + ".join(f"CAST(fininstnid_under_{e.lower()} AS INT)" for e in _AGENTS) + " > 1",
        "has_bic": "bic_in_fininstnid", "has_clearing": "mmbid_in_fininstnid", "has_name": "nm_in_fininstnid", "has_address": "adrline_in_fininstnid",
        "complete": "n_fininstnid > 0 AND (" + " OR ".join(f"fininstnid_under_{e.lower()}" for e in _AGENTS) + ")", "incomplete": "n_fininstnid > 0 AND NOT (" + " OR ".join(f"fininstnid_under_{e.lower()}" for e in _AGENTS) + ")",
        "in_cdtrAgt": "fininstnid_under_cdtragt", "in_dbtrAgt": "fininstnid_under_dbtragt",
    },
    "remittance": {
        "has_rmtInf": "n_ustrd > 0 OR n_strd > 0", "has_ustrd": "n_ustrd > 0", "has_strd": "n_strd > 0", "length": "least(length(text_ustrd) / 200.0, 1.0)", "needs_split": "length(text_ustrd) > 140", "multiline": "n_ustrd > 1",
        "has_invoice": "contains(lower(text_ustrd), 'inv')", "has_reference": "regexp_like(lower(text_ustrd), 'ref|#')", "all_caps": _CAPITALS.format("text_ustrd"), "has_numbers": "regexp_like(text_ustrd, '[0-9]')",
        "has_special_chars": "regexp_like(text_ustrd, '[^a-zA-Z0-9 ]')", "line_count": "least(n_ustrd / 5.0, 1.0)",
    },
    "metadata": {
        "source_swf": "top_source = 'swf'", "source_fed": "top_source IN ('fed', 'fedwire')", "source_chips": "top_source = 'chips'", "source_other": "top_source NOT IN ('', 'swf', 'fed', 'fedwire', 'chips')",
        "clearing_fed": "top_clearing IN ('fed', 'fedwire')", "clearing_chips": "top_clearing = 'chips'", "clearing_swift": "top_clearing = 'swift'", "clearing_other": "top_clearing NOT IN ('', 'fed', 'fedwire', 'chips', 'swift')",
    },
    "flags": {
        **{g: f"flag_{g}" for g in ["ace_repairs", "autotrieve", "stp_failed", "repair_queue", "exception_queue", "verify_queue", "ignored_party", "credit_party_inserted", "non_ace_repairs"]}, "count": "least(flags_true / 10.0, 1.0)",
    },
    "structure": {
        "total_fields": "least(fields / 100.0, 1.0)", "total_entities": "least(entities / 15.0, 1.0)", "total_leaf_values": "least(leaves / 80.0, 1.0)", "max_nesting_depth": "least(depth / 10.0, 1.0)", "has_arrays": "arrays > 0",
        "array_count": "least(arrays / 10.0, 1.0)", "has_empty_fields": "empties > 0", "empty_field_ratio": "least(CAST(empties AS DOUBLE) / greatest(fields, 1), 1.0)", "field_density": "least(CAST(leaves AS DOUBLE) / greatest(fields, 1), 1.0)",
        "entity_balance": "1.0 - CAST(abs(agents - parties) AS DOUBLE) / greatest(agents + parties, 1)", "agent_to_party_ratio": "least(CAST(agents AS DOUBLE) / greatest(parties, 1), 2.0) / 2.0",
        "has_complete_routing": "n_bic > 0 OR n_mmbid > 0", "has_partial_routing": "(n_bic > 0) <> (n_mmbid > 0)", "complexity_score": "least(entities * depth / 50.0, 1.0)", "data_completeness": "1.0 - CAST(empties AS DOUBLE) / greatest(fields, 1)",
    },
}


def names(features: dict[str, dict[str, str]] = FEATURES) -> list[str]:
    """The features' columns in order: group and name."""
    return [f"{group}_{name}" for group, own in features.items() for name in own]


def mentioned(features: dict[str, dict[str, str]]) -> list[str]:
    """The facts that conditions mention, sorted."""
    every = " ".join(re.sub(r"'[^']*'", "", c) for own in features.values() for c in own.values())
    found = set(re.findall(r"\b(?:(?:n|first|text|kinds|cases|has|top|flag)_\w+|\w+_(?:in|under)_\w+|flags_true|fields|leaves|depth|arrays|empties|entities|agents|parties)\b", every))
    return sorted(found)


_SCALAR = "kind NOT IN ('object', 'array', 'null')"
_COUNTS = {
    "flags_true": "count_if(top = 'flags' AND size(at) = 2 AND " + _SCALAR + " AND value NOT IN ('', 'false', '0'))",
    "fields": "count_if(member AND kind NOT IN ('object', 'array'))", "leaves": "count_if(kind NOT IN ('object', 'array'))", "depth": "max(size(at))", "arrays": "count_if(member AND kind = 'array')",
    "empties": "count_if(member AND (kind = 'null' OR value = '' OR (kind = 'array' AND value = '[]')))", "entities": "count_if(size(at) = 1 AND kind = 'object')",
    "agents": "count_if(size(at) = 1 AND contains(top, 'agt'))", "parties": "count_if(size(at) = 1 AND top IN ('cdtr', 'dbtr'))",
}


def _fact(name: str) -> Column:
    """The aggregate over a document's nodes that a fact's name stands for."""
    if name in _COUNTS:
        return F.expr(_COUNTS[name])
    if m := re.fullmatch(r"(\w+)_(in|under)_(\w+)", name):
        field, where, entity = m.groups()
        return F.expr(f"coalesce(bool_or(top = '{entity}' AND {'size(at) > 1 AND ' + _SCALAR if where == 'in' else 'size(at) > 1'} AND contains(name, '{field}')), false)")
    kind, of = name.split("_", 1)
    if kind == "has":
        return F.expr(f"coalesce(bool_or(top = '{of}'), false)")
    if kind == "top":
        return F.expr(f"coalesce(max(CASE WHEN top = '{of}' AND size(at) = 1 AND {_SCALAR} THEN lower(value) END), '')")
    if kind == "flag":
        return F.expr(f"coalesce(bool_or(top = 'flags' AND size(at) = 2 AND name = '{of}' AND {_SCALAR} AND value NOT IN ('', 'false', '0')), false)")
    own = f"{_SCALAR} AND contains(name, '{of}')"
    return F.expr({
        "n": f"count_if({own})", "first": f"min_by(CASE WHEN {own} THEN value END, CASE WHEN {own} THEN at END)",
        "text": f"array_join(transform(array_sort(collect_list(CASE WHEN {own} THEN struct(at, value) END)), x -> x.value), ' ')",
        "kinds": f"count(DISTINCT CASE WHEN {own} THEN value END)", "cases": f"count(DISTINCT CASE WHEN {own} THEN upper(value) END)",
    }[kind])


def facts(nodes: DataFrame, key: str, features: dict[str, dict[str, str]] = FEATURES) -> DataFrame:
    """One row for each document of json.nodes(): all facts that the features mention, by one aggregation."""
    return nodes.groupBy(key).agg(*[_fact(name).alias(name) for name in mentioned(features)])


def vector(found: DataFrame, key: str, features: dict[str, dict[str, str]] = FEATURES) -> DataFrame:
    """The features of facts(), from 0 to 1: one projection. What is unknown is 0."""
    kinds = dict(found.selectExpr(*[f"{c} AS `{group}_{name}`" for group, own in features.items() for name, c in own.items()]).dtypes)
    numbers = [F.coalesce(F.expr(c).cast("int" if kinds[f"{group}_{name}"] == "boolean" else "double").cast("double"), F.lit(0.0)).alias(f"{group}_{name}") for group, own in features.items() for name, c in own.items()]
    return found.select(key, *numbers)
