"""Nodes, rebuilt documents, moves, features and repairs, against plain Python on documents made here."""

import json
import random

import pytest

from sparquill.functions import json as fn
from sparquill.operators import repair_features as rf
from sparquill.operators import repairs as op

PAYMENTS = {
    1: {"source": "SWF", "cdtrAgt": {"FinInstnId": {"BIC": "DEUTDEFF", "Nm": "A BANK", "PstlAdr": {"AdrLine": ["12 Main St", "NEW YORK NY 10001"], "Ctry": "DE"}}}, "flags": {"stp_failed": True, "autotrieve": False}},
    2: {"clearing": "CHIPS", "cdtrAgt": {"FinInstnId": {"ClrSysMmbId": {"ClrSysId": "USABA", "MmbId": "021000021"}}}, "dbtr": {"CtryOfRes": "us", "Nm": None}, "cdtrAcct": {"IBAN": "GB82 WEST 1234 5698 7654 32"}, "x": [], "y": ""},
    3: {"rmtInf": {"Ustrd": ["INV #" + "9" * 150, 7]}, "dbtrAgt": {"a": [{"BICFI": "CHASUS33XXX"}, {"BICFI": "CHASUS33"}], "b": [["bic inside"]]}, "cdtr": "text"},
    4: {},
}


def walk(doc, at=(), path="", top=None, name=None, member=False):
    items = sorted(doc.items()) if isinstance(doc, dict) else enumerate(doc)
    for k, (key, v) in enumerate(items):
        inside = isinstance(doc, dict)
        own = key.lower() if inside else name if member else None
        where = (f"{path}.{key}" if path else key) if inside else f"{path}[{k}]"
        yield (*at, k), where, top or (own if inside else None), own, inside, v
        if isinstance(v, (dict, list)):
            yield from walk(v, (*at, k), where, top or (own if inside else None), own, inside)


def docs(spark, found):
    return spark.createDataFrame([(k, None if d is None else json.dumps(d)) for k, d in found.items()], "k long, doc string")


def test_nodes(spark):
    got = {(r.k, tuple(r["at"]), r.path, r.top, r.name, r.member) for r in fn.nodes(docs(spark, PAYMENTS), "k", "doc").collect()}
    assert got == {(k, *x[:5]) for k, d in PAYMENTS.items() for x in walk(d)}
    assert fn.nodes(spark.createDataFrame([(1, None), (2, "{"), (3, "[]")], "k long, doc string"), "k", "doc").count() == 0


def values(doc, field):
    return [v for *_, name, _, v in walk(doc) if name and field in name and not isinstance(v, (dict, list)) and v is not None]


def test_features_of_single_payments(spark):
    n = fn.nodes(docs(spark, PAYMENTS), "k", "doc")
    got = {r.k: r for r in rf.vector(rf.facts(n, "k"), "k").collect()}
    assert len(rf.names()) == 172 and list(got[1].asDict()) == ["k", *rf.names()] and set(got) == {1, 2, 3}
    for k, r in got.items():
        d = PAYMENTS[k]
        for field, name in (("bic", "bic_has_bic"), ("mmbid", "clearing_has_clearing"), ("nm", "name_has_bank_name"), ("iban", "iban_has_iban"), ("ctry", "country_has_country"), ("ustrd", "remittance_has_ustrd"), ("fininstnid", "fininstn_has_fininstnid")):
            assert r[name] == float(bool(values(d, field))), (k, name)
        for e in ("cdtr", "dbtr", "cdtrAgt", "dbtrAgt", "rmtInf"):
            assert r[f"entity_has_{e}"] == float(e in d)
        assert r.structure_total_leaf_values == pytest.approx(sum(not isinstance(x[-1], (dict, list)) for x in walk(d)) / 80)
        assert r.structure_max_nesting_depth == pytest.approx(max(len(x[0]) for x in walk(d)) / 10)
        assert all(0 <= v <= 1 for v in r[1:])
    a, b, c = got[1], got[2], got[3]
    assert (a.bic_length_8, a.bic_valid_format, a.bic_country_matches, a.bic_in_cdtrAgt, a.bic_in_dbtrAgt, a.flags_stp_failed, a.flags_autotrieve, a.flags_count, a.metadata_source_swf) == (1, 1, 1, 1, 0, 1, 0, 0.1, 1)
    assert (a.address_has_zip, a.address_has_street, a.address_has_city, a.address_line_count, a.name_contains_bank_keywords, a.name_all_caps, a.fininstn_in_cdtrAgt) == (1, 1, 1, 0.4, 1, 1, 1)
    assert (b.clearing_type_usaba, b.clearing_has_clearing_no_bic, b.clearing_id_length, b.iban_valid_format, b.country_in_dbtr, b.country_code_valid, b.metadata_clearing_chips, b.name_has_bank_name, b.structure_has_empty_fields) == (1, 1, 0.6, 1, 1, 1, 1, 0, 1)
    assert (c.bic_multiple_bics, c.bic_length_11, c.remittance_needs_split, c.remittance_multiline, c.structure_has_arrays, c.entity_has_cdtr) == (1, 1, 1, 1, 1, 1)


def test_other_tables_of_features(spark):
    n = fn.nodes(docs(spark, PAYMENTS), "k", "doc")
    own = {"own": {"long_remittance": "length(text_ustrd) > 100", "bics": "least(n_bic / 2.0, 1.0)"}}
    assert rf.mentioned(own) == ["n_bic", "text_ustrd"]
    assert {r.k: (r.own_long_remittance, r.own_bics) for r in rf.vector(rf.facts(n, "k", own), "k", own).collect()} == {1: (0, 0.5), 2: (0, 0), 3: (1, 1)}


def test_rebuilt(spark):
    rng = random.Random(5)

    def tree(deep):
        return {f"k{rng.randint(0, 4)}": tree(deep - 1) if deep and rng.random() < 0.6 else rng.choice([1, "a\"b\\", None, [1, {"z": 2}], {}, "é"]) for _ in range(rng.randint(1, 3))}

    want = {k: tree(3) for k in range(30)}

    def leaves(d, path=()):
        for k, v in d.items():
            yield from leaves(v, (*path, k)) if isinstance(v, dict) and v else [((*path, k), v)]

    rows = [(k, list(p), json.dumps(v)) for k, d in want.items() for p, v in leaves(d)]
    got = fn.rebuilt(spark.createDataFrame(rows, "k long, path array<string>, value string"), "k")
    assert {r.k: json.loads(r.document) for r in got.collect()} == want


def test_moves_are_whole_subtrees(spark):
    before = {"a": {"x": {"p": 1, "q": 2}, "same": 5, "twice": 7}, "b": {"twice": 7}, "gone": 3}
    after = {"c": {"x": {"p": 1, "q": 2}, "twice": 7}, "a": {"same": 5}, "new": {"twice": 7}, "other": 3}
    both = [fn.nodes(docs(spark, {1: d}), "k", "doc") for d in (before, after)]
    got = sorted((r.name, r.from_path, r.to_path) for r in fn.moves(*both, "k").collect())
    assert got == [("twice", "a.twice", "c.twice"), ("twice", "b.twice", "new.twice"), ("x", "a.x", "c.x")]


FACTS = "k long, n_bic int, n_iban int, n_mmbid int, n_nm int, n_ctry int, n_adrline int, chars_adrline int, longest_ustrd int, entities array<string>"


def test_conditions_and_order_of_repairs(spark):
    facts = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 4, 10, None, ["dbtr"]), (2, 0, 1, 1, 1, 0, 0, None, 141, ["cdtr"]), (3, 0, 1, 0, 0, 0, 1, 141, 3, []), (4, 1, 1, 1, 1, 1, 1, 9, 9, ["dbtr"])], FACTS)
    rules = [
        (1, "6036", "Address lines", "", 0.3), (2, "9001", "adrline again", "", 0.4), (3, "9002", "third address", "", 0.5), (4, "9003", "Remittance", "has_bic", 0.9), (5, "9004", "x", "has_bic AND has_name AND has_bic", 0.95),
        (6, "9005", "x", "NOT has_bic", 0.99), (7, "9006", "x", "NOT has_name", 1.0), (8, "9007", "x", "changes_in_DBTR AND has_bic", 1.0), (9, "9008", "x", "not has_country or bic", 1.0), (10, "9009", "x", "has_iban", 1.0), (11, "9010", "x", "has_bic", 0.949),
    ]
    frame = spark.createDataFrame(rules, "nr int, repair_id string, description string, condition string, confidence double")
    got = {r.k: [(x.repair_id, x.confidence, x.rule) for x in r.repairs] for r in op.predicted(facts, frame, "k", op.F.col("entities")).collect()}
    assert got == {
        1: [("6021", 1, "country from bic"), ("6036", 1, "name from bic"), ("9001", 0.4, "address"), ("9007", 1, "discovered")],
        2: [("6035", 1, "bic from clearing"), ("9003", 0.9, "remittance"), ("6021", 0.95, "country from iban"), ("9005", 0.99, "discovered"), ("9006", 1, "discovered"), ("9008", 1, "discovered")],
        3: [("6036", 0.3, "address"), ("6021", 0.95, "country from iban"), ("9005", 0.99, "discovered"), ("9008", 1, "discovered")],
        4: [("9004", 0.95, "discovered"), ("9006", 1, "discovered"), ("9007", 1, "discovered")],
    }


def test_before_states(spark):
    found = {1: {"CDTRAGT": {"before": {"a": [1, {"b": None}]}, "after": {"a": 2}}, "dbtr": {"n": "x\"y"}, "rmtinf": "text", "source": "S", "flags": {"f": True}, "zz": {"before": {}}}, 2: {"zz": 1}, 3: None}
    got = {r.k: json.loads(r.document) for r in op.before_states(docs(spark, found), "k", "doc").collect()}
    assert got == {1: {"cdtrAgt": {"a": [1, {"b": None}]}, "dbtr": {"n": "x\"y"}, "source": "S", "flags": {"f": True}}, 2: {}}


def test_changes(spark):
    rows = [
        (1, "cdtrAgt", {"MmbId": "1", "a": {"b": 1}, "l": [1]}, {"ClrSysId": {"MmbId": "1"}, "a": {"b": 2}, "l": [2], "Bic": "x"}), (1, "dbtr", None, {"a": 1}), (1, "cdtr", {"a": 1}, {}), (2, "dbtr", None, {}), (2, "dbtrAgt", {"a": 1}, {"a": 1}),
    ]
    frame = spark.createDataFrame([(k, e, b and json.dumps(b), a if a is None else json.dumps(a)) for k, e, b, a in rows], "k long, entity string, before string, after string")
    changed = op.changes(frame, ["k"])
    got = {(r.k, r.entity): (r.added, r.removed, r.changed, r.structure, r.total, r.signature) for r in changed.collect()}
    both = ["mmbid_restructured", "clearing_structure_added"]
    assert got == {
        (1, "cdtrAgt"): (["Bic", "ClrSysId", "ClrSysId.MmbId"], ["MmbId"], ["a", "a.b", "l"], both, 9, "cdtrAgt:added:3,removed:1,changed:3," + ",".join(both)), (1, "dbtr"): ([], [], [], ["entity_added"], 1, "dbtr:entity_added"),
        (1, "cdtr"): ([], [], [], ["entity_removed"], 1, "cdtr:entity_removed"), (2, "dbtr"): ([], [], [], [], 0, "dbtr:"), (2, "dbtrAgt"): ([], [], [], [], 0, "dbtrAgt:"),
    }
    v = {r.k: r for r in op.change_features(changed, "k").collect()}
    assert (v[1].added, v[1].removed, v[1].cdtrAgt_changes, v[1].dbtr_added, v[1].cdtrAgt_restructured, v[1].bic_added, v[1].nm_added) == (0.3, 0.1, 1, 1, 1, 1, 0)
    repairs = spark.createDataFrame([(1, "6021"), (1, "6035"), (2, "6021")], "k long, repair_id string")
    assert op.change_patterns(changed, repairs, "k").where("signature = 'dbtr:entity_added'").count() == 2
