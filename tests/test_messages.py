import json

import pytest

from sparquill.operators import messages as op
from sparquill.sources import tables

MESSAGE = {"T1": {
    "Request": {"IFML": {"File": {"Message": {"BasicPayment": {
        "SourceCode": "SWF", "IncomingMsgType": "103", "MonetaryAmount": [{"@Type": "Amount", "@Currency": "USD", "Amount": "1,000.50"}, {"@Type": "Instructed", "@Currency": "EUR", "Amount": "900"}],
        "PartyInf": {"CreditPartyInf": {"AccountPartyInf": {"ID": {"@Type": "B", "#text": "DEUTDEFF"}, "AcctIDInf": {"ID": {"#text": "GB82WEST12345698765432"}}, "Name": "A", "Country": "DE", "AddressInf": [{"Seq": "1", "text": "x"}]}},
                     "IntermediaryBankInf": [{"BasicPartyInf": {"AdrBankID": "CHASUS33", "Country": "US"}}, {"BasicPartyInf": {"AdrBankID": "CHASUS33", "Country": "US"}}]}}}}}},
    "Response": {"IFML": {"File": {"Message": {"AuditTrail": {"MsgStatus": [{"Code": "8004", "Severity": "E", "InformationalData": "BNPPTY IBAN missing"}, {"Code": "1234"}]}}}}},
}, "T2": {"Request": {"IFML": {"File": {"Message": {"BasicPayment": {"MonetaryAmount": {"@Type": "Amount", "Amount": "x"}}}}}}}}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("messages")
    (folder / "a.json").write_text(json.dumps(MESSAGE))
    return op.located(tables.payment_messages(spark, str(folder)))


def test_basics(rows):
    got = {r.txn_id: r for r in op.basics(rows, "txn_id").collect()}
    assert (got["T1"].source_code, got["T1"].currency, got["T1"].amount, got["T1"].instructed, got["T1"].amounts_differ) == ("SWF", "USD", 1000.5, 900.0, True)
    assert got["T2"].amount == 0.0 and got["T2"].instructed is None


def test_parties_and_intermediaries(rows):
    features = op.party_features(op.parties(rows, "txn_id"), ["txn_id", "party", "nr"], ["DE", "US"])
    got = {(r.party, r.nr): r for r in features.collect()}
    assert set(got) == {("cdt", 0), ("intm", 0), ("intm", 1)}
    c = got[("cdt", 0)]
    assert c.bic == "DEUTDEFF" and c.has_iban and c.iban_checksum_valid and c.bic_valid_country and not c.bic_iban_country_match and c.address_lines == 1
    (i,) = op.intermediaries(features, "txn_id").collect()
    assert (i["count"], i.signals, i.redundant) == (2, 3, True)
    wide = op.wide(features, "txn_id", ["has_bic", "has_name"]).first()
    assert wide.cdt_has_bic and wide.cdt_has_name and wide.dbt_has_bic is None


def test_codes(rows):
    assert [tuple(r) for r in op.response_codes(rows, "txn_id").collect()] == [("T1", "8004", "E", "BNPPTY", "8004_BNPPTY")]


def test_files_and_graph_json(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.TAL").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "y.bin").write_text("z")
    got = {r.path.rsplit("/", 1)[1]: (r.file_type, r.text) for r in tables.files(spark, str(tmp_path)).collect()}
    assert got == {"x.TAL": ("code", "café"), "y.bin": ("unknown", "z")}
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"entities": [{"id": "a", "type": "procedure"}], "relationships": [{"source": {"id": "a"}, "target_id": "b", "type": "calls"}]}))
    nodes, edges = tables.graph_json(spark, str(g))
    assert nodes.first().id == "a" and tuple(edges.select("source", "target", "type", "weight").first()) == ("a", "b", "calls", 1.0)


def test_index_is_pruned_by_term(spark, tmp_path):
    from sparquill.operators import search

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    tables.write_index(search.postings(docs), str(tmp_path / "i"), 4)
    got = tables.read_terms(spark, str(tmp_path / "i"), ["a", "c"], 4)
    assert sorted((r.term, r.doc_id, r.pos) for r in got.collect()) == [("a", 1, 0), ("a", 1, 2), ("c", 2, 1)]


def test_rules_as_a_stream(spark, tmp_path):
    from sparquill.operators import rules
    from sparquill.streaming import rules as stream

    schema = "k long, party string, nch string, account string, iban string, id string, is_domestic boolean, has_multiple_ids boolean, is_clabe boolean, needs_iban boolean, has_bic boolean, derivable boolean"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"k": 1, "party": "cdt", "nch": "02-1", "account": "1 2", "id": "A/B"}))
    stream.write_repairs(stream.party_stream(spark, str(tmp_path / "in"), schema), ["k"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = rules.repair_codes(spark.read.schema(schema).json(str(tmp_path / "in")), ["k"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
