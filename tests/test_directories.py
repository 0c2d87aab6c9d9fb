import datetime as dt

from sparquill.operators import directories as op


def test_formats_become_one_directory(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Routing_Number;Bank_Name;Status\n021000021;One;\n12;Bad;active\n ;None;active\n")
    (tmp_path / "b.json").write_text('[{"swift": "deutdeff500", "name": "Two", "status": "Inactive"}, {"swift": "X", "name": "Bad"}]')
    aba, bad = op.read_csv(spark, str(tmp_path / "a.csv"), "aba", ";")
    bic, worse = op.read_json(spark, str(tmp_path / "b.json"), "bic", {"code": "swift", "bank_name": "name"})
    got = {(r.kind, r.code): (r.bank_name, r.country, r.status) for r in op.directory([aba, bic]).collect()}
    assert got == {("aba", "021000021"): ("One", "US", "active"), ("bic", "DEUTDEFF"): ("Two", "DE", "inactive")}
    assert bad.count() == 2 and [r.name for r in worse.collect()] == ["Bad"]


def test_lookup_by_day_and_order_of_checks(spark):
    day = dt.date
    held = spark.createDataFrame([("aba", "021000021", "Old", "US", None, "active", day(2000, 1, 1), day(2009, 12, 31)), ("aba", "021000021", "New", "US", None, "closed", day(2010, 1, 1), None), ("bic", "DEUTDEFF", "D", "DE", None, "active", None, None)], ", ".join(f"{c} {t}" for c, t in op.SCHEMA.items()))
    rows = [(1, "nch", "021000021", "us", day(2005, 5, 5)), (2, "nch", "0210 00021", "US", day(2020, 1, 1)), (3, "nch", "021000021", "US", day(1999, 1, 1)), (4, "nch", "021000021", "US", None), (5, "nch", "021000022", "US", None), (6, "bic", "deutdeff500", None, None), (7, "bic", "DEUTDEF", "DE", None), (8, "bic", "AAAADEFF", "DE", None), (9, "nch", "10-20-30", "GB", None), (10, "nch", "x", "FR", None), (11, "nch", None, "US", None), (12, "nch", "12345", "DE", None), (1, "nch", "021000021", "us", day(2005, 5, 5))]
    got = sorted((r.key, r.exists, r.message, r.bank_name) for r in op.lookup(spark.createDataFrame(rows, "key int, kind string, code string, country string, day date"), held, ["aba", "bic"]).collect() if r.key != 11)
    assert got == [(1, True, None, "Old"), (1, True, None, "Old"), (2, False, "inactive", "New"), (3, False, "unknown", None), (4, False, "inactive", "New"), (5, False, "checksum", None), (6, True, None, "D"), (7, False, "format", None), (8, False, "unknown", None), (9, True, "not loaded", None), (10, True, "no directory for the country", None), (12, False, "format", None)]
    assert op.lookup(spark.createDataFrame([(1, "nch", None, "US", None)], "key int, kind string, code string, country string, day date"), held, ["aba"]).first().message == "empty"
