from sparquill.operators import parties as op


def test_an_iban_replaces_what_is_none_and_nothing_else(spark):
    rows = [(1, 1, "123", None, None), (1, 2, "GB82 WEST 1234 5698 7654 32", "late", "GB"), (1, 3, "DE89370400440532013000", "later", "DE"), (2, 5, "DE89370400440532013000", "a", "DE"), (2, 6, "GB82WEST12345698765432", "b", "GB"), (3, 1, None, "x", None), (3, 2, "77", "y", None), (4, 1, None, None, None)]
    got = {r.k: r for r in op.merged(spark.createDataFrame(rows, "k int, n int, account string, name string, country string"), ["k"], "n", "account", ["name"], ["country"]).collect()}
    assert (got[1].account, got[1].account_type, got[1].iban_country, got[1].needs_formatting, got[1].name, got[1].country, got[1].occurrences) == ("GB82 WEST 1234 5698 7654 32", "IBAN", "GB", True, None, "GB", 3)
    assert (got[2].account, got[2].iban_valid, got[2].name) == ("DE89370400440532013000", True, "a")
    assert (got[3].account, got[3].account_type, got[3].name) == (None, None, "x") and got[4].account is None and got[4].iban_valid is False
