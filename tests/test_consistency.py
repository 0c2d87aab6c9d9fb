from sparquill.operators import inspection


def test_one_pass_over_parties(spark):
    schema = "k long, iban string, account string, nch string, bic string, is_clabe boolean, countries array<string>"
    rows = [(1, "gb 1", "a", None, "deutde", False, ["de", "DE", "long"]), (1, "GB-1", "b", "", "deutfr", True, []), (1, None, None, "n", "x", None, None), (2, "", "", "", "", False, ["fr", "de", "us"]), (2, "x", "c", "m", "abcd", True, ["us"]), (2, "y", "c", "m", "ABCD", True, None)]
    out = inspection.global_features(spark.createDataFrame(rows, schema), "k")
    got = {r.k: tuple(r)[1:] for r in out.collect()}
    assert got == {1: (2, True, 2, False, 1, True, 2, True, 1, True, 1, True), 2: (2, False, 2, True, 2, True, 2, True, 2, True, 3, False)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Expand" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
