from sparquill.operators import mining


def test_folds_are_stored_before_they_are_used(spark):
    rows = spark.range(40).selectExpr("id", "CAST(id % 2 AS DOUBLE) AS y")
    seen = []
    out = mining.cross_validated(mining.stratified_folds(rows, "y", "id", 2), 2, lambda t: seen.append(t._jdf.queryExecution().executedPlan().toString()), lambda _, own: own.selectExpr("'x' AS label", "y = 1 AS truth", "y = 1 AS predicted"))
    assert [tuple(r)[1:4] for r in out.collect()] == [("x", 1.0, 1.0)] * 2
    assert len(seen) == 2 and not any("Window" in p or "Exchange" in p for p in seen)
