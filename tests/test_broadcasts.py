"""Joins of tables that grow with the input are never broadcast, however small their files look."""

from sparquill.functions import json
from sparquill.operators import code, graph, keywords
from sparquill.operators import validation


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("BroadcastExchange")


def test_settled_conflicts_broadcast_only_the_pairs(spark):
    predicted = spark.createDataFrame([(1, "8001", 0.5), (1, "8022", 0.4), (2, "8001", 0.1), (2, "8022", 0.9), (3, "8001", 0.1)], "k long, code string, p double")
    features = spark.createDataFrame([(1, True, 5)], "k long, cdt_is_international boolean, cdt_bic_length int")
    pairs = spark.createDataFrame([("8001", "8022", "")], "code1 string, code2 string, hint string")
    out = validation.settled_conflicts(predicted, features, pairs, "k")
    assert sorted((r.k, r.code) for r in out.collect()) == [(1, "8001"), (2, "8022"), (3, "8001")]
    assert broadcasts(out) <= 1


def test_calls_broadcast_nothing(spark):
    rows = code.lines(spark.createDataFrame([("f", "PROC a;\nBEGIN\n  CALL b;\nEND;\nPROC b;\nBEGIN\n  a(1);\nEND;")], "file string, text string"))
    out = code.calls(rows, code.procedures(rows))
    assert sorted((r.procedure, r.target, r.kind) for r in out.collect()) == [("a", "B", "call"), ("b", "A", "function")]
    assert broadcasts(out) == 0


def test_moves_broadcast_nothing(spark):
    docs = spark.createDataFrame([(1, '{"a": {"x": 1}}', '{"b": {"x": 1}}'), (2, '{"p": {"x": 1, "y": 2}}', '{"p": {"y": 2}, "q": {"x": 1}}')], "k long, b string, a string")
    out = json.moves(json.nodes(docs, "k", "b"), json.nodes(docs, "k", "a"), "k")
    assert sorted((r.k, r.from_path, r.to_path) for r in out.collect()) == [(1, "a.x", "b.x"), (2, "p.x", "q.x")]
    assert broadcasts(out) == 0


def test_words_are_not_dealt_by_keyword(spark):
    """A frequent keyword's places must not meet in one task: only what is counted by document is dealt."""
    docs = spark.createDataFrame([(1, "the a the"), (1, "the of"), (2, "The"), (None, "the"), (3, None)], "doc_id long, text string")
    dim = keywords.taxonomy(spark, [("the", "x", "low"), ("the", "y", "low"), ("of", "x", "high"), ("none", "x", "low")])
    facts = keywords.mappings(docs, dim, 2)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "hashpartitioning(keyword" in plan and "doc_id" in plan.split("hashpartitioning(keyword")[1].split(")")[0]
    assert sorted(map(tuple, keywords.coverage(facts).collect())) == [("of", 1, 1, "1"), ("the", 2, 8, "1,2")]
    got = {(r.kind, r["name"], r.keyword): (r.n, r.docs) for r in keywords.inverted_index(facts).collect()}
    assert got[("total", "the", "the")] == (8, 2) and got[("category", "y", "the")] == (4, 2) and got[("document", "1", "the")] == (4, 1) and got[("document", None, "the")] == (2, 0) and got[("priority", "high", "of")] == (1, 1)


def test_components_broadcast_nothing(spark, monkeypatch):
    seen, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, *a, **k: seen.append(broadcasts(df)) or real(df, *a, **k))
    out = graph.strong_components(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5)], "src long, dst long"))
    groups = {}
    for r in out.collect():
        groups.setdefault(r.component, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[1, 2], [3, 4]]
    assert len(seen) > 5 and sum(seen) == 0 and broadcasts(out) == 0
