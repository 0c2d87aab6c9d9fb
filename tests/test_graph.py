import pytest

from sparquill.operators import graph as op


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("file_1", "file", "payment_system"), ("proc_1", "procedure", "process_payment"), ("proc_2", "procedure", "validate_account"), ("proc_3", "procedure", "check_balance")], "id string, type string, name string")
    edges = spark.createDataFrame([("file_1", "proc_1", "defines"), ("proc_1", "proc_2", "calls"), ("proc_1", "proc_3", "calls"), ("proc_2", "proc_3", "calls")], "src string, dst string, type string")
    return nodes, edges


def test_counts_and_neighbours(small):
    nodes, edges = small
    got = {(r.what, r.kind): r.n for r in op.statistics(nodes, edges).collect()}
    assert got[("node", "procedure")] == 3 and got[("edge", "calls")] == 3 and got[("degree", "average_x1000")] == 2000
    assert {r.neighbour for r in op.neighbours(edges, ["proc_1"], "out", "calls").collect()} == {"proc_2", "proc_3"}


def test_equal_edges_collapse(spark):
    e = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("a", "b", "uses")], "src string, dst string, type string")
    assert op.distinct_edges(e).count() == 2


def test_reach_with_a_cycle_and_exclusions(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "id long")
    assert {r.id: r.depth for r in op.reach(e, start, 9).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    assert {r.id for r in op.reach(e, start, 9, exclude=[4, 1]).collect()} == {1, 2, 3}
    assert sorted(r.path for r in op.simple_paths(e, 1, 5, 6).collect()) == [[1, 2, 3, 4, 5]]


def test_external_placeholders_are_resolved(spark):
    n = spark.createDataFrame([("p1", "x", False), ("e1", "x", True), ("e2", "gone", True), ("c", "c", False)], "id string, name string, is_external boolean")
    e = spark.createDataFrame([("c", "e1", "calls"), ("c", "p1", "calls"), ("c", "e2", "calls")], "src string, dst string, type string")
    nodes, edges = op.resolve_external(n, e)
    assert {r.id for r in nodes.collect()} == {"p1", "e2", "c"}
    assert {(r.src, r.dst) for r in edges.collect()} == {("c", "p1"), ("c", "e2")}


def test_samples_of_a_target_of_all(spark):
    e = spark.range(1, 5001).selectExpr("id AS src", "id % 2 AS dst").unionAll(spark.createDataFrame([(1, 1), (9, 7)], "src long, dst long"))
    got = {r.dst: (r.callers, r.samples) for r in op.common_targets(e, 5, 3).collect()}
    assert got == {0: (2500, [2, 4, 6]), 1: (2501, [1, 3, 5])}
