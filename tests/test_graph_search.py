import random

from sparquill.operators import graph as op
from sparquill.operators import ranking


def components(edges):
    """Strongly connected groups of two nodes or more, by what reaches what."""
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    return {frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes} - {frozenset([n]) for n in nodes}


def test_strong_components_are_those_of_reachability(spark):
    rng = random.Random(3)
    for n, m in ((12, 14), (60, 75), (40, 120)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        found = {}
        for r in op.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect():
            found.setdefault(r.component, set()).add(r.id)
        assert {frozenset(g) for g in found.values()} == components(edges)


def test_no_cycles_no_components(spark):
    assert op.strong_components(spark.createDataFrame([(1, 2), (2, 3), (4, 4)], "src long, dst long")).count() == 0
    assert op.strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_flows_follow_breadth_first_order(spark):
    edges = [(1, 3), (1, 2), (1, 4), (2, 5), (3, 5), (3, 6), (5, 1)] + [(6, k) for k in range(10, 40)]
    nodes = spark.createDataFrame([(k,) for k in range(1, 41)], "id long")
    rows = op.process_flows(nodes, spark.createDataFrame(edges, "src long, dst long")).where("entry = 1").orderBy("place").collect()
    assert [r.id for r in rows][:6] == [1, 2, 3, 4, 5, 6] and len(rows) == 20 and [r.decision for r in rows][:6] == [True, False, False, False, False, True]


def test_blocks_are_found_by_equal_part_or_similar_lines(spark):
    docs = spark.createDataFrame([(1, "x\nalpha beta\ngamma delta eps\nz"), (2, "nothing\nhere"), (3, "q\n  alpha beta\nand gamma delta eps too"), (4, "")], "doc_id long, text string")
    found = {r.doc_id: r.start for r in ranking.matching_blocks(docs, ["alpha beta", "gamma delta eps"]).collect()}
    assert found[1] == 1 and found[3] == 1 and 2 not in found


def test_blocks_like_a_plain_search(spark):
    rng, words = random.Random(5), ["Red", "blue", "green", "tea", "x"]
    lines = lambda: [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4]))) + rng.choice(["", " "]) for _ in range(rng.randrange(7))]
    texts = ["\n".join(lines()) for _ in range(150)] + [None, "", "\n"]

    def plain(text, sought, share):
        at = [x.strip(" ") for x in text.split("\n")]
        def like(x, want):
            a, b = set(x.lower().split()), set(want.lower().split())
            return want in x or x in want or len(a & b) / len(a | b) > 0.7
        return next((k for k in range(len(at)) if sum(k + j < len(at) and like(at[k + j], w) for j, w in enumerate(sought)) >= len(sought) * share), None)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sought, share in ((["red blue green tea"], 0.7), (["Red blue", "green"], 0.7), (["Red blue", "green tea x", "x"], 0.6), (["x", "tea", "Red green blue"], 1.0), ([], 0.7)):
        want = {k: p for k, t in enumerate(texts) if t is not None and (p := plain(t, sought, share)) is not None}
        assert {r.doc_id: r.start for r in ranking.matching_blocks(docs, sought, share).collect()} == want


def test_blocks_in_a_text_of_many_lines(spark):
    """A step for each line, and not one for each pair of lines."""
    import time

    docs = spark.range(1).selectExpr("id AS doc_id", "concat(array_join(transform(sequence(1, 20000), k -> concat('line ', k)), '\\n'), '\\nalpha beta\\ngamma') AS text")
    began = time.perf_counter()
    assert [tuple(r) for r in ranking.matching_blocks(docs, ["alpha beta", "gamma"]).collect()] == [(0, 20_000)] and time.perf_counter() - began < 30
