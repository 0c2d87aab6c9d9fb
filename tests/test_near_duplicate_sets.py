import random

from sparquill.operators import search as op


def test_near_duplicate_classes_like_brute_force(spark):
    rng = random.Random(5)
    docs = []
    for _ in range(40):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 7, 20, 60, 400]))]
        for _ in range(4):
            docs.append((len(docs), " ".join(w if rng.random() > 0.06 else f"x{rng.randrange(9)}" for w in base)))
    sets = {k: frozenset(t.split()) for k, t in docs}
    first = {}
    for k, w in sets.items():
        first.setdefault(w, k)
    want = {(k, first[w], 1.0) for k, w in sets.items() if first[w] != k}
    want |= {(a, b, round(len(v & w) / len(v | w), 9)) for v, a in first.items() for w, b in first.items() if b < a and len(v & w) / len(v | w) >= 0.85}
    got = {(r.doc_id, r.other, round(r.similarity, 9)) for r in op.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and any(s < 1 for *_, s in want)


def test_pairs_end_at_their_sketches(spark):
    """Sets that share words of their prefixes but differ in others leave the join on terms by their sketches, before they meet whole sets."""
    docs = spark.range(500).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 10), x -> 'c' || x), transform(sequence(1, 90), x -> 'r' || pmod(xxhash64(id, x), 3000))) AS text")
    out = op.near_duplicate_classes(docs)
    assert "bit_count" in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 0


def test_pairs_meet_in_blocks_not_with_whole_sets(spark, monkeypatch):
    """Thirty near copies of each of four long texts, and many texts that share their frequent words: no pair carries a set to another task, whether copies fill one block or many."""
    rng = random.Random(6)
    docs = []
    for _ in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(900)]
        docs += [[w if rng.random() > 0.03 else f"x{rng.randrange(2000)}" for w in base] for _ in range(30)]
    docs += [[f"w{min(rng.randrange(3000), rng.randrange(3000))}" for _ in range(900)] for _ in range(40)]
    sets = [frozenset(w) for w in docs]
    want = {(a, b) for a, v in enumerate(sets) for b, w in enumerate(sets[:a]) if len(v & w) / len(v | w) >= 0.85}
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    for most in ((1_000, 500_000), (7, 500_000), (1_000, 2_000)):
        monkeypatch.setattr(op, "MET", most, raising=False)
        out = op.near_duplicate_classes(rows)
        assert {(r.doc_id, r.other) for r in out.collect()} == want and len(want) > 1000
        assert "array_intersect" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c"), (1, "c b a"), (None, "a b c"), (None, "z"), (4, "b a c c"), (5, None), (6, "")]
    got = op.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(4, 1, 1.0)]
    assert op.near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
