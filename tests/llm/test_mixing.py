from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from sparquill.llm import mixing as op
from sparquill.llm.common import read


def brute_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, excess, open_ = {s: 0.0 for s in names}, share * sum(sizes.values()), list(names)
    while excess > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / total
        excess = sum(max(0.0, target[s] - most * sizes[s]) for s in open_)
        for s in open_:
            target[s] = min(target[s], most * sizes[s])
        open_ = [s for s in open_ if target[s] < most * sizes[s] - 1e-12]
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 50, "c": 10, None: 7}, {"a": 1000, "b": 1, "c": 1, "d": 1, "e": 2}, {"x": 5}, {"a": 0, "b": 30, "c": 0}, {None: 9, "Z": 8, "a": 7, "é": 6, "zz": 500},
])
def test_targets_are_the_reshared_ones(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = brute_targets(sizes)
    for r in op.targets(df).collect():
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)


def test_whole_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    found = op.op9_mixing(spark, sf_dir).collect()
    again = op.op9_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)
    assert {r.doc_id: r["size"] for r in found} == words
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, largest = {}, {}, {}
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r["size"] * r.copies
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        largest[s] = max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    positions = [r.position for r in found if r.position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1


def test_schedule_is_inverted(spark):
    rows = spark.range(0, 303).select((F.col("id") % 101 / 100).alias("u"), (F.col("id") % 3).alias("nr"))
    for r in rows.select("u", "nr", op.schedule_time(F.col("u"), F.col("nr")).alias("t")).collect():
        knots = op.SCHEDULES[r.nr]
        area = lambda end: sum((min(end, t2) - t1) * (w1 + (w1 + (w2 - w1) * (min(end, t2) - t1) / (t2 - t1))) / 2 for (t1, w1), (t2, w2) in zip(knots, knots[1:]) if end > t1)
        assert area(r.t) / area(1.0) == pytest.approx(r.u, abs=1e-9)


def test_nulls_empties_and_repeats(spark):
    rows = [(1, None, None), (None, "a b", "s"), (2, "", "s"), (3, "x y z", None), (4, "w " * 40000, "t"), (3, "x y z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = op.mixed(df).collect()
    assert sorted(r["size"] for r in found) == [0, 0, 2, 3, 3, 40000]
    assert op.mixed(spark.createDataFrame([], df.schema)).count() == 0


def test_mix_repeats_rows_and_keeps_columns(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out = op.mix(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r.copies for r in op.mixed(docs).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == copies


def test_rows_with_null_and_repeated_ids_keep_their_own_copies(spark):
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"text number{k} of this row", "a") for k in range(90)]
    out = op.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=1.5, weights=(1.0,))
    copies = Counter(map(tuple, out.collect()))
    assert set(copies) == set(rows) and set(copies.values()) == {1, 2}
    assert abs(sum(copies.values()) - 135) <= 1


def test_copies_and_positions_are_those_of_plain_loops(spark, sf_dir):
    """Brute force: documents of a source one after another by hash, each place on the schedule found by bisection."""
    docs = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text", "source").collect()]
    size = {d: len((t or "").encode().split()) for d, t, _ in docs}
    sums = Counter()
    for d, _, s in docs:
        sums[s] += size[d]
    targets = brute_targets(sums)
    names = sorted(sums, key=lambda s: s.encode())

    def placed(u, knots):
        weight = lambda t: next(w1 + (w2 - w1) * (t - t1) / (t2 - t1) for (t1, w1), (t2, w2) in zip(knots, knots[1:]) if t <= t2)
        area = lambda end: sum((weight(k * end / 400) + weight((k + 1) * end / 400)) / 2 * end / 400 for k in range(400))
        low, high = 0.0, 1.0
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if area(mid) < u * area(1.0) else (low, mid)
        return low

    signed = lambda d: (h := xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42)) - (h >> 63 << 64)
    want = {}
    for k, s in enumerate(names):
        at, passes = 0, int(targets[s] // max(sums[s], 1))
        for d in sorted((d for d, _, x in docs if x == s), key=signed):
            copies = min(2, passes + (at + size[d] / 2 < targets[s] - passes * sums[s]))
            want[d] = copies, [min(1.0, (at + c * sums[s] + size[d] / 2) / max(targets[s], 1)) for c in range(copies)], k
            at += size[d]
    few = 0
    for r in op.mixed(read(spark, sf_dir, "documents")).collect():
        copies, shares, k = want[r.doc_id]
        assert r.copies == copies == len(r.positions)
        if r.doc_id % 10 == 0:  # the bisection is slow
            assert r.positions == pytest.approx([placed(u, op.SCHEDULES[k % 3]) for u in shares], abs=1e-3)
            few += copies
    assert few


def test_an_id_of_most_rows_is_cut(spark):
    rows = [(7 if k % 3 else k, "same text", "a") for k in range(3000)]
    out = op.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0,))
    assert out.count() == 3000 and abs(out.agg(F.sum("taken")).first()[0] - 9000) <= 2


def test_clashing_columns_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 3, 4, 5, 6)], "doc_id long, text string, source string, size int, target int, h int, slice int")
    assert [(r.doc_id, r["size"], r.source_size) for r in op.mixed(docs).collect()] == [(1, 2, 2)]
    assert [tuple(r) for r in op.mix(docs, weights=(1.0,)).distinct().collect()] == [(1, "a b", "s", 3, 4, 5, 6)]
