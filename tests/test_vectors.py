from collections import Counter

import numpy as np
import pytest

from sparquill.operators import vectors as op
from tests.test_variants import okapi

KIND = "id long, v array<float>"


def rows_of(rng, n, width=8):
    """Clusters, copies of one vector, a zero vector, repeated ids."""
    centres = rng.normal(size=(9, width))
    rows = [(k, (centres[k % 9] + 0.4 * rng.normal(size=width)).tolist()) for k in range(n)]
    same = rows[0][1]
    return [*rows, *((n + k, same) for k in range(n // 2)), (5_000, [0.0] * width), (3, same), (3, same)]


def brute(rows, asked, n):
    unit = lambda v: np.array(v, dtype="float32").astype(float) / (np.linalg.norm(np.array(v, dtype="float32").astype(float)) or 1)
    held = [(k, unit(v)) for k, v in rows]
    out = {}
    for query, own, v in asked:
        found = sorted((-round(float(unit(v) @ u), 6) + 0.0, k) for k, u in held if k != own)[:n]
        out |= {(query, i + 1): (k, -s + 0.0) for i, (s, k) in enumerate(found)}
    return out


@pytest.fixture(scope="module")
def held(spark):
    rows = rows_of(np.random.default_rng(3), 300)
    index = op.build(spark.createDataFrame(rows, KIND), "id", "v", block=32)
    return rows, index


def asked_of(spark, asked):
    return spark.createDataFrame(asked, "query string, own long, v array<float>")


def test_exact_search_equals_brute_force_with_hot_cells_copies_and_zeros(spark, held):
    rows, index = held
    asked = [(f"q{k}", k, v) for k, v in rows[::23]] + [("zero", None, [0.0] * 8), ("free", None, [1.0] * 8), ("none", None, None)]
    got = {(r.query, r["rank"]): (r.id, pytest.approx(r.score, abs=2e-6)) for r in op.nearest_exact(index, asked_of(spark, asked), 12, probes=1).collect()}
    want = brute(rows, [a for a in asked if a[2]], 12)
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] for k in want)
    assert sum(got[k][0] == want[k][0] for k in want) >= 0.98 * len(want)  # a sixth place may round either way


def test_index_holds_every_row_in_small_blocks(held):
    rows, index = held
    blocks = index.blocks.selectExpr("cell", "part", "parts", "size(rows) AS n").collect()
    assert sum(b.n for b in blocks) == len(rows) and max(b.n for b in blocks) < 100
    assert max(b.parts for b in blocks) > 3  # the copies' cell is many blocks
    ids = Counter(r.id for r in index.blocks.selectExpr("inline(rows)").collect())
    assert ids == Counter(k for k, _ in rows)


def test_recall_rises_to_one_and_the_chosen_probes_reach_the_target(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(1_000)]
    index = op.build(spark.createDataFrame(rows, KIND), "id", "v")
    by = {r.probes: r.recall for r in op.recall_by_probes(index, 10).collect()}
    assert list(by.values()) == sorted(by.values()) and by[max(by)] == pytest.approx(1) and by[min(by)] < 0.6
    probes = op.probes_for(index, 10)
    assert 1 < probes < len(index.centres)
    asked = asked_of(spark, [(str(k), k, v) for k, v in rows if k % 7 == 0])
    assert op.recall(op.nearest(index, asked, 10, probes), op.nearest_exact(index, asked, 10)) >= 0.9


def test_odd_tables(spark):
    none = op.build(spark.createDataFrame([], KIND), "id", "v")
    asked = asked_of(spark, [("a", None, [1.0, 0.0])])
    assert op.nearest(none, asked, 3, 1).count() == op.nearest_exact(none, asked, 3).count() == op.recall_by_probes(none, 3).count() == 0
    some = op.build(spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 1.0]), (2, None), (3, [1.0, None]), (4, [0.0, 2.0])], KIND), "id", "v")
    assert [(r.id, r.score) for r in op.nearest_exact(some, asked, 3).orderBy("rank").collect()] == [(1, 1.0), (4, 0.0)]
    with pytest.raises(ValueError):
        op.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], KIND), "id", "v")


def test_hybrid_fuses_ranks_and_keeps_first_of_a_name(spark):
    texts = {1: "wire transfer of funds", 2: "wire wire cut", 3: "transfer desk", 4: "nothing here", 5: "more of it", 6: "rest"}
    vectors = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.9, 0.1], 4: [0.99, 0.0], 5: [0.2, 0.8], 6: [-1.0, 0.0]}
    entries = lambda own: spark.createDataFrame(own, "id long, text string, file string, name string")
    procedures = entries([(k, t, "f", f"p{k}") for k, t in texts.items()])
    symbols = entries([(11, "wire count int", "f", "p1"), (12, "wire amount", "g", "s12"), (13, "other", "g", "s13"), (14, None, "g", "s14"), (15, "x", "g", "s15"), (16, "y", "g", "s16")])
    index = op.build(spark.createDataFrame(list(vectors.items()), KIND), "id", "v")
    asked = spark.createDataFrame([("q", "wire transfer", [1.0, 0.0]), ("t", "wire", None), ("v", None, [0.0, 1.0])], "query string, text string, v array<float>")
    got = op.hybrid(asked, procedures, index, symbols, entries([]), n=4).orderBy("query", "rank").collect()
    by = {q: [(r.kind, r.id) for r in got if r.query == q] for q in "qtv"}
    score = okapi({k: t.split() for k, t in texts.items()}, [("wire", 1.0), ("transfer", 1.0)])
    lexical = sorted((k for k in score if score[k] > 0.1), key=lambda k: (-round(score[k], 9), k))
    near = sorted(vectors, key=lambda k: (-round(vectors[k][0] / float(np.hypot(*vectors[k])), 6), k))
    fused = Counter()
    for own in (lexical, near):
        fused.update({k: 1 / (60 + i) for i, k in enumerate(own, 1)})
    assert [k for kind, k in by["q"] if kind == "procedure"] == sorted(fused, key=lambda k: (-round(fused[k], 9), k))[:4]
    assert ("symbol", 12) in by["q"] and ("symbol", 11) not in by["q"]  # 11 has the file and name of procedure 1
    assert {k for kind, k in by["t"] if kind == "procedure"} == {1, 2} and by["v"][0] == ("procedure", 2)
    assert [r["rank"] for r in got if r.query == "q"] == list(range(1, len(by["q"]) + 1))
