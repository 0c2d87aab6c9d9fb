import numpy as np

from sparquill.functions import text
from sparquill.operators import learning as op
from sparquill.operators import search
from pyspark.sql import functions as F


def test_latent_index_finds_related_documents(spark):
    rows = [(k, " ".join((["bank", "payment", "account", "wire"] if k % 2 else ["tree", "river", "stone", "moss"])[(k + j) % 4] for j in range(6))) for k in range(20)]
    terms, docs = op.latent_index(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    first = docs.where("doc_id = 1").first().vector
    assert {r.doc_id % 2 for r in op.similar(docs, "doc_id", first, 8).collect()} == {1}
    bank = terms.where("term = 'bank'").first().vector
    assert {r.term for r in op.similar(terms, "term", bank, 4).collect()} == {"bank", "payment", "account", "wire"}


def test_forest_and_tree_rules(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(a), float(b), float(a > 0.5)) for k, (a, b) in enumerate(rng.random((300, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    model = op.forest(df, ["a", "b"], "y", trees=5)
    assert op.importances(model, ["a", "b"], 1)[0][0] == "a"
    p = {r.id: r.p for r in op.probabilities(model, df, ["a", "b"], "id").collect()}
    assert np.mean([(p[k] > 0.5) == bool(y) for k, _, _, y in rows]) > 0.95
    rules = op.tree_rules(op.tree(df, ["a", "b"], "y", 2), ["a", "b"])
    assert {c for _, c in rules} == {0.0, 1.0} and all(conditions[0].startswith("a ") for conditions, _ in rules)


def test_snippet_stops_at_a_sentence(spark):
    long = "First one here. Second one is here. " + "word " * 100
    got = spark.createDataFrame([(long,), ("short",), ("x" * 400,), ("",)], "t string").select(text.snippet(F.col("t")).alias("s")).collect()
    assert [len(r.s) <= 300 for r in got] == [True] * 4 and got[0].s.startswith("First one here. Second one is here.") and got[2].s == "x" * 300


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in search.bm25(docs, "a").collect()}
    avg = 5 / 3
    want = np.log((3 - 1 + 0.5) / 1.5 + 1) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert got.keys() == {1} and abs(got[1] - want) < 1e-9


def test_nearest_vectors_like_brute_force(spark):
    """With ties, zero vectors, repeated ids and blocks of few rows."""
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (700, 3)).astype(float)
    ids = [k if k < 690 else k - 600 for k in range(700)]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "id long, v array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    want = {}
    for k in range(600):
        if ids[k] % 5 == 0 and ids.count(ids[k]) == 1:
            score = np.round(unit @ unit[k], 6) + 0.0
            want[ids[k]] = sorted(((-s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != ids[k]))[:9]
    got = {}
    for r in op.nearest_vectors(rows, "id", "v", F.col("id") % 5 == 0, 9, block=16).collect():
        got.setdefault(r["query"], []).append((-r.score, r.id))
    assert len(want) > 100 and all(sorted(got[k]) == w for k, w in want.items())
    assert {r["query"] for r in op.nearest_vectors(rows.where("id < 4"), "id", "v", F.lit(True), 9).collect()} == {0, 1, 2, 3}


def test_worse_rows_are_not_sorted(monkeypatch):
    rng = np.random.default_rng(5)
    near = np.array([1.0, 0.0]) + rng.random((50, 2)) * 0.1
    best = op._Best(np.array([900, 901]), np.array([[1.0, 0.0], [0.8, 0.6]]), 5)
    best.meet(np.arange(50), near)
    kept = best.rows()
    monkeypatch.setattr(op.np, "lexsort", lambda *a: 1 / 0)
    best.meet(np.arange(100, 150), -near)
    assert len(kept[0]) == 10 and all((a == b).all() for a, b in zip(kept, best.rows(), strict=True))


def test_latent_vectors_like_a_dense_decomposition(spark):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.choice([3, 10, 200])) if x < 150)) for k in range(200)] + [(7, "t1 t2"), (8, "")]
    terms, docs = op.latent_index(spark.createDataFrame(rows, "doc_id long, text string"), k=3)
    names = [r.term for r in terms.collect()]
    df = {t: len({(k, len(x.split())) for k, x in rows if t in x.split()}) for t in names}
    w = {}
    for k, x in rows:
        for t in set(x.split()) & set(names):
            i, j = k, names.index(t)
            w[i, j] = w.get((i, j), 0) + x.split().count(t) / len(x.split()) * np.log(len(rows) / df[t])
    m = np.zeros((200, len(names)))
    for (i, j), x in w.items():
        m[i, j] = x
    want = np.linalg.svd(m)[2][:3]
    got = np.array([r.vector for r in terms.collect()]).T
    assert np.allclose(np.abs((got * want).sum(1)), 1, atol=1e-6)
