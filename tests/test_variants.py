import math
from collections import Counter

import pytest

from sparquill.operators import variants as op

DOCS = [(1, "the cat sat on the mat", ["a"]), (2, "the dog", ["b"]), (3, "a cat and a dog and a cat", ["a", "b"]), (4, "nothing of it", None), (5, None, ["a"]), (6, "the the the cat dog", [])]


def okapi(words: dict, query: list) -> dict:
    """By the formula alone, over documents that have a term."""
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    idf = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    score = lambda w: sum(x * (idf[t] if idf[t] >= 0 else floor) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t, x in query if t in w)
    return {k: score(w) for k, w in words.items() if any(t in w for t, _ in query)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, capabilities array<string>")


def test_okapi(spark, docs):
    full = docs.where("text IS NOT NULL")
    asked = {"x": [("the", 1.0), ("cat", 0.5)], "y": [("dog", 0.3), ("absent", 1.0)]}
    frame = spark.createDataFrame([(q, t, x) for q, own in asked.items() for t, x in own], "query string, term string, weight double")
    got = {(r.query, r.doc_id): r.score for r in op.okapi(full, frame).collect()}
    words = {d: t.split() for d, t, _ in DOCS if t}
    assert got == {(q, d): pytest.approx(s) for q, own in asked.items() for d, s in okapi(words, own).items()}


def test_variants_weigh_as_what_they_are():
    assert op.variants("q", ["core", "is"], ["wide", "core"], ["t1", "t2", "t3", "t4", "t5", "t6"]) == [("q", 1.0), ("wide", 0.5), ("core", 0.8), ("t1", 0.3), ("t2", 0.3), ("t3", 0.3), ("t4", 0.3), ("t5", 0.3), ("core", 0.8)]


def test_search_orders_filters_and_counts_phrases(spark, docs):
    asked = [
        {"name": "x", "variants": op.variants("cat dog"), "phrases": ["THE ", "aa"], "capabilities": ["a", "c"]},
        {"name": "y", "variants": op.variants("and"), "wanted": ["b"]},
        {"name": "z", "variants": op.variants("absent")},
    ]
    got = op.search(docs, asked, 3).collect()
    by = {q: [r for r in sorted(got, key=lambda r: r["rank"]) if r.query == q] for q in "xyz"}
    assert [r.doc_id for r in by["y"]] == [3] and not by["z"]
    assert all(r.combined == pytest.approx(0.5 * r.normalized + 0.3 * r.overlap + 0.2 * r.bonus) for r in got)
    x = {r.doc_id: r for r in by["x"]}
    assert len(x) == 3 and max(r.normalized for r in x.values()) == 1 and x[6].bonus == pytest.approx(0.1)
    assert [r.combined for r in by["x"]] == sorted((r.combined for r in by["x"]), reverse=True)
    assert op.phrase_hits(docs, {}).count() == 0
