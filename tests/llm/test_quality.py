import zlib

import numpy as np
import pytest

from sparquill.llm import quality as op
from sparquill.llm.common import read


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in read(spark, d, "labels").collect()}
    found = op.op5_quality_classifier(spark, d).collect()
    assert len(found) == read(spark, d, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in marks]
    good = np.array([r.score for r in held if marks[r.doc_id] == 1])
    bad = np.array([r.score for r in held if marks[r.doc_id] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.9


def test_no_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.5), (2, "", 2.5), (None, "some text", 3.5), (4, "w " * 100000, 1.0)], "doc_id long, text string, score double")
    with pytest.warns(UserWarning, match="too few labelled texts"):
        model = op.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    out = op.classify(docs, model)
    assert out.count() == 4 and {r.score for r in out.collect()} == {0.5}
    assert op.accepted(docs, model).columns == docs.columns
    assert op.classify(docs.limit(0), model).count() == 0


def test_held_out_labels_are_never_learnt_from(spark):
    rows = [(k, ("Plain words stand here in a row. " if k % 2 else "LOUD!! JUNK!! ") * 9 + str(k)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(k, k % 2) for k, _ in rows]
    wrong = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q) for k, q in labels]
    scores = [sorted((r.doc_id, r.score) for r in op.classify(docs, op.train(docs, spark.createDataFrame(x, "doc_id long, quality int"))).collect()) for x in (labels, wrong)]
    assert scores[0] == scores[1]
    assert all((s >= 0.7) == bool(k % 2) for k, s in scores[0])


def test_without_a_model_every_row_is_accepted(spark):
    docs = spark.createDataFrame([(k, f"clean text {k}") for k in range(20)], "doc_id long, text string")
    for labels in ([], [(k, 1) for k in range(20)], [(1, 0), (3, 1)]):
        with pytest.warns(UserWarning, match="all rows are accepted"):
            assert op.accepted(docs, op.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))).count() == 20


def test_ids_are_chosen_among_those_with_texts_and_fetched_once(spark, monkeypatch):
    text = lambda k: ("Plain words stand here in a row. " if k % 2 else "LOUD!! JUNK!! ") * 9 + str(k)
    docs = spark.createDataFrame([(k, text(k)) for k in range(200)] + [(1, text(1))] * 500, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(20000)], "doc_id long, quality int")
    seen = []
    crossed = op._crossed
    monkeypatch.setattr(op, "_crossed", lambda texts, prior: seen.append(texts) or crossed(texts, prior))
    model = op.fit(docs, marks, 200)
    assert model.bad and {q: len(set(t)) for q, t in seen[0].items()} == {q: len(t) for q, t in seen[0].items()} == {0: 100, 1: 100}


def test_scores_are_those_of_plain_python(spark):
    """Brute force: both sizes of each whole text, and the formula of the calibration, without the library's own functions."""
    import math

    import zstandard

    d = "/root/testdata/sf0.01"
    docs = read(spark, d, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "x"), (-3, "some words " * 50000)], "doc_id long, text string"))
    model = op.train(docs, read(spark, d, "labels"))
    held = [zstandard.ZstdCompressionDict(x) for x in (model.bad, model.good)]
    for r in op.classify(docs, model).collect():
        raw = (r.text or "").encode()
        want = model.prior
        if raw:
            bad, good = (len(zstandard.ZstdCompressor(level=3, dict_data=h, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw)) for h in held)
            diff, ratio, n = (bad - good) / max(bad, good), math.log(min(bad, good) / len(raw)), math.log(len(raw) + 1)
            bend = min(ratio + 2.5, 0)
            terms = [diff, ratio, n, diff * ratio, diff * n, ratio * n, diff * diff, ratio * ratio, n * n, bend, bend * n]
            z = model.weights[0] + sum(w * (t - c) / s for w, t, c, s in zip(model.weights[1:], terms, model.centre, model.scale))
            want = 1 / (1 + math.exp(-max(-35, min(35, z))))
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.7)


def test_the_calibration_sees_no_text_in_its_own_dictionary(monkeypatch):
    texts = {q: [f"{q} {k} word text line {k * q}".encode() * 20 for k in range(40)] for q in (0, 1)}
    made, measured, make, measure = [], [], op._dictionaries, op.features
    monkeypatch.setattr(op, "_dictionaries", lambda t, prior: made.append({x for ts in t.values() for x in ts}) or make(t, prior))
    monkeypatch.setattr(op, "features", lambda pair, t: measured.append(set(t)) or measure(pair, t))
    _, x, y = op._crossed(texts, 0.5)
    assert len(x) == len(y) == 80 and len(made) == op.FOLDS + 1 and set.union(*measured) == made[-1]
    assert all(not (a & b) for a, b in zip(made, measured))
