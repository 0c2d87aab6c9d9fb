import hashlib

import numpy as np
import pytest

from sparquill.llm import fingerprints as op
from sparquill.llm.common import read


def check(rows, found):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in order]
    want = []
    for k, (d, _) in enumerate(order):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        m = len(text) // 4
        want.append((d, len(text), hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=str) == sorted(want, key=str)


def test_whole_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = op.op1_document_fingerprints(spark, sf_dir).collect()
    check(rows, found)
    by_text = {}
    for r in found:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert np.mean([r.near_edited for r in found]) > np.mean([r.near_next for r in found]) + 0.2
    every = [int(r.fingerprint, 16) for r in found]
    for r in found:
        if r.doc_id % 50:
            assert r.near_docs is None
        else:
            assert r.near_docs == sum((int(r.fingerprint, 16) ^ x).bit_count() <= 3 for x in every) - 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


@pytest.mark.parametrize("rows", [
    [(1, "alone with a few words")],
    [(5, None), (700, ""), (-3, "é" * 9), (10**15, "x y z w " * 9000), (12, "a"), (513, "b c d e")],
    [(4, "one two three four"), (4, "one two three four"), (4, "five six seven eight")],
])
def test_small_cases(spark, rows):
    check(rows, op.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_empty_table(spark):
    assert op.document_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_come_last(spark):
    rows = [(None, "p q r s t u v w"), (3, "a b c d e f g h"), (8, "i j k l m n o p")]
    found = op.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, found)


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)]
    near = [b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for b in base for _ in range(3)]
    every = sorted(set(base + near))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in every]
    prints = spark.createDataFrame(signed, "fingerprint long")
    found = [(r.fingerprint % (1 << 64), r.match % (1 << 64), r.distance) for r in op.near_fingerprints(prints, prints, 3, 6).collect()]
    want = [(a, b, (a ^ b).bit_count()) for a in every for b in every if (a ^ b).bit_count() <= 3]
    assert sorted(found) == sorted(want)


def test_clashing_columns_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x", 2, 7), (2, "d e f", 5, "x", 2, 7)], "doc_id long, text string, row int, near string, edited int, fingerprint int")
    got = op.document_fingerprints(docs).select("doc_id", "n_chars", "fingerprint").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, op.document_fingerprints(docs.select("doc_id", "text")).select("doc_id", "n_chars", "fingerprint").collect()))
