import hashlib
import re

from pyspark.sql import functions as F

from sparquill.llm import exact_dedup as op
from sparquill.llm.common import read

DOCS = "doc_id long, text string"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for k, (d, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if norm[j] == norm[k]]
        ids = [x for x in same if x is not None]
        out.append((d, min(ids) if ids else None, len(same), hashlib.sha256(norm[k].encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = op.exact_duplicates(docs)
    assert got(found) == brute(rows)
    assert found.where("kept").count() == len({r[3] for r in brute(rows)})


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(3, None), (2, ""), (1, " "), (4, " \n\t"), (None, "a  b"), (9, "a b"), (9, "a b"), (8, "a\x0bb"), (None, "solo"), (None, "solo"), (7, "w " * 50000), (6, "w  " * 50000), (5, "a b")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = op.exact_duplicates(docs)
    assert got(found) == brute(rows)
    kept = sorted(((r.doc_id, r.text.split() if r.text else []) for r in found.where("kept").collect()), key=str)
    assert kept == sorted([(2, []), (1, []), (5, ["a", "b"]), (None, ["solo"]), (6, ["w"] * 50000)], key=str)
    assert op.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_weak_digest_is_told_apart_by_content(spark):
    rows = [(k, f"text {k % 40}") for k in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    found = op.exact_duplicates(docs, digest=lambda c: F.substring(op.sha256(c), 1, 1)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == {(k, k % 40, 5) for k in range(200)}


def test_filter_keeps_columns_even_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, row long, content string")
    out = op.exact_dedup(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "a", 5, "x")]
