import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparquill.llm import line_dedup as op
from sparquill.llm.common import LOWER, UPPER, read

DOCS = "doc_id long, text string"


def brute(rows, least_chars=40, least_docs=5):
    def key(line):
        return line.strip(op.BLANK).translate(str.maketrans(UPPER, LOWER))

    held = defaultdict(set)
    for k, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(k)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = []
        for line in lines:
            ids = [rows[k][0] for k in held.get(key(line), ())]
            top = max((d for d in ids if d is not None), default=None)
            if len(ids) < least_docs or doc_id == top:
                stay.append(line)
        out.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=str)


@pytest.mark.parametrize("fan", [2, 3, 9])
def test_whole_table_in_batches(spark, sf_dir, fan):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = op.dedup_lines(docs.repartition(11, "doc_id"), fan=fan)
    assert got(found) == brute([tuple(r) for r in docs.collect()])


def test_runs_hold_each_hash_once_and_close(spark):
    lines = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.md5((F.col("id") % 700).cast("string")).alias("hash"), (F.col("id") % 7).alias("batch"))
    runs = op.Runs(spark, 3)
    for k in range(7):
        runs.add(lines.where(F.col("batch") == k))
    assert [len(x) for x in runs.levels] == [1, 2]
    new = [r.hash for name in runs.names() for r in spark.table(name).where("NOT seen").collect()]
    assert len(new) == len(set(new)) == 700
    want = lines.groupBy("hash").agg(F.count("*").alias("docs"), F.max("doc_id").alias("top")).where("docs >= 5")
    assert sorted(map(tuple, runs.frequent(5).collect())) == sorted(map(tuple, want.collect()))
    names = runs.names()
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_runs_are_merged_without_a_shuffle_of_the_runs(spark):
    lines = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("hash"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = op.Runs(spark)
        runs.add(lines)
        run = spark.table(runs.names()[0]).where("NOT seen").select("hash", "n")
        plan = lines.groupBy("hash").count().join(run, "hash", "left")._jdf.queryExecution().executedPlan().toString()
        runs.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_nulls_ties_repeats_long_lines_and_clashing_columns(spark):
    line, other = "A line that is longer than forty characters, surely.", "É " * 30 + "Z"
    rows = [(k, f"{k}\n{line}\n  {line.lower()}\t\n") for k in (3, 1, 4, 1, 5, 9)] + [(9, f"{line}\n{line}"), (None, line), (None, None), (2, ""), (7, "\n\n")]
    rows += [(None, other)] * 5 + [(20 + k, "x" * 100000 + f"\n{other.strip()}") for k in range(4)] + [(30, "short"), (31, "short"), (32, "short"), (33, "short"), (34, "short")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], DOCS + ", n_lines int, hash string").repartition(5)
    found = op.dedup_lines(docs, batches=3, fan=2)
    assert found.columns == ["doc_id", "text", "hash", *op.ADDED] and got(found) == brute(rows)
    only_null = [(None, line)] * 6
    assert got(op.dedup_lines(spark.createDataFrame(only_null, DOCS))) == brute(only_null)
    assert op.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_query_equals_its_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = {d: (n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute(rows)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op.op12_line_dedup(spark, sf_dir).collect()} == want
