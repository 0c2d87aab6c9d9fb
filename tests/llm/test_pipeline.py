import re
from collections import Counter

import corpus_pipeline
from sparquill.llm import common, mixing, quality
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_packing import held


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = common.read(spark, d, "documents")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stored(stage(spark, docs, d))
        steps[name] = (before, docs)
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    before, after = steps["quality_classifier"]
    model = quality.train(before, common.read(spark, d, "labels"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in quality.classify(before, model).where("predicted = 1").collect()}
    before, after = steps["exact_dedup"]
    first = {}
    for r in before.collect():
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[text] = min(first.get(text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(first.values())
    before, after = steps["simhash_near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {c for _, _, c in near_brute(rows)}
    before, after = steps["source_mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mixed(before).collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == Counter(copies)
    before, after = steps["best_fit_packing"]
    held(after.collect(), [(r.doc_id, r.text) for r in before.collect()], common_path())


def common_path():
    from sparquill.llm import packing

    return packing.tokenizer_path()


def test_run_on_the_smallest_tables(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null, repeated and shared ids, null and empty texts, null sources and clashing columns: nothing is lost but copies."""
    good = [f"Plain words stand here in row number {k} of this small table, and {k * 7} others too." for k in range(60)]
    rows = [(None if k % 5 == 0 else 7 if k % 5 == 1 else k, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t), k, f"c{k}") for k, t in enumerate(good)]
    rows += [(2, good[2], "en", "s2", 5, 2, "again"), (None, None, None, None, None, None, None), (91, "", "en", "s1", 0, 3, "x")]
    names = "doc_id long, text string, lang string, source string, n_chars long, row_nr int, keep_id string"
    for table, data, kind in (("documents", rows, names), ("labels", [], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = common.read(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = common.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == [x.split()[0] for x in names.split(", ")]
    kept = Counter((r.doc_id, r.text) for r in docs.collect())
    # One of the row that is there twice; the null and the empty text have no words, and the one with an id stays.
    near = {c for c in near_rows(rows)}
    assert kept == Counter(near)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= {d for d, _ in near} and out.count() >= len(near)
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def near_rows(rows):
    """What exact and near dedup leave of rows, by plain loops: of linked texts the row with the smallest id, then text."""
    from tests.llm.test_near_dedup import brute

    texts = list(dict.fromkeys(" ".join((r[1] or "").split()) for r in rows))
    first = {}
    for r in rows:
        key = " ".join((r[1] or "").split())
        first.setdefault(key, []).append((r[0], r[1]))
    left = [min(first[t], key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")) for t in texts]
    linked = {}
    for k, (i, _, c) in enumerate(sorted(brute([(k, t) for k, (_, t) in enumerate(left)]))):
        linked.setdefault(c, []).append(left[i])
    return [min(g, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")) for g in linked.values()]
