import difflib
import random
import re

import pytest

from sparquill.operators import fuzzy as op
from sparquill.plans import variants


def brute(texts: dict, keywords: set, cutoff: float) -> set:
    out = set()
    for doc_id, text in texts.items():
        words = re.findall(r"\w{3,}", (text or "").lower())
        for keyword in {k.strip().lower() for k in keywords if k and len(k.strip()) > 4}:
            near = difflib.get_close_matches(keyword, words, n=1, cutoff=cutoff)
            if near and min(len(keyword), len(near[0])) / max(len(keyword), len(near[0])) > 0.7:
                out.add((doc_id, keyword, near[0]))
    return out


@pytest.mark.parametrize("cutoff", [0.6, 0.75, 0.8, 0.95, 1.0])
def test_no_pair_is_lost(spark, cutoff):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé1_t") for _ in range(rng.randint(1, 9)))
    keywords = {word() for _ in range(60)} | {" Payment ", "SHORT", "payments"}
    texts = {k: " ".join(word() for _ in range(20)) for k in range(40)} | {100: None, 101: "", 102: "paymnt pay-ment PAYMENTS x" * 3, 103: "z" * 5000 + " shrot"}
    docs = spark.createDataFrame([*texts.items(), (102, texts[102])], "doc_id long, text string")
    got = op.fuzzy_keywords(docs, spark.createDataFrame([(k,) for k in keywords] + [(None,)], "keyword string"), cutoff)
    assert {(r.doc_id, r.keyword, r.word) for r in got.collect()} == brute(texts, keywords, cutoff)


def test_query_on_the_whole_table(spark, sf_dir):
    names = {w for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").collect() for w in r.p_name.lower().split()} | {"license", "agreement", "copyright", "warranty"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert {(r.doc_id, r.keyword, r.word) for r in variants.fuzzy_keywords(spark, sf_dir).collect()} == brute(texts, names, 0.8)
