import math
import zlib
from collections import Counter

import numpy as np

from sparquill.llm import lm as op
from sparquill.llm.common import read


def brute(rows):
    tokens = [(d, (t or "").encode().lower().split() + [b""]) for d, t in rows]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, ws in tokens if not out(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(((d, out(d), len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens), key=str)


def got(found):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=str)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    found = op.op10_lm_scoring(spark, sf_dir).collect()
    assert got(found) == brute(rows)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_come_by_the_join(spark):
    rows = [(k, f"the cat {k % 7} sat É{k % 3} on\tthe MAT") for k in range(60)] + [(100, None), (101, ""), (None, "the dog"), (5, "again " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = op.lm_scores(docs, hot=3).collect()
    assert got(few) == brute(rows)
    every = op.lm_scores(docs).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens)
    for a, b in zip(sorted(few, key=key), sorted(every, key=key)):
        assert abs(a.score - b.score) < 1e-6 * max(1, abs(a.score))


def test_nothing_to_learn_from(spark):
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = [(k, "some words") for k in ids]
    found = op.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert got(found) == brute(rows) and all(math.isfinite(r.score) for r in found)
    assert op.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scores_are_those_of_a_full_softmax(spark):
    """Brute force: for each token the softmax over all units of the model, and the share within a tail unit."""
    rows = [(k, f"der hund {k % 5} lief É{k % 3} und\tdie KATZE saß {k}" if k % 2 else f"the dog {k % 7} ran over a mat {k}x") for k in range(200)] + [(900, None), (901, "völlig neu unseen words"), (902, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learnt = docs.where(~op.held_out())
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in (t or "").encode().lower().split() + [b""])
    _, vocab, m, total, distinct = op.model_of(learnt)
    assert (total, distinct) == (sum(counts.values()), len(counts))
    heads = [t for t, k in vocab.tokens.items() if k < vocab.heads]
    assert heads[0] == b"" and set(heads) == {b""} | {t for t, c in counts.items() if c >= max(2, math.sqrt(total) / op.HEAD)}
    unit = lambda t: heads.index(t) if t in heads else vocab.heads + zlib.crc32(t[-3:]) % op.TAILS
    share = Counter()
    for t, c in counts.items():
        share[unit(t)] += c + 1
    want = {}
    for d, text in rows:
        tokens, two, one, sum_ = (text or "").encode().lower().split() + [b""], b"", b"", 0.0
        for t in tokens:
            scores = (m.near[unit(one)] + m.far[m.cluster[unit(two)]]).astype(float) @ m.out.T.astype(float) + m.bias
            sum_ += math.log10(np.exp(scores[unit(t)]) / np.exp(scores).sum())
            sum_ += 0 if t in heads else math.log10((counts[t] + 1) / (share[unit(t)] + 1))
            two, one = one, t
        want[d] = sum_
    for r in op.lm_scores(docs).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-3 * len((dict(rows)[r.doc_id] or "").split()) + 1e-3


def test_training_learns_contexts_and_shards_are_averaged():
    rng, u = np.random.default_rng(0), 12
    seq = [0]
    for _ in range(30000):
        seq.append((seq[-1] * 5 + 1) % u if rng.random() < 0.9 else int(rng.integers(u)))
    units = np.array(seq, np.int32)
    trainer = op.Trainer(op.Model.fresh(np.bincount(units, minlength=u).astype(float)), np.bincount(units, minlength=u).astype(float), [1], True)
    for _ in range(5):
        trainer.take(*op.contexts(units, np.array([0])), units)
    m = trainer.m
    scores = (m.near + m.far[0]) @ m.out.T + m.bias
    p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    assert [int(x) for x in p.argmax(1)] == [(k * 5 + 1) % u for k in range(u)] and p.max(1).mean() > 0.7


def test_held_out_text_is_likelier_than_by_counts(spark):
    found = op.op10_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    tokens = sum(r.n_tokens for r in found)
    assert sum(r.score - r.base_score for r in found) / tokens > 0.25


def test_ending_is_the_same_in_sql_and_tasks(spark):
    words = ["a", "ab", "abc", "é", "日本", "straße", "x" * 40, "..", "zé"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", op.ending(op.F.col("w")).alias("k")).collect():
        assert r.k == zlib.crc32(r.w.encode()[-3:]) % op.TAILS


def test_clashing_columns_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a b", 3, 4, 5)], "doc_id long, text string, row int, score int, held_out int")
    assert [(r.doc_id, r.n_tokens) for r in op.lm_scores(docs).collect()] == [(1, 3)]
