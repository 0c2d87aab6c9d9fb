import re
from collections import defaultdict

import pytest

from sparquill.llm import licenses as op
from sparquill.llm.common import read


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # as the contract says


def split(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = split(text)
    hits = [(k, label) for p, label in op.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in hits}))


def brute_labels(text):
    """Labels, score and spans by plain loops over all word positions, templates and pairs of spans."""
    w, k = split(text), op.GRAM
    places = lambda phrase: [i for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    marks = [(i, sign) for text, signs in op.MARKS.items() for i in places(text) for sign in signs.split()]
    needy = {s[1:] for signs in op.MARKS.values() for s in signs.split() if s[0] == "+"}
    held = set()
    for nr, (phrase, label) in enumerate(op.TEMPLATES.items()):
        t = phrase.split()
        votes = defaultdict(set)
        for p in range(len(w) - k + 1):
            for at in range(len(t) - k + 1):
                if w[p : p + k] == t[at : at + k]:
                    votes[p - at].add(at)
        for d in votes:
            near = {e: ats for e, ats in votes.items() if d <= e <= d + op.SLACK}
            score = len(set.union(*near.values())) / (len(t) - k + 1)
            start, end = min(e + min(ats) for e, ats in near.items()), max(e + max(ats) for e, ats in near.items()) + k - 1
            signs = {s for i, s in marks if start <= i <= end}
            if score >= op.COVER and f"-{label}" not in signs and (label not in needy or f"+{label}" in signs):
                held.add((-score, start - end, nr + len(op.PHRASES), start, end, label))
    kept = [x for x in held if not any(y[:4] < x[:4] and y[3] <= x[4] and x[3] <= y[4] for y in held)]
    base = {label for phrase, label in op.PHRASES.items() if places(phrase)}
    spans = sorted({(x[5], x[3], x[4], -x[0]) for x in kept})
    return ",".join(sorted(base | {x[0] for x in spans})), 1.0 if base else max((x[3] for x in spans), default=0.0), spans


def same_labels(rows, found):
    want = sorted(((d, *brute_labels(t)) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.labels, r.score, [tuple(x) for x in r.spans]) for r in found), key=str) == want


def same(rows, found):
    want = sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=str) == want
    for r in found:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in read(spark, d, "documents").select("doc_id", "text").collect()]
    found = op.op4_license_scan(spark, d).collect()
    same(rows, found)
    assert sum(r.n_base for r in found) > 0


def test_small_cases(spark):
    rows = [(1, None), (2, ""), (3, "Under the MIT license; under THE mit-license."), (3, "Under the MIT license; under THE mit-license."), (None, "CC BY-NC 4.0 and Apache License, Version 2.0"), (5, "under the mit"), (6, "filler " * 40000 + "cc by nc"), (7, "under the mit under the mit license")]
    same(rows, op.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert op.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_altered_texts_get_a_label_and_a_span(spark):
    bsd = "Redistribution and use, in source and binary forms, with or without any modification, are permitted provided that the conditions below are met"
    rows = [(1, f"before {bsd} after"), (2, "nothing of the kind stands here")]
    found = {r.doc_id: r for r in op.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "bsd" and 0.6 <= found[1].score < 1 and found[1].spans[0].start == 1
    assert found[2].labels == "" and found[2].score == 0


def test_short_phrases_are_refused(spark):
    with pytest.raises(ValueError):
        op.license_scan(spark.createDataFrame([], "doc_id long, text string"), {"mit": "mit"})


def test_sibling_licenses_are_told_apart(spark):
    program = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    creative = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    cases = {
        program.format(""): "gpl", program.format("Lesser "): "lgpl", program.replace("program", "library").format("Lesser "): "lgpl", program.format("").split(" as published")[0]: "gpl",
        creative.format(""): "cc-by", creative.format("-ShareAlike"): "cc-by-sa", creative.format("-NonCommercial"): "", creative.format("-NonCommercial-ShareAlike"): "",
        f"{creative.format('')}. {creative.format('-ShareAlike')}": "cc-by,cc-by-sa", f"{program.format('')} {program.format('Lesser ')}": "gpl,lgpl",
    }
    rows = [(k, f"before that {t} and after") for k, t in enumerate(cases)]
    found = {r.doc_id: r.labels for r in op.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k] for k, _ in rows] == list(cases.values())


def test_labels_and_spans_are_those_of_brute_force(spark):
    rows = [tuple(r) for r in read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    t = list(op.TEMPLATES)
    rows += [(1000 + i, f"xx {x}") for i, x in enumerate(t)]
    rows += [(2000 + i, " ".join(w for n, w in enumerate(f"{x} {t[(i + 1) % len(t)]}".split()) if n % 9 != i % 9)) for i, x in enumerate(t)]
    rows += [(3000, "the apache license " * 5), (3001, f"{t[2]} " * 40), (3002, " ".join(reversed(t[5].split()))), (3003, " zz ".join(t[0].split()))]
    found = op.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same_labels(rows, found)
    labels = {r.doc_id: r.labels for r in found}
    assert labels[3000] == labels[3002] == labels[3003] == "" and labels[3001] == "apache-2"


def test_shuffled_templates_give_the_same(spark, monkeypatch):
    rows = [(k, f"a {t} b") for k, t in enumerate(op.TEMPLATES)] + [(99, None), (98, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(op.license_scan(docs).collect(), key=str)
    monkeypatch.setattr(op, "MOST_BROADCAST", 0)
    assert sorted(op.license_scan(docs).collect(), key=str) == want


def test_clashing_columns_are_left_out(spark):
    docs = spark.createDataFrame([(1, "under the mit license", 5, "x", 2)], "doc_id long, text string, row int, labels string, n_words int")
    assert [(r.doc_id, r.n_words, r.labels) for r in op.license_scan(docs).collect()] == [(1, 4, "mit")]
