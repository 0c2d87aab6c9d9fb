"""License scans by diagonal voting, in built-in functions only.

Every k-gram of words is hashed where it stands and joined to the k-grams of the templates. A match at word p of
a text and word t of a template votes for diagonal p - t. Matches whose words differ despite equal hashes are
dropped. Where all of a template's k-grams vote for one diagonal, its words stand there one after another; votes
on neighbouring diagonals, as left by inserted or missing words, are merged into one span. A span is verified by
the share of the template's different k-grams that it has, by its length, which the merged diagonals bound, by
words that tell sibling licenses apart, and against overlapping spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.llm.common import fresh, lower_ascii, read, row_key, stored, text_of, words

#: Words of lower-cased texts: the characters outside \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F, listed, as a negated class is several times slower.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
GRAM = 3
#: Templates are broadcast only up to this many words in all; beyond it Spark shuffles the join.
MOST_BROADCAST = 200_000
#: Phrases whose every place counts.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening sentences of public licenses, which label a text that has most of one.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "licensed under the apache license version 2 0": "apache-2",
    "released under the mit license": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
}
#: Words that tell sibling templates apart: inside a span, -label rules the label out, +label is what the label needs one of.
MARKS = {
    "gnu lesser general": "-gpl +lgpl",
    "gnu library general": "-gpl +lgpl",
    "the gnu lgpl": "-gpl +lgpl",
    "gnu affero general": "-gpl",
    "commons attribution sharealike": "-cc-by +cc-by-sa",
    "commons attribution share": "-cc-by +cc-by-sa",
    "commons attribution noncommercial": "-cc-by",
    "commons attribution non": "-cc-by",
    "commons attribution noderivatives": "-cc-by",
    "commons attribution noderivs": "-cc-by",
    "commons attribution no": "-cc-by",
}
BUCKET = 64  # words; spans and marks meet where they share one
COVER = 0.6  # of a template's k-grams for its label
SLACK = 6  # diagonals this far apart may belong to one span


def templates(spark: SparkSession, groups: list[tuple[str, dict[str, str]]], k: int = GRAM) -> DataFrame:
    """(template, kind, label, n_grams, at, t0.., h): a row for each k-gram of the templates (text: label) of each kind."""
    rows, nr = [], 0
    for kind, texts in groups:
        for text, label in texts.items():
            w = text.lower().split()
            rows += [(nr, kind, label, len(w) - k + 1, at, *w[at : at + k]) for at in range(len(w) - k + 1)]
            nr += 1
    names = [f"t{i}" for i in range(k)]
    held = spark.createDataFrame(rows, f"template long, kind string, label string, n_grams long, at long, {', '.join(f'{x} string' for x in names)}")
    held = held.withColumn("h", F.xxhash64(*names))
    return F.broadcast(held) if len(rows) <= MOST_BROADCAST else held


def matches(docs: DataFrame, keys: list[str], held: DataFrame, k: int = GRAM) -> DataFrame:
    """(keys, n_words, pos, template, kind, label, n_grams, at): the k-grams of docs' texts that templates have.

    Besides, each row of docs has one row at its first k-gram (pos 0, or null where it has none), with a null
    template if nothing matches there; so n_words is known for all without a second pass over the texts.
    """
    names = [f"w{i}" for i in range(k)]
    n = F.size("w")
    zipped = F.arrays_zip(*[F.slice("w", i + 1, n - (k - 1)).alias(x) for i, x in enumerate(names)])
    texts = docs.select(*keys, words(lower_ascii(text_of()), WORD).alias("w"))
    rolling = texts.select(*keys, n.cast("long").alias("n_words"), F.posexplode_outer(F.when(n >= k, zipped)).alias("pos", "gram"))
    rolling = rolling.select(*keys, "n_words", F.col("pos").cast("long").alias("pos"), *[F.col(f"gram.{x}").alias(x) for x in names])
    # Texts without a k-gram have a hash of their own each, lest they meet in one task where the join is shuffled.
    rolling = rolling.withColumn("h", F.when(F.col("pos").isNull(), F.xxhash64(*keys)).otherwise(F.xxhash64(*names)))
    same = [F.col(x).eqNullSafe(F.col(f"t{i}")) for i, x in enumerate(names)]
    met = rolling.join(held, ["h"], "left")
    for c in same[1:]:
        same[0] = same[0] & c
    return met.withColumn("template", F.when(same[0], F.col("template"))).where("template IS NOT NULL OR coalesce(pos, 0) = 0").select(*keys, "n_words", "pos", "template", "kind", "label", "n_grams", "at")


def diagonals(found: DataFrame, key: str) -> DataFrame:
    """(key, template, kind, label, n_grams, diagonal, ats, first, last): the different template positions that vote for a
    diagonal, and the first and last position of the text among them; at most n_grams for each diagonal.
    """
    votes = [F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last")]
    return found.where("template IS NOT NULL").groupBy(key, "template", "kind", "label", "n_grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(*votes)


def spans(found: DataFrame, key: str, k: int = GRAM, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """(key, template, label, start, end, score): neighbouring diagonals merged, and kept from a share of cover on.

    For each diagonal with votes, those up to slack above it are merged with it; score is the share of the
    template's different k-grams that vote for any of them. No span is longer than its template and slack words.
    """
    near = Window.partitionBy(key, "template").orderBy("diagonal").rangeBetween(0, slack)
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(near))))
    merged = found.select(key, "template", "label", F.min("first").over(near).alias("start"), (F.max("last").over(near) + (k - 1)).alias("end"), (covered / F.col("n_grams")).alias("score"))
    return merged.where(F.col("score") >= cover).distinct()


def _bucketed(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor(F.col(end) / BUCKET))))


def settled(held: DataFrame, marks: DataFrame, key: str, needy: list[str]) -> DataFrame:
    """The spans of held that marks (key, pos, mark) within them allow, and that no better span overlaps.

    Better is a larger share, then a longer span, then an earlier template or start. needy: labels that need a
    mark of their own. Spans meet marks and each other only within buckets of words.
    """
    signs = marks.select(F.col(key).alias("mark_key"), "pos", F.floor(F.col("pos") / BUCKET).alias("mark_bucket"), F.split("mark", " ").alias("mark"))
    within = (F.col(key) == F.col("mark_key")) & (F.col("bucket") == F.col("mark_bucket")) & (F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("end"))
    marked = _bucketed(held).join(signs, within, "left").groupBy(*held.columns).agg(F.array_distinct(F.flatten(F.collect_set("mark"))).alias("marks"))
    has = lambda sign: F.array_contains("marks", F.concat(F.lit(sign), F.col("label")))
    allowed = stored(marked.where(~has("-") & (~F.col("label").isin(needy) | has("+"))).drop("marks"))
    rank = lambda of: F.struct(-F.col(f"{of}.score"), F.col(f"{of}.start") - F.col(f"{of}.end"), f"{of}.template", f"{of}.start")
    overlap = (F.col("x.start") <= F.col("y.end")) & (F.col("y.start") <= F.col("x.end"))
    beaten = _bucketed(allowed).alias("x").join(_bucketed(allowed).alias("y"), (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.bucket") == F.col("y.bucket")) & overlap & (rank("y") < rank("x")))
    beaten = beaten.select(*[F.col(f"x.{c}").alias(c) for c in allowed.columns]).distinct()
    return allowed.join(beaten, allowed.columns, "left_anti")


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, more: dict[str, str] = TEMPLATES, k: int = GRAM, marks: dict[str, str] = MARKS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score and spans (label, start, end, score).

    n_base counts all places where a phrase's words stand consecutively, first_word and last_word are the
    smallest and largest of their starts. labels are those of the phrases and of the spans. score is the largest
    share of a phrase or template found (0 if none). A span with a better one overlapping it does not count, and
    marks rule out spans of sibling licenses. Phrases, templates and marks need at least k words. A null text is
    empty, and a null doc_id an id like any other. Repeated rows each get a row; an empty table gives an empty
    result; other columns of docs are left out, whatever their names.
    """
    spark = docs.sparkSession
    if short := [p for p in [*phrases, *more, *marks] if len(p.split()) < k]:
        raise ValueError(f"texts of under {k} words: {short}")
    held = templates(spark, [("phrase", phrases), ("template", more), ("mark", marks)], k)
    key = "row"
    found = stored(matches(docs.select("doc_id", "text").withColumn(key, row_key()), [key, "doc_id"], held, k))
    rows = found.where("coalesce(pos, 0) = 0").groupBy(key, "doc_id", "n_words").agg(F.lit(0).alias("_")).drop("_")
    voted = stored(diagonals(found, key))
    exact = voted.where("kind <> 'template' AND size(ats) = n_grams")
    inside = exact.where("kind = 'mark'").select(key, F.col("diagonal").alias("pos"), F.col("label").alias("mark"))
    needy = sorted({m[1:] for text in marks.values() for m in text.split() if m[0] == "+"})
    base = exact.where("kind = 'phrase'").groupBy(key).agg(F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base"))
    span = F.struct("label", "start", "end", "score")
    wide = settled(spans(voted.where("kind = 'template'"), key, k), inside, key, needy).groupBy(key).agg(F.array_sort(F.collect_set(span)).alias("spans"))
    out = rows.join(base.join(wide, key, "full"), key, "left")
    none = F.array().cast("array<string>")
    spanned = F.coalesce("spans", F.array().cast("array<struct<label:string,start:bigint,end:bigint,score:double>>"))
    base_labels = F.coalesce("base", none)
    labels = F.array_sort(F.array_union(base_labels, spanned["label"]))
    score = F.when(F.col("n_base").isNotNull(), F.lit(1.0)).otherwise(F.coalesce(F.array_max(spanned["score"]), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), spanned.alias("spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
