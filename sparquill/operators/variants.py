"""Many queries, each of several weighted variants, scored in one scan of the corpus.

A document's score is linear in the variants' weights, so all variants of a query become one weight for each of its
terms, and what the corpus is joined with is a table of terms, however many queries and variants there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text
from sparquill.operators.search import B, K1
from sparquill.sources.shared import stored

# Weights of a query itself, its core terms, its expansions and single further terms; of phrases; and of the
# normalised score, the share of capabilities and the phrases met in the final order.
QUERY, CORE, EXPANDED, TERM = 1.0, 0.8, 0.5, 0.3
PHRASE = 0.3
COMBINED = {"normalized": 0.5, "overlap": 0.3, "bonus": 0.2}
FLOOR = 0.25  # of the mean idf, for terms that over half of all documents have
LEAST = 0.01


def variants(query: str, core: list[str] = (), expansions: list[str] = (), terms: list[str] = ()) -> list[tuple[str, float]]:
    """The variants of a query and their weights: itself, its expansions, the first five further terms, and core terms of over
    three letters. A variant among the core terms weighs as one, then as an expansion, wherever it stands."""
    weight = lambda v: CORE if v in core else EXPANDED if v in expansions else TERM
    return [(query, QUERY), *((v, weight(v)) for v in [*expansions, *terms[:5], *(t for t in core if len(t) > 3)])]


def okapi(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, doc_id, score) for asked (query, term, weight): BM25 with idf = ln((N - df + 0.5) / (df + 0.5)), where it is negative
    a quarter of the mean over the vocabulary. Documents without a term of a query have no row."""
    w = docs.select("doc_id", text.tokens(F.col("text")).alias("w"))
    df = stored(w.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    n, length = w.agg(F.count("*"), F.avg(F.size("w"))).first()
    plain = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = df.agg(F.avg(plain)).first()[0] or 0.0
    idf = df.join(asked.select("term").distinct(), "term").select("term", F.when(plain < 0, FLOOR * mean).otherwise(plain).alias("idf"))
    tf = w.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(idf, "term").groupBy("doc_id", "dl", "term", "idf").agg(F.count("*").alias("tf"))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(length or 1.0)))
    return tf.join(asked, "term").groupBy("query", "doc_id").agg(F.sum(F.col("weight") * F.col("idf") * share).alias("score"))


def phrase_hits(docs: DataFrame, phrases: dict[str, list[str]]) -> DataFrame:
    """(query, doc_id, times, met): for each document with a phrase of a query, the sum of ln(1 + places) over phrases, and how many phrases it has. Places don't overlap."""
    low = F.lower("text")
    each = []
    for query, own in phrases.items():
        places = [(F.length(low) - F.length(F.replace(low, F.lit(p.lower()), F.lit("")))) / len(p) for p in own if p]
        if places:
            each.append(F.struct(F.lit(query).alias("query"), reduce(Column.__add__, [F.log1p(x) for x in places]).alias("times"), reduce(Column.__add__, [(x > 0).cast("int") for x in places]).alias("met")))
    if not each:
        return docs.select(F.lit("").alias("query"), "doc_id", F.lit(0.0).alias("times"), F.lit(0).alias("met")).limit(0)
    return docs.select("doc_id", F.inline(F.array(*each))).where("met > 0").select("query", "doc_id", "times", "met")


def search(docs: DataFrame, asked: list[dict], n: int) -> DataFrame:
    """(query, rank, doc_id, score, normalized, overlap, bonus, combined): the n best documents of each query.

    asked has, for each query, a name, its variants() and, if any, phrases, capabilities (the five first count) and
    wanted ones. docs has doc_id, text and capabilities (array). The best n by score are taken, or 20 n, 1,000 at most, if
    capabilities are wanted, of which only documents with one stay; these are ordered by half the score's share of
    the query's greatest, 0.3 of the share of capabilities (1 if the query has none) and 0.02 for each phrase met. Scores
    are rounded to 9 places; ties go by doc_id. Scores under 0.01 do not count.
    """
    spark = docs.sparkSession
    rows = [(q["name"], v, float(x)) for q in asked for v, x in q["variants"]]
    terms = spark.createDataFrame(rows, "query string, variant string, weight double").select("query", "weight", F.explode(text.tokens(F.col("variant"))).alias("term"))
    terms = terms.groupBy("query", "term").agg(F.sum("weight").alias("weight"))
    met = phrase_hits(docs, {q["name"]: q.get("phrases", []) for q in asked})
    scored = okapi(docs, terms).join(met, ["query", "doc_id"], "full")
    total = F.coalesce("score", F.lit(0.0)) + PHRASE * F.coalesce("times", F.lit(0.0))
    scored = stored(scored.select("query", "doc_id", F.round(total, 9).alias("score"), (F.coalesce("met", F.lit(0)) * 0.1).alias("bonus")))
    most = scored.groupBy("query").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("most"))
    kind = "query string, capabilities array<string>, wanted array<string>, first int"
    specs = spark.createDataFrame([(q["name"], list(dict.fromkeys(q.get("capabilities", [])[:5])), q.get("wanted") or None, min(1000, 20 * n) if q.get("wanted") else n) for q in asked], kind)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    best = scored.where(F.col("score") >= LEAST).withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(1, min(1000, 20 * n))).join(F.broadcast(specs.withColumnRenamed("capabilities", "own")), "query").where("place <= first")
    best = best.join(docs.select("doc_id", F.coalesce("capabilities", F.array().cast("array<string>")).alias("capabilities")), "doc_id").join(F.broadcast(most), "query")
    best = best.where(F.col("wanted").isNull() | F.arrays_overlap("wanted", "capabilities"))
    overlap = F.when(F.size("own") == 0, 1.0).otherwise(F.size(F.array_intersect("own", "capabilities")) / F.size("own"))
    best = best.withColumns({"normalized": F.col("score") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0), "overlap": overlap})
    combined = F.round(reduce(Column.__add__, [F.col(c) * x for c, x in COMBINED.items()]), 9)
    last = Window.partitionBy("query").orderBy(F.desc("combined"), F.desc("score"), "doc_id")
    out = best.withColumn("combined", combined).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n)
    return out.select("query", "rank", "doc_id", "score", "normalized", "overlap", "bonus", "combined")
