"""Keyword and taxonomy analytics over a mapping fact (keyword, doc_id, chunk_index, category, priority, relevance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.functions import text
from sparquill.operators.ranks import first_of
from sparquill.sources.shared import stored

PRIORITIES = ("critical", "high", "medium", "low")


def taxonomy(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(keyword, category, priority); a small table that callers choose."""
    return spark.createDataFrame(rows, "keyword string, category string, priority string")


def mappings(docs: DataFrame, keywords: DataFrame, size: int = 200) -> DataFrame:
    """The fact: single-word keywords found in chunks of `size` words; relevance is the count there, 5 at most.

    An equi-join on tokens stands for the comparison of each keyword with each text. Keywords are few and broadcast, as a
    frequent one would bring all its places to one task.
    """
    chunks = docs.select("doc_id", F.posexplode(text.tokens(F.col("text"))).alias("pos", "term")).withColumn("chunk_index", F.floor(F.col("pos") / size).cast("int"))
    found = chunks.join(F.broadcast(keywords), F.col("term") == F.col("keyword"))
    return found.groupBy("keyword", "category", "priority", "doc_id", "chunk_index").agg(F.least(F.count("*"), F.lit(5)).cast("int").alias("relevance"))


def top_keywords(facts: DataFrame, n: int) -> DataFrame:
    return facts.groupBy("keyword").agg(F.count_distinct("doc_id").alias("docs")).orderBy(F.desc("docs"), "keyword").limit(n)


def top_chunks(facts: DataFrame, n: int) -> DataFrame:
    return facts.groupBy(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk")).agg(F.count("*").alias("keywords")).orderBy(F.desc("keywords"), "chunk").limit(n)


def roll(facts: DataFrame, by: str) -> DataFrame:
    """Distinct keywords and documents, mean and median relevance and rows, by category or priority."""
    return facts.groupBy(by).agg(F.count_distinct("keyword").alias("keywords"), F.count_distinct("doc_id").alias("docs"), F.round(F.avg("relevance"), 4).alias("mean"), F.median("relevance").alias("median"), F.count("*").alias("n"))


def gaps(keywords: DataFrame, facts: DataFrame, least: int) -> DataFrame:
    """Keywords of the taxonomy in fewer than `least` documents, those in none included."""
    seen = facts.groupBy("keyword").agg(F.count_distinct("doc_id").alias("docs"))
    return keywords.join(seen, "keyword", "left").select("keyword", "category", "priority", F.coalesce("docs", F.lit(0)).alias("docs")).where(F.col("docs") < least)


def relevance_distribution(facts: DataFrame) -> DataFrame:
    counts = facts.groupBy("relevance").agg(F.count("*").alias("n"))
    return counts.select("relevance", "n", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 4).alias("percent"))


def documents_with(facts: DataFrame, keywords: list[str], least: float) -> DataFrame:
    found = facts.where(F.col("keyword").isin(keywords) & (F.col("relevance") >= least))
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("keyword")), ",").alias("found"), F.round(F.avg("relevance"), 4).alias("mean"), F.count_distinct("keyword").alias("keywords"))


def distribution(keywords: DataFrame, facts: DataFrame) -> DataFrame:
    """By category: keywords, those mapped, and their share."""
    seen = facts.select("keyword").distinct().withColumn("mapped", F.lit(1))
    return keywords.join(seen, "keyword", "left").groupBy("category").agg(F.count("*").alias("keywords"), F.count("mapped").alias("mapped"), F.round(F.count("mapped") / F.count("*"), 2).alias("share"))


def heatmap(facts: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """Largest relevance of each keyword in each group of documents (doc_id, group), a column for each name, 0 if none."""
    wide = facts.join(groups, "doc_id").groupBy("keyword").pivot("group", names).agg(F.max("relevance"))
    return wide.na.fill(0)


def inverted_index(facts: DataFrame) -> DataFrame:
    """(kind, name, keyword, n, docs): totals of each keyword, and by category, priority and document."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name")) for kind, c in (("total", "keyword"), ("category", "category"), ("priority", "priority"), ("document", "doc_id"))])
    # Counted by document first, so that each has a row for each kind, and not for each of its chunks.
    counted = facts.groupBy("keyword", "category", "priority", "doc_id").agg(F.count("*").alias("n"))
    return counted.select("keyword", "doc_id", "n", F.inline(kinds)).groupBy("kind", "name", "keyword").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("docs"))


def taxonomy_faults(dim: DataFrame, facts: DataFrame, most: int = 3) -> DataFrame:
    """(keyword, fault): keywords that no document has (orphaned), and those of over `most` categories (over-assigned)."""
    orphans = dim.select("keyword").distinct().join(facts.select("keyword").distinct(), "keyword", "left_anti").select("keyword", F.lit("orphaned").alias("fault"))
    over = dim.groupBy("keyword").agg(F.count_distinct("category").alias("n")).where(F.col("n") > most).select("keyword", F.lit("over-assigned").alias("fault"))
    return orphans.unionAll(over)


def query_distribution(facts: DataFrame, keywords: list[str], n: int) -> DataFrame:
    """The documents that cover most of a query's keywords."""
    found = facts.where(F.col("keyword").isin(keywords)).groupBy("doc_id").agg(F.count_distinct("keyword").alias("matched"), F.max("relevance").alias("best"), F.round(F.avg("relevance"), 4).alias("mean"))
    return found.withColumn("coverage", F.round(F.col("matched") / len(keywords), 4)).orderBy(F.desc("matched"), F.desc("mean"), "doc_id").limit(n)


def coverage(facts: DataFrame) -> DataFrame:
    """Documents, chunks and the first three documents of each keyword."""
    pairs = stored(facts.groupBy("keyword", "doc_id").agg(F.count("*").alias("chunks")))  # read twice
    counted = pairs.groupBy("keyword").agg(F.count("doc_id").alias("docs"), F.sum("chunks").alias("chunks"))
    first = first_of(pairs.where("doc_id IS NOT NULL"), "keyword", "doc_id", 3, "samples")
    return counted.join(first, "keyword", "left").select("keyword", "docs", "chunks", F.array_join(F.coalesce("samples", F.array()), ",").alias("samples"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change of document counts by keyword between two facts, and what it means."""
    a = old.groupBy("keyword").agg(F.count_distinct("doc_id").alias("old"))
    b = new.groupBy("keyword").agg(F.count_distinct("doc_id").alias("new"))
    d = F.col("new") - F.col("old")
    return a.join(b, "keyword").select("keyword", "old", "new", F.when(d > 0, "improved").when(d < 0, "degraded").otherwise("unchanged").alias("change"))


def specificity(dim: DataFrame) -> DataFrame:
    """1 / (1 + number of categories) of each keyword, and whether it is in more than three."""
    return dim.groupBy("keyword").agg(F.round(1 / (1 + F.count("category")), 6).alias("specificity"), (F.count("category") > 3).alias("too_many"))


def keyword_scores(docs: DataFrame, important: list[str], stop: list[str], n: int) -> DataFrame:
    """(doc_id, keyword, score): 3 ln(1 + count) for important words, 1.5 for each capitalised word; the best n of a document.

    Words of up to two characters, stop words and numbers score nothing.
    """
    words = docs.select("doc_id", F.explode(text.word_tokens(F.col("text"))).alias("word"))
    counted = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    low = F.lower("word")
    capital = F.when(F.col("word").rlike(r"^\p{Lu}\p{Ll}+$"), 1.5).otherwise(0.0)
    by_word = counted.groupBy("doc_id", low.alias("keyword")).agg(F.sum("n").alias("n"), F.max(capital).alias("capital"))
    score = F.when(F.col("keyword").isin(important), 3 * F.log(1 + F.col("n"))).otherwise(F.lit(0.0)) + F.col("capital")
    scored = by_word.where((F.length("keyword") > 2) & ~F.col("keyword").isin(stop) & ~F.col("keyword").rlike("^[0-9]+$")).select("doc_id", "keyword", F.round(score, 6).alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "keyword"))
    return scored.withColumn("place", place).where(F.col("place") <= n)


def capability_scores(scores: DataFrame, dim: DataFrame) -> DataFrame:
    """(doc_id, category, score): summed keyword scores of each category, over the document's largest."""
    summed = scores.join(dim, "keyword").groupBy("doc_id", "category").agg(F.sum("score").alias("score"))
    return summed.select("doc_id", "category", F.round(F.col("score") / F.max("score").over(Window.partitionBy("doc_id")), 6).alias("score"))


def implementing_all(dim: DataFrame, categories: list[str]) -> DataFrame:
    """Keywords that belong to all of the categories."""
    return dim.where(F.col("category").isin(categories)).groupBy("keyword").agg(F.count_distinct("category").alias("n")).where(F.col("n") == len(categories)).select("keyword")


def extended_scores(docs: DataFrame, patterns: list[str], important: list[str], known: list[str], stop: list[str], n: int) -> DataFrame:
    """(doc_id, keyword, score): the best n keywords of each text by eight kinds of evidence.

    3 for each place of a domain pattern; 3 ln(1 + count) for important terms; 1.5 for each capitalised word that is
    neither important nor a stop word; 2 for each run of two or three capitalised words; 2 ln(1 + count) for known
    keywords, 1.5 ln(1 + count) for the longer words of those of several words; 1.5 for each hyphenated word; 1.8 for each
    acronym. Keywords of up to two characters, stop words and numbers are left out.
    """
    low = F.lower("text")
    entry = lambda keyword, score: F.struct(keyword.alias("keyword"), score.cast("double").alias("score"))
    fixed = lambda score: lambda x: entry(F.lower(x), F.lit(score))
    bare = F.filter(F.transform(F.split("text", r"\s+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda t: t != "")
    of_kind = lambda pattern: F.filter(bare, lambda t: t.rlike(pattern))
    counted = lambda term, weight: entry(F.lit(term), weight * F.log1p((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)))
    parts = [w for k in known if " " in k for w in k.split() if len(w) > 3 and w not in stop]
    streams = [F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), fixed(3.0)) for p in patterns]
    streams.append(F.array(*[counted(t, 3.0) for t in important], *[counted(k, 2.0) for k in known], *[counted(w, 1.5) for w in parts]))
    streams.append(F.transform(F.filter(of_kind("^[A-Z][a-z]{2,}$"), lambda t: ~F.lower(t).isin([*stop, *important])), fixed(1.5)))
    streams.append(F.transform(F.filter(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}"), F.lit(0)), lambda p: F.length(p) > 5), fixed(2.0)))
    streams.append(F.transform(F.filter(of_kind("^[A-Za-z]+-[A-Za-z]+$"), lambda t: F.length(t) > 5), fixed(1.5)))
    streams.append(F.transform(of_kind("^[A-Z]{3,5}$"), fixed(1.8)))
    summed = docs.select("doc_id", F.inline(F.concat(*streams))).where("score > 0").groupBy("doc_id", "keyword").agg(F.round(F.sum("score"), 6).alias("score"))
    kept = summed.where((F.length("keyword") > 2) & ~F.col("keyword").isin(stop) & ~F.col("keyword").rlike("^[0-9]+$"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "keyword"))
    return kept.withColumn("place", place).where(F.col("place") <= n)
