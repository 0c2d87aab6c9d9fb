"""Ranking of search results by twelve features, and searches in code, comments, queries and several indexes.

All features of a document come from its own row, so they are one projection over the candidates that a first
search has left; nothing is exploded or shuffled for them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text
from sparquill.operators import search
from sparquill.sources.shared import stored

# The weight of each feature in the final score.
WEIGHTS = {
    "bm25_score": 1.0, "keyword_match": 2.5, "capability_match": 2.0, "title_match": 3.0, "exact_phrase": 4.0, "function_match": 2.5,
    "code_metadata": 1.5, "match_density": 2.0, "position_score": 1.5, "file_type_boost": 1.0, "domain_pattern": 3.0, "query_coverage": 1.8,
}
# Patterns of the domain, the pattern that the query must have for them to count, and the points of a place.
DOMAIN = [(r"(?i)ISO[\s-]?\d+", r"(?i)ISO[\s-]?\d+", 5.0), (r"(?i)MT\d{3}", r"(?i)MT\d{3}", 5.0), (r"(?i)pacs\.\d+", r"(?i)pacs\.\d+", 5.0), (r"(?i)pain\.\d+", r"(?i)pain\.\d+", 5.0), (r"(?i)camt\.\d+", r"(?i)camt\.\d+", 5.0), (r"(?i)ACE[\s-]?\d+", r"(?i)ACE", 4.0)]


def _total(columns: list[Column]) -> Column:
    return reduce(Column.__add__, columns, F.lit(0.0))


def _points(names: Column, terms: list[str], each: float) -> Column:
    """Points for each pair of a term and a name that contains it."""
    low = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.lower(x))
    having = lambda t: F.filter(low, lambda x: F.contains(x, F.lit(t)))
    return _total([F.size(having(t)) * each for t in terms])


def keyword_match(keywords: Column, terms: list[str]) -> Column:
    """Ten times the F1 of the query's terms and the document's keywords."""
    asked = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    both = F.size(F.array_intersect(keywords, asked))
    precision, recall = both / F.size(asked), both / F.size(F.array_distinct(keywords))
    return F.when(both > 0, 20 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def title_match(title: Column, query: str) -> Column:
    """Ten points for the whole query in the title, three for each of its words."""
    low = F.lower(title)
    return F.when(F.contains(low, F.lit(query.lower())), 10.0).otherwise(F.lit(0.0)) + _total([F.contains(low, F.lit(t)).cast("int") * 3.0 for t in query.lower().split()])


def occurrences(low: Column, phrase: str) -> Column:
    """How often a phrase stands in a text, places that overlap not counted."""
    return ((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def phrase_places(words: Column, phrase: str) -> Column:
    """How often the words of a phrase stand one after another among words."""
    want = phrase.lower().split()
    starts = F.when(F.size(words) >= len(want), F.sequence(F.lit(1), F.size(words) - len(want) + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda k: F.slice(words, k, len(want)) == F.array(*[F.lit(w) for w in want])))


def exact_phrase(low: Column, words: Column, query: str, terms: list[str]) -> Column:
    """15 ln(1 + n) for n places of the query, 40 at most; and ten for each place of a known term of several words."""
    n = occurrences(low, query.lower())
    return F.when(n > 0, F.least(15 * F.log1p(n), F.lit(40.0))).otherwise(F.lit(0.0)) + _total([phrase_places(words, t) * 10.0 for t in terms])


def domain_pattern(body: Column, query: str) -> Column:
    """Points for each place of the domain patterns that the query has too, 25 at most."""
    return F.least(_total([F.regexp_count(body, F.lit(pattern)) * points for pattern, asked, points in DOMAIN if re.search(asked, query)]), F.lit(25.0))


def features(docs: DataFrame, query: str, terms: list[str] = ()) -> DataFrame:
    """docs (doc_id, text, source_file, file_type, language, keywords, capabilities, functions, classes, imports,
    system_calls) with the features of WEIGHTS but for bm25_score. terms: known terms of several words in the query.
    """
    q = query.lower().split()
    rows = docs.withColumns({"_low": F.lower("text"), "_w": text.tokens(F.col("text"))})
    in_word = lambda x: reduce(Column.__or__, [F.contains(x, F.lit(t)) for t in q])
    # A place for each pair of a term and a word that contains it.
    at = lambda test: F.filter(F.transform("_w", lambda x, k: F.when(test(x), k)), lambda k: k.isNotNull())
    has = lambda t: lambda x: F.contains(x, F.lit(t))
    places = F.flatten(F.array(*[at(has(t)) for t in q]))
    rows = rows.withColumns({"_places": places, "_first": at(in_word)})
    span = F.array_max("_places") - F.array_min("_places") + 1
    code = (F.col("file_type") == "code").cast("int") * (2.0 + F.col("language").isin("tal", "cobol", "sql").cast("int"))
    found = {
        "keyword_match": keyword_match(F.col("keywords"), q),
        "capability_match": F.when(F.size("capabilities") > 0, 5.0).otherwise(0.0),
        "title_match": title_match(F.col("source_file"), query),
        "exact_phrase": exact_phrase(F.col("_low"), F.col("_w"), query, list(terms)),
        "function_match": F.least(_points(F.col("functions"), q, 3.0) + _points(F.col("classes"), q, 3.0), F.lit(20.0)),
        "code_metadata": F.least(_points(F.col("imports"), q, 1.0) + _points(F.col("system_calls"), q, 2.0), F.lit(10.0)),
        "match_density": F.when((F.size("_w") >= 2) & (F.size("_places") >= 2), F.least(20.0 * F.size("_places") / span, F.lit(15.0))).otherwise(F.lit(0.0)),
        "position_score": F.when(F.size("_first") > 0, 10 * (1 - F.array_min("_first") / F.size("_w"))).otherwise(F.lit(0.0)),
        "file_type_boost": code + (F.col("file_type") == "pdf").cast("int") * 1.5,
        "domain_pattern": domain_pattern(F.col("text"), query),
        "query_coverage": _total([F.contains("_low", F.lit(t)).cast("int") * 1.0 for t in q]) / len(q) * 10,
    }
    return rows.withColumns(found).drop("_low", "_w", "_places", "_first")


def final_score() -> Column:
    """The weighted sum of the twelve features."""
    return _total([F.col(name) * weight for name, weight in WEIGHTS.items()])


def explanation(most: int = 5) -> Column:
    """The largest positive weighted features, as texts; equal ones in the order of WEIGHTS."""
    parts = [F.struct((-F.col(n) * w).alias("by"), F.lit(k).alias("nr"), F.format_string(f"{n}: %.2f × {w} = %.2f", F.col(n).cast("double"), F.col(n).cast("double") * w).alias("text")) for k, (n, w) in enumerate(WEIGHTS.items())]
    best = F.slice(F.array_sort(F.array(*parts)), 1, most)
    return F.transform(F.filter(best, lambda x: x["by"] < 0), lambda x: x["text"])


def reranked(docs: DataFrame, query: str, terms: list[str] = (), candidates: int = 100, n: int = 20, each: int = 3) -> DataFrame:
    """The n best of the `candidates` best by BM25, by the final score, at most `each` of one source file, with explanations."""
    first = search.top(search.bm25(docs, query).where("score > 0.01"), candidates).withColumnRenamed("score", "bm25_score")
    scored = features(docs.join(F.broadcast(first), "doc_id"), query, terms).withColumn("score", F.round(final_score(), 9))  # candidates are few
    return search.diversified(scored.withColumn("explanation", explanation()), "source_file", each, n)


def query_words(query: str, least: int = 3) -> list[str]:
    return [w.upper() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", query) if len(w) >= least]


def in_code(procedures: DataFrame, query: str) -> DataFrame:
    """(name, score, phrases, words) of procedures (name, code) that contain a query.

    A query of several words scores 20 for each place of the phrase, or 3 for each word where all are there but not
    the phrase, over 40; one word scores 2 for each place, over 20; 1 at most.
    """
    phrase, words = query.strip().upper(), query_words(query)
    up = F.upper("code")
    counts = [occurrences(up, w) for w in words]
    met = _total([(c > 0).cast("int") * 1.0 for c in counts]).cast("int")
    if len(words) >= 2:
        n = occurrences(up, phrase)
        score = F.when(n > 0, n * 20.0).when(met == len(words), met * 3.0).otherwise(0.0) / 40
    else:
        n = F.lit(0)
        score = _total([c * 2.0 for c in counts]) / 20
    return procedures.select("name", F.least(score, F.lit(1.0)).alias("score"), n.alias("phrases"), met.alias("words")).where("score > 0")


def in_comments(procedures: DataFrame, query: str, mark: str = "!") -> DataFrame:
    """(name, score, lines): lines of procedures (name, code) whose comment has the query count 10, those with a word of it 2, over 20; 1 at most."""
    phrase, words = query.strip().upper(), query_words(query)
    comments = F.transform(F.filter(F.split("code", "\n"), lambda x: F.contains(x, F.lit(mark))), lambda x: F.upper(F.substring(x, F.instr(x, mark), F.length(x))))
    has_word = lambda x: reduce(Column.__or__, [F.contains(x, F.lit(w)) for w in words], F.lit(False))
    whole = F.size(F.filter(comments, lambda x: F.contains(x, F.lit(phrase))))
    some = F.size(F.filter(comments, lambda x: ~F.contains(x, F.lit(phrase)) & has_word(x)))
    return procedures.select("name", F.least((whole * 10 + some * 2) / 20.0, F.lit(1.0)).alias("score"), (whole + some).alias("lines")).where("score > 0")


def suggestions(names: DataFrame, query: str, n: int = 5) -> DataFrame:
    """The n names nearest to a query, from a similarity of 0.4 on."""
    return search.fuzzy(names, query, 0.4).orderBy(F.desc(F.round("score", 9)), "name").limit(n)


def expanded(queries: DataFrame, synonyms: DataFrame, most: int = 2, stem=lambda term: term) -> DataFrame:
    """(query, terms): the words of each query and the first `most` synonyms (stem, synonyms array) of their stems, sorted."""
    words = queries.select("query", F.explode(F.split(F.lower("query"), r"\s+")).alias("term")).where("term <> ''").withColumn("stem", stem(F.col("term")))
    every = words.join(synonyms, "stem", "left").select("query", "term", F.slice(F.coalesce("synonyms", F.array().cast("array<string>")), 1, most).alias("more"))
    return every.groupBy("query").agg(F.array_sort(F.array_union(F.collect_set("term"), F.flatten(F.collect_list("more")))).alias("terms"))


def known_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, term, type, variation): known terms (term, variations array) in each query, by themselves (exact) or by their
    first variation there; a query of two or three words without any is a potential term itself.

    The few terms are broadcast if Spark finds them small.
    """
    low = queries.select("query", F.lower("query").alias("low"))
    other = F.get(F.filter("variations", lambda v: F.contains("low", v)), F.lit(0))
    met = low.join(terms, F.contains("low", "term") | F.exists("variations", lambda v: F.contains("low", v)), "left")
    exact = F.contains("low", "term")
    words = F.size(F.filter(F.split("low", r"\s+"), lambda x: x != ""))
    kind = F.when(F.col("term").isNull(), F.when(words.between(2, 3), "potential_mwt")).when(exact, "exact").otherwise("variation")
    return met.select("query", F.coalesce("term", "low").alias("term"), kind.alias("type"), F.when(~exact, other).alias("variation")).where("type IS NOT NULL")


def query_keywords(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query, keyword, priority, place): keywords (keyword, priority) that stand in each query as words; critical ones first, then longer ones."""
    q, kw = F.lower("query"), F.lower("keyword")
    # The equi-join on words leaves only keywords whose first word the query has; the pattern decides.
    first = lambda c: F.regexp_extract(c, r"\w+", 0)
    asked = queries.select("query", F.explode(F.array_distinct(F.regexp_extract_all(q, F.lit(r"\w+"), F.lit(0)))).alias("word"))
    met = asked.join(keywords.withColumn("word", first(kw)), "word").where(F.regexp_like(q, F.concat(F.lit(r"\b\Q"), kw, F.lit(r"\E\b"))))
    rank = F.array_position(F.array(*[F.lit(p) for p in ("critical", "high", "medium", "low")]), F.col("priority"))
    order = Window.partitionBy("query").orderBy(rank, -F.length("keyword"), "keyword")
    return met.select("query", "keyword", "priority").distinct().withColumn("place", F.row_number().over(order))


def keyword_patterns(keywords: DataFrame) -> DataFrame:
    """(keyword, pattern, place): each keyword as a quoted pattern with flexible white space; longer ones first."""
    quoted = F.concat(F.lit(r"\b"), F.array_join(F.transform(F.split("keyword", r"\s+"), lambda w: F.regexp_replace(w, r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")), r"\s+"), F.lit(r"\b"))
    return keywords.select("keyword", quoted.alias("pattern"), (-F.length("keyword")).alias("place"))


def with_capability(docs: DataFrame, capability: str) -> DataFrame:
    """Documents whose first or any other capability it is."""
    return docs.where(F.array_contains("capabilities", capability))


def distinct_best(results: DataFrame, threshold: float = 0.85) -> DataFrame:
    """results (doc_id, text, score) without those whose word set is like that of a better kept one, by Jaccard similarity
    of threshold or more. For result lists, which are short: they are folded in order of score as one array.
    """
    order = F.struct((-F.col("score")).alias("by"), "doc_id", F.array_distinct(text.tokens(F.col("text"))).alias("w"))
    listed = results.agg(F.array_sort(F.collect_list(order)).alias("l"))
    like = lambda x, t: F.size(F.array_intersect(x["w"], t["w"])) / F.greatest(F.size(F.array_union(x["w"], t["w"])), F.lit(1)) >= threshold
    kept = F.aggregate("l", F.filter("l", lambda _: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda t: like(x, t)), kept).otherwise(F.concat(kept, F.array(x))))
    return results.join(F.broadcast(listed.select(F.explode(kept).alias("x")).select("x.doc_id")), "doc_id", "left_semi")


def federated(lexical: DataFrame, other: DataFrame, docs: DataFrame, n: int = 20, weights: tuple[float, float] = (0.5, 0.5), k: float = 2.0) -> DataFrame:
    """(doc_id, index, score): the n best results of two indexes, the first's scores by tanh(score / k), the second's min-max scaled,
    each by its weight; of near-equal texts the best one. Each index gives its 2 n best.
    """
    a = search.top(lexical, 2 * n).select("doc_id", F.lit("lexical").alias("index"), (search.tanh_scaled(F.col("score"), k) * weights[0]).alias("score"))
    b = search.top(other, 2 * n)
    b = b.select("doc_id", F.lit("other").alias("index"), (search.min_max(F.col("score")) * weights[1]).alias("score"))
    # Stored, as the texts below are read twice, and both indexes with them if this were not.
    best = stored(a.unionAll(b).groupBy("doc_id").agg(F.max_by("index", F.struct("score", "index")).alias("index"), F.max("score").alias("score")))
    texts = docs.select("doc_id", "text").join(F.broadcast(best), "doc_id")  # 4 n rows at most
    return search.top(distinct_best(texts).select("doc_id", "index", "score"), n)


def matching_blocks(docs: DataFrame, lines: list[str], share: float = 0.7) -> DataFrame:
    """(doc_id, start): the first line, from 0, at which most of the first three lines sought stand: as a part of the text's
    line, with it as a part, or of a word similarity over 0.7. Texts without such a place are left out.
    """
    sought = [x.strip() for x in lines if x.strip()][:3]
    n, least = max(len(sought), 1), len(sought) * share

    def like(x: Column, low: Column, want: str) -> Column:
        words = list(dict.fromkeys(want.lower().split()))
        own, theirs = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: w != "")), F.array(*[F.lit(w) for w in words])
        similar = F.size(F.array_intersect(own, theirs)) / F.size(F.array_union(own, theirs)) > 0.7
        # A similar line has over 0.7 of the words, so one at least of the longest ones, if these are one more than may be missing.
        some = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in sorted(words, key=len, reverse=True)[: len(words) - int(len(words) * 0.7)]])
        return F.when(F.contains(x, F.lit(want)) | F.contains(F.lit(want), x), 1).when(some, similar.cast("int")).otherwise(0)

    def after(s: Column, x: Column) -> Column:
        """One more line: h0 to h2 are the hits so far of the places that begin at it, one before and two before."""
        h = [(x[f"l{j}"] + s[f"h{j - 1}"] if j else x["l0"]).alias(f"h{j}") for j in range(n)]
        found = [F.when((h[j] >= least) & (s["k"] >= j), s["k"] - j) for j in range(n)]
        return F.struct((s["k"] + 1).alias("k"), F.least(s["start"], *found).alias("start"), *h)

    # A text is cut once and its lines are folded in one pass: an array of lines named in a step of its own would be made anew for each
    # line, as the filter on start is moved below that step with all that start is made of.
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.trim(x).alias("x"), F.lower(F.trim(x)).alias("low")))
    judged = F.transform(lines, lambda p: F.struct(*[(like(p["x"], p["low"], sought[j]) if sought else F.lit(0)).alias(f"l{j}") for j in range(n)]))
    begin = F.struct(F.lit(0).alias("k"), F.lit(None).cast("int").alias("start"), *[F.lit(0).alias(f"h{j}") for j in range(n)])
    start = F.aggregate(judged, begin, after, lambda s: s["start"])
    return docs.select("doc_id", start.alias("start")).where("start IS NOT NULL")


def packed_context(results: DataFrame, budget: int, each: int = 5) -> DataFrame:
    """(group, doc_id, place): result lines (group, doc_id, score, line) that fit a budget of characters.

    Groups come in order of their total score, each with its `each` best results, as long as they fit.
    """
    total = F.sum("score").over(Window.partitionBy("group"))
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "doc_id"))
    few = results.withColumns({"total": F.round(total, 9), "place": place}).where(F.col("place") <= each)
    used = F.sum(F.length("line")).over(Window.orderBy(F.desc("total"), "group", "place"))  # result lists are short
    return few.withColumn("used", used).where(F.col("used") <= budget).select("group", "doc_id", "place")
