"""Ranking queries over `documents`, seen as files with code metadata, and over small query tables; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.functions import text
from sparquill.operators import ranking as op
from sparquill.operators import search
from sparquill.plans.keywords import DIM, VALUES
from sparquill.plans.search import BASE, COS, QUERY
from sparquill.sources.tables import table

ASKED = "License of ISO 20022 pacs.8 the"
TERMS = ["license", "of", "iso", "20022", "pacs.8", "the"]
SPLIT = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"


def _files(spark, d):
    body = F.concat("text", F.lit(" ISO-"), (F.col("doc_id") % 7).cast("string"), F.lit(" pacs."), (F.col("doc_id") % 11).cast("string"))
    x = table(spark, d, "documents").select("doc_id", body.alias("text"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("_license."), "lang").alias("source_file"),
        F.when(F.col("lang") == "en", "code").when(F.col("lang") == "fr", "pdf").otherwise("text").alias("file_type"), F.when(F.col("doc_id") % 3 == 0, "tal").otherwise("python").alias("language"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("payments"))).otherwise(F.array().cast("array<string>")).alias("capabilities"))
    part = lambda k, n: F.slice(text.tokens(F.col("text")), k, n)
    return x.withColumns({"keywords": part(1, 12), "functions": part(1, 5), "classes": part(6, 5), "imports": part(11, 5), "system_calls": part(16, 5)})


def ranking_features(spark, d):
    found = op.features(_files(spark, d), ASKED, ["of the"])
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in op.WEIGHTS if c != "bm25_score"])


def ranked_results(spark, d):
    return op.reranked(_files(spark, d), ASKED, ["of the"]).select("doc_id", "source_file", F.round("score", 6).alias("score"))


def ranking_explanations(spark, d):
    found = op.features(_files(spark, d), ASKED, ["of the"]).withColumn("bm25_score", F.lit(0.0))
    return found.select("doc_id", F.size(op.explanation()).alias("parts"), F.regexp_extract(F.get(op.explanation(), F.lit(0)), "^[a-z_0-9]+", 0).alias("largest"))


def _procedures(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.replace(F.col("text"), F.lit(", "), F.lit(" ! ")).alias("code"))


def code_search(spark, d):
    return op.in_code(_procedures(spark, d), "the license").withColumn("score", F.round("score", 6))


def code_word_search(spark, d):
    return op.in_code(_procedures(spark, d), "license").withColumn("score", F.round("score", 6))


def comment_search(spark, d):
    return op.in_comments(_procedures(spark, d), "the license").withColumn("score", F.round("score", 6))


def name_suggestions(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return op.suggestions(names, "rd wdget").withColumn("score", F.round("score", 6))


# Queries are made of the names of parts, in words of either engine.
ASKS = "SELECT DISTINCT concat(CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END, CASE p_size % 5 WHEN 0 THEN ' the license of it' WHEN 1 THEN ' is it a licensed License' WHEN 2 THEN ' or red bolts now' ELSE '' END) AS query"
SYNONYMS = [("red", ["crimson", "scarlet", "ruby"]), ("widget", ["gadget"]), ("bolt", ["screw", "pin"])]
KNOWN = [("red widget", ["red gadget"]), ("fastener", ["bolt", "screw"])]


def _asks(spark, d):
    return spark.sql(f"{ASKS} FROM {{part}}", part=table(spark, d, "part"))


def query_expansion(spark, d):
    more = spark.createDataFrame(SYNONYMS, "stem string, synonyms array<string>")
    return op.expanded(_asks(spark, d), more).select("query", F.array_join("terms", ",").alias("terms"))


def query_terms(spark, d):
    return op.known_terms(_asks(spark, d), spark.createDataFrame(KNOWN, "term string, variations array<string>"))


def query_keywords(spark, d):
    return op.query_keywords(_asks(spark, d), spark.createDataFrame([(k, p) for k, _, p in DIM], "keyword string, priority string"))


def keyword_patterns(spark, d):
    """How many documents each pattern meets; a document is read once for all patterns."""
    phrases = ["of the", "the", "license", "to be"]
    found = op.keyword_patterns(spark.createDataFrame([(p,) for p in phrases], "keyword string")).collect()
    x = table(spark, d, "documents").select(F.explode(F.array(*[F.when(F.col("text").rlike(f"(?i){r.pattern}"), r.keyword) for r in found])).alias("keyword"))
    return x.where("keyword IS NOT NULL").groupBy("keyword").agg(F.count("*").alias("docs"))


def capability_documents(spark, d):
    return op.with_capability(_files(spark, d), "payments").groupBy("file_type").agg(F.count("*").alias("n"))


def federated_search(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text")
    return op.federated(search.bm25(x, QUERY), search.cosine(x, QUERY), x).withColumn("score", F.round("score", 6))


def matching_blocks(spark, d):
    """Where the documents repeat the second and third line of document 1; a text's own lines are what is sought."""
    first = table(spark, d, "documents").where("doc_id = 1").first()
    return op.matching_blocks(table(spark, d, "documents"), first.text.split("\n")[1:3])


def packed_context(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", F.substring("text", 1, 300).alias("line"), "text")
    scored = search.top(search.bm25(x, QUERY), 40).join(x.select("doc_id", F.col("source").alias("group"), "line"), "doc_id")
    return op.packed_context(scored, 3000)


FILES = f"""r0 AS (SELECT doc_id, source, lang, text || ' ISO-' || doc_id % 7 || ' pacs.' || doc_id % 11 AS text FROM documents),
r AS (SELECT doc_id, text, lower(text) AS low, {SPLIT} AS w, lower(source || '/' || doc_id || '_license.' || lang) AS title, source || '/' || doc_id || '_license.' || lang AS source_file, CASE lang WHEN 'en' THEN 'code' WHEN 'fr' THEN 'pdf' ELSE 'text' END AS ft, doc_id % 3 = 0 AS tal FROM r0)"""


def _sum(make):
    return " + ".join(make(t) for t in TERMS)


_ONE = [f"list_filter(range(len(w)), lambda k: contains(w[k + 1], '{t}'))" for t in TERMS]
FEATURES = f"""g AS (SELECT *, len(list_intersect(list_distinct(w[1:12]), {TERMS})) AS bo, len(list_distinct(w[1:12])) AS dk, len(regexp_extract_all(text, '(?i)ISO[\\s-]?\\d+')) AS iso, len(regexp_extract_all(text, '(?i)pacs\\.\\d+')) AS pacs,
  CAST((length(low) - length(replace(low, '{ASKED.lower()}', ''))) / {len(ASKED)} AS INT) AS n, len(list_filter(range(1, greatest(len(w), 1)), lambda k: w[k] = 'of' AND w[k + 1] = 'the')) AS places, flatten([{', '.join(_ONE)}]) AS spots FROM r),
f AS (SELECT doc_id, source_file, CASE WHEN bo > 0 THEN 20 * (bo / 6.0) * (bo / dk) / (bo / 6.0 + bo / dk) ELSE 0 END AS keyword_match, CASE WHEN doc_id % 2 = 0 THEN 5.0 ELSE 0 END AS capability_match,
  CASE WHEN contains(title, '{ASKED.lower()}') THEN 10.0 ELSE 0 END + 3.0 * ({_sum(lambda t: f"CAST(contains(title, '{t}') AS INT)")}) AS title_match,
  CASE WHEN n > 0 THEN least(15 * ln(1 + n), 40) ELSE 0 END + 10.0 * places AS exact_phrase,
  least(20.0, 3.0 * ({_sum(lambda t: f"len(list_filter(w[1:10], lambda x: contains(x, '{t}')))")})) AS function_match,
  least(10.0, {_sum(lambda t: f"1.0 * len(list_filter(w[11:15], lambda x: contains(x, '{t}'))) + 2.0 * len(list_filter(w[16:20], lambda x: contains(x, '{t}')))")}) AS code_metadata,
  CASE WHEN len(w) >= 2 AND len(spots) >= 2 THEN least(20.0 * len(spots) / (list_max(spots) - list_min(spots) + 1), 15.0) ELSE 0 END AS match_density,
  CASE WHEN len(spots) > 0 THEN 10 * (1 - list_min(spots) / len(w)) ELSE 0 END AS position_score,
  CASE WHEN ft = 'code' THEN 2.0 + CAST(tal AS INT) WHEN ft = 'pdf' THEN 1.5 ELSE 0 END AS file_type_boost, least(5.0 * iso + 5.0 * pacs, 25.0) AS domain_pattern,
  ({_sum(lambda t: f"CAST(contains(low, '{t}') AS INT)")}) / 6.0 * 10 AS query_coverage FROM g)"""
NAMED = [c for c in op.WEIGHTS if c != "bm25_score"]
BM = f"""{BASE.replace('documents', 'r').replace(SPLIT, 'w')} q AS (SELECT unnest({TERMS}) AS term), avgdl AS (SELECT avg(len(w)) AS a FROM w),
bm AS (SELECT doc_id, sum(ln((n.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM tc JOIN q USING (term) JOIN df USING (term), n, avgdl GROUP BY doc_id),
top AS (SELECT doc_id, round(score, 9) AS bm25_score FROM bm WHERE score > 0.01 ORDER BY 2 DESC, 1 LIMIT 100)"""
LINES = "p AS (SELECT doc_id AS name, upper(replace(text, ', ', ' ! ')) AS up FROM documents)"
ASK_VALUES = f"a AS ({ASKS} FROM part)"


def _times(phrase):
    return f"((length(up) - length(replace(up, '{phrase}', ''))) / {len(phrase)})"


SQL = {
    "ranking_features": f"WITH {FILES}, {FEATURES} SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in NAMED)} FROM f",
    "ranked_results": f"""WITH {FILES}, {FEATURES}, {BM}, s AS (SELECT doc_id, source_file, round(bm25_score + {' + '.join(f'{w} * {c}' for c, w in op.WEIGHTS.items() if c != 'bm25_score')}, 9) AS score FROM f JOIN top USING (doc_id)),
      k AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY score DESC, doc_id) AS k FROM s) SELECT doc_id, source_file, round(score, 6) AS score FROM k WHERE k <= 3 ORDER BY k.score DESC, doc_id LIMIT 20""",
    "ranking_explanations": f"""WITH {FILES}, {FEATURES}, u AS (UNPIVOT (SELECT doc_id, {', '.join(f'CAST({w} * {c} AS DOUBLE) AS {c}' for c, w in op.WEIGHTS.items() if c != 'bm25_score')} FROM f) ON {', '.join(NAMED)} INTO NAME name VALUE v),
      o AS (SELECT doc_id, least(count(*) FILTER (v > 0), 5) AS parts, arg_max(name, [v, -list_position({NAMED}, name)]) FILTER (v > 0) AS largest FROM u GROUP BY 1) SELECT * FROM o""",
    "code_search": f"WITH {LINES}, c AS (SELECT name, {_times('THE LICENSE')} AS n, CAST(contains(up, 'THE') AS INT) + CAST(contains(up, 'LICENSE') AS INT) AS m FROM p) SELECT name, round(least(CASE WHEN n > 0 THEN n * 20 WHEN m = 2 THEN 6 END / 40, 1), 6) AS score, CAST(n AS INT) AS phrases, m AS words FROM c WHERE n > 0 OR m = 2",
    "code_word_search": f"WITH {LINES} SELECT name, round(least({_times('LICENSE')} * 2 / 20, 1), 6) AS score, 0 AS phrases, 1 AS words FROM p WHERE contains(up, 'LICENSE')",
    "comment_search": f"""WITH {LINES}, l AS (SELECT name, unnest(string_split(up, chr(10))) AS l FROM p), c AS (SELECT name, substr(l, strpos(l, '!')) AS c FROM l WHERE contains(l, '!')),
      s AS (SELECT name, CASE WHEN contains(c, 'THE LICENSE') THEN 10 WHEN contains(c, 'THE') OR contains(c, 'LICENSE') THEN 2 END AS s FROM c) SELECT name, round(least(sum(s) / 20, 1), 6) AS score, count(s) AS lines FROM s GROUP BY 1 HAVING count(s) > 0""",
    "name_suggestions": "WITH x AS (SELECT DISTINCT p_name AS name FROM part), y AS (SELECT name, 1 - levenshtein(upper(name), 'RD WDGET') / greatest(length(name), 8) AS s FROM x) SELECT name, round(s, 6) AS score FROM y WHERE s >= 0.4 ORDER BY round(s, 9) DESC, name LIMIT 5",
    "query_expansion": f"WITH {ASK_VALUES}, t AS (SELECT query, unnest(regexp_split_to_array(lower(query), '\\s+')) AS t FROM a), s(t, m) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v[:2]})' for k, v in SYNONYMS)}), e AS (SELECT query, t AS term FROM t UNION SELECT query, unnest(m) FROM t JOIN s USING (t)) SELECT query, string_agg(term, ',' ORDER BY term) AS terms FROM e GROUP BY 1",
    "query_terms": f"""WITH {ASK_VALUES}, k(term, v) AS (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {v})' for t, v in KNOWN)}),
      m AS (SELECT query, term, contains(lower(query), term) AS e, list_filter(v, lambda x: contains(lower(query), x))[1] AS f FROM a, k)
      SELECT query, term, CASE WHEN e THEN 'exact' ELSE 'variation' END AS type, CASE WHEN NOT e THEN f END AS variation FROM m WHERE e OR f IS NOT NULL
      UNION ALL SELECT query, lower(query), 'potential_mwt', NULL FROM a WHERE len(string_split(query, ' ')) IN (2, 3) AND query NOT IN (SELECT query FROM m WHERE e OR f IS NOT NULL)""",
    "query_keywords": f"""WITH {ASK_VALUES}, d(keyword, category, priority) AS (VALUES {VALUES}), m AS (SELECT query, keyword, priority FROM a, d WHERE regexp_matches(lower(query), '\\b' || keyword || '\\b'))
      SELECT query, keyword, priority, row_number() OVER (PARTITION BY query ORDER BY list_position(['critical', 'high', 'medium', 'low'], priority), -length(keyword), keyword) AS place FROM m""",
    "keyword_patterns": r"WITH k(keyword, p) AS (VALUES ('of the', '(?i)\bof\s+the\b'), ('the', '(?i)\bthe\b'), ('license', '(?i)\blicense\b'), ('to be', '(?i)\bto\s+be\b')) SELECT keyword, count(*) AS docs FROM k, documents WHERE regexp_matches(text, p) GROUP BY 1",
    "capability_documents": "SELECT CASE lang WHEN 'en' THEN 'code' WHEN 'fr' THEN 'pdf' ELSE 'text' END AS file_type, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1",
    "packed_context": f"""WITH {BASE} q AS (SELECT unnest(['the', 'of', 'license']) AS term), avgdl AS (SELECT avg(len(w)) AS a FROM w),
      bm AS (SELECT doc_id, sum(ln((n.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM tc JOIN q USING (term) JOIN df USING (term), n, avgdl GROUP BY doc_id),
      t AS (SELECT doc_id, round(score, 9) AS score, source AS "group", length(left(text, 300)) AS n FROM bm JOIN documents USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 40),
      pl AS (SELECT *, round(sum(score) OVER (PARTITION BY "group"), 9) AS total, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, doc_id) AS place FROM t),
      u AS (SELECT *, sum(n) OVER (ORDER BY total DESC, "group", place) AS used FROM pl WHERE place <= 5) SELECT "group", doc_id, place FROM u WHERE used <= 3000""",
    "federated_search": f"""WITH {BASE} q AS (SELECT unnest(['the', 'of', 'license']) AS term), avgdl AS (SELECT avg(len(w)) AS a FROM w),
      bm AS (SELECT doc_id, sum(ln((n.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM tc JOIN q USING (term) JOIN df USING (term), n, avgdl GROUP BY doc_id), {COS},
      a AS (SELECT doc_id, 'lexical' AS index, 0.5 * tanh(round(score, 9) / 2) AS score FROM bm ORDER BY round(bm.score, 9) DESC, doc_id LIMIT 40), c AS (SELECT doc_id, round(score, 9) AS score FROM co ORDER BY 2 DESC, 1 LIMIT 40),
      u AS (SELECT * FROM a UNION ALL SELECT doc_id, 'other', 0.5 * coalesce((score - (SELECT min(score) FROM c)) / nullif((SELECT max(score) - min(score) FROM c), 0), 0) FROM c),
      b AS (SELECT doc_id, arg_max(index, [CAST(score AS VARCHAR), index]) AS index, max(score) AS score FROM u GROUP BY 1), s AS (SELECT b.*, list_distinct({SPLIT}) AS w, row_number() OVER (ORDER BY b.score DESC, doc_id) AS k FROM b JOIN documents USING (doc_id)),
      x AS (SELECT s.doc_id FROM s JOIN s t ON t.k < s.k AND len(list_intersect(s.w, t.w)) / greatest(len(list_distinct(list_concat(s.w, t.w))), 1) >= 0.85)
      SELECT doc_id, index, round(score, 6) AS score FROM s WHERE doc_id NOT IN (SELECT doc_id FROM x) ORDER BY round(s.score, 9) DESC, doc_id LIMIT 20""",
}

QUERIES = {f.__name__: f for f in (
    ranking_features, ranked_results, ranking_explanations, code_search, code_word_search, comment_search, name_suggestions, query_expansion, query_terms, query_keywords, keyword_patterns,
    capability_documents, federated_search, matching_blocks, packed_context,
)}
