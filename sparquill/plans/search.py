"""Search queries over `documents` and part names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.functions import text
from sparquill.operators import search as op
from sparquill.sources.tables import table

QUERY = "the of license"
PHRASE = "of the"
TOK = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"
BASE = f"""
w AS (SELECT doc_id, {TOK} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM w),
tc AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM p GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tc GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
"""
BM25 = f"""
q AS (SELECT unnest(['the', 'of', 'license']) AS term),
avgdl AS (SELECT avg(len(w)) AS a FROM w),
bm AS (SELECT doc_id, sum(ln((n.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score
       FROM tc JOIN q USING (term) JOIN df USING (term), n, avgdl GROUP BY doc_id)
"""
COS = """
idf AS (SELECT term, ln((n.n + 1) / (df.df + 1)) + 1 AS idf FROM df, n),
q2 AS (SELECT term, idf AS q FROM idf WHERE term IN ('the', 'of', 'license')),
norms AS (SELECT doc_id, sqrt(sum((tf * idf) * (tf * idf))) AS norm FROM tc JOIN idf USING (term) GROUP BY doc_id),
co AS (SELECT doc_id, sum(tf * idf * q) / (any_value(norm) * (SELECT sqrt(sum(q * q)) FROM q2)) AS score
       FROM tc JOIN idf USING (term) JOIN q2 USING (term) JOIN norms USING (doc_id) GROUP BY doc_id)
"""


def docs(spark, d):
    return table(spark, d, "documents")


def names(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("name"))


def bm25_topk(spark, d):
    return op.top(op.bm25(docs(spark, d), QUERY), 20)


def idf_vocabulary(spark, d):
    return op.vocabulary(docs(spark, d), 3, 0.5).withColumn("idf", F.round("idf", 6))


def idf_smoothed(spark, d):
    return op.smoothed_idf(docs(spark, d)).withColumn("idf", F.round("idf", 6))


def tf_idf_weights(spark, d):
    return op.tf_idf(docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("largest"))


def corpus_stats(spark, d):
    t = docs(spark, d).select("lang", F.size(text.tokens(F.col("text"))).alias("dl"))
    return t.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("dl").alias("tokens"), F.round(F.avg("dl"), 6).alias("mean_tokens"), F.max("dl").alias("longest"))


def tfidf_cosine(spark, d):
    return op.top(op.cosine(docs(spark, d), QUERY), 20)


def phrase_search(spark, d):
    return op.phrase_hits(docs(spark, d), PHRASE).groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("start").alias("first"), F.max("start").alias("last"))


def proximity_search(spark, d):
    return op.proximity(docs(spark, d), "the", "of", 5).select("doc_id", "distance")


def rrf_fusion(spark, d):
    x = docs(spark, d)
    lists = [op.ranked(op.bm25(x, QUERY), 50), op.ranked(op.cosine(x, QUERY), 50)]
    return op.reciprocal_rank_fusion(lists).withColumn("score", F.round("score", 9))


def hybrid_search(spark, d):
    x = docs(spark, d)
    return op.hybrid(op.bm25(x, QUERY), op.cosine(x, QUERY)).withColumn("score", F.round("score", 6))


def normalised_scores(spark, d):
    s = op.bm25(docs(spark, d), QUERY)
    ends = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return s.join(F.broadcast(ends)).select("doc_id", F.round(op.tanh_scaled(F.col("score")), 6).alias("tanh"), F.round((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("min_max"))


def rerank_features(spark, d):
    f = op.rerank_features(docs(spark, d), PHRASE)
    return f.select("doc_id", *[F.round(c, 6).alias(c) for c in ("phrase", "density", "position", "coverage", "keyword")])


def _scored(spark, d, by):
    x = docs(spark, d)
    return op.bm25(x, QUERY).withColumn("score", F.round("score", 9)).join(x.select("doc_id", by), "doc_id")


def diversified_results(spark, d):
    return op.diversified(_scored(spark, d, "source"), "source", 3, 30)


def round_robin_results(spark, d):
    return op.round_robin(_scored(spark, d, "lang"), "lang", 30)


def fuzzy_names(spark, d):
    return op.fuzzy(names(spark, d), "red widget Brand#17").withColumn("score", F.round("score", 6))


def contains_names(spark, d):
    return op.containing(names(spark, d), "brand#2").withColumn("score", F.round("score", 6))


def token_names(spark, d):
    return op.token_matches(names(spark, d), "red bolt").withColumn("score", F.round("score", 6))


def cascade_search(spark, d):
    return op.cascade(names(spark, d), "red widget brand").withColumn("score", F.round("score", 6))


def word_chunks(spark, d):
    return text.word_chunks(docs(spark, d), 100, 20).select("doc_id", "chunk_index", "start_word", "chunk_id")


def garbage_texts(spark, d):
    return docs(spark, d).groupBy("lang", text.is_garbage(F.col("text")).alias("garbage")).agg(F.count("*").alias("n"))


def sentence_contexts(spark, d):
    return docs(spark, d).select("doc_id", F.explode(text.sentences_with(F.col("text"), "license")).alias("sentence"))


def query_validation(spark, d):
    terms = ["the", "license", "released"]
    n = sum(F.contains(F.lower("text"), F.lit(t)).cast("int") for t in terms)
    return docs(spark, d).select("doc_id", n.alias("matched")).where("matched >= 2")


def numbered_lines(spark, d):
    lines = text.numbered_lines(docs(spark, d))
    return lines.groupBy("doc_id").agg(F.max("line_no").alias("lines"), F.sum(F.length("line")).alias("chars"), F.max(F.struct(F.length("line").alias("n"), (-F.col("line_no")).alias("k"))).alias("m")).select("doc_id", "lines", "chars", F.col("m.n").alias("longest"), (-F.col("m.k")).alias("longest_at"))


def line_chunks(spark, d):
    return text.line_chunks(table(spark, d, "documents"), 80, 15).withColumn("chunk", F.md5("chunk"))


def line_windows(spark, d):
    """Two lines around each line that names a license."""
    x = docs(spark, d).select("doc_id", F.split("text", "\n").alias("l"))
    hit = x.select("doc_id", "l", F.explode(F.filter(F.sequence(F.lit(1), F.size("l")), lambda k: F.contains(F.lower(F.get("l", k - 1)), F.lit("license")))).alias("line_no"))
    start = F.greatest(F.lit(1), F.col("line_no") - 2)
    return hit.select("doc_id", "line_no", F.md5(F.array_join(F.slice("l", start, F.col("line_no") + 2 - start + 1), "\n")).alias("window_md5"))


def near_duplicate_sets(spark, d):
    return op.near_duplicate_classes(docs(spark, d), 0.85).withColumn("similarity", F.round("similarity", 6))


def word_lists(spark, d):
    x = docs(spark, d)
    return x.select("doc_id", F.size(text.word_tokens(F.col("text"))).alias("words"), F.size(text.identifier_tokens(F.col("text"))).alias("identifiers"), F.size(text.core_terms(F.col("text"), ["the", "of", "a"])).alias("core"))


def name_tokens(spark, d):
    n = table(spark, d, "supplier").select(F.concat(F.replace(F.col("s_name"), F.lit("#"), F.lit("_")), F.lit("^K"), F.col("s_nationkey").cast("string")).alias("name"))
    return n.select("name", F.array_join(text.name_parts(F.col("name")), "|").alias("parts"))


def name_wildcards(spark, d):
    return names(spark, d).where(F.col("name").rlike(text.wildcard("r?d *Brand#1?")))


def word_variations(spark, d):
    n = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return n.select("word", F.array_join(F.array_sort(text.variations(F.col("word"))), ",").alias("forms"))


def snippets(spark, d):
    return docs(spark, d).select("doc_id", F.length(text.snippet(F.col("text"))).alias("n"))


def phrase_lists(spark, d):
    return docs(spark, d).select("doc_id", F.size(text.phrases(F.col("text"))).alias("n"))


NAMES = "SELECT p_name || ' ' || p_brand || ' ' || p_partkey AS name FROM part"
SCORED = f"WITH {BASE} {BM25}, s AS (SELECT doc_id, round(score, 9) AS score, source, lang FROM bm JOIN documents USING (doc_id))"

SQL = {
    "bm25_topk": f"WITH {BASE} {BM25} SELECT doc_id, round(score, 9) AS score FROM bm ORDER BY 2 DESC, 1 LIMIT 20",
    "idf_vocabulary": f"WITH {BASE} z AS (SELECT 1) SELECT term, df, round(ln(n.n / df), 6) AS idf FROM df, n WHERE df >= 3 AND df <= floor(n.n * 0.5)",
    "idf_smoothed": f"WITH {BASE} z AS (SELECT 1) SELECT term, df, round(ln((n.n + 1) / (df + 1)) + 1, 6) AS idf FROM df, n",
    "tf_idf_weights": f"WITH {BASE} z AS (SELECT doc_id, tf / dl * ln(n.n / df) AS x FROM tc JOIN df USING (term), n) SELECT doc_id, count(*) AS terms, round(sum(x), 6) AS total, round(max(x), 6) AS largest FROM z GROUP BY doc_id",
    "corpus_stats": f"SELECT lang, count(*) AS docs, CAST(sum(len({TOK})) AS BIGINT) AS tokens, round(avg(len({TOK})), 6) AS mean_tokens, max(len({TOK})) AS longest FROM documents GROUP BY lang",
    "tfidf_cosine": f"WITH {BASE} {COS} SELECT doc_id, round(score, 9) AS score FROM co ORDER BY 2 DESC, 1 LIMIT 20",
    "phrase_search": f"WITH w AS (SELECT doc_id, {TOK} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS k FROM w) SELECT a.doc_id, count(*) AS hits, min(a.k) AS first, max(a.k) AS last FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.k = a.k + 1 WHERE a.t = 'of' AND b.t = 'the' GROUP BY a.doc_id",
    "proximity_search": f"WITH w AS (SELECT doc_id, {TOK} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS k FROM w) SELECT a.doc_id, min(abs(a.k - b.k) - 1) AS distance FROM p a JOIN p b ON a.doc_id = b.doc_id WHERE a.t = 'the' AND b.t = 'of' AND abs(a.k - b.k) - 1 <= 5 GROUP BY a.doc_id",
    "rrf_fusion": f"WITH {BASE} {BM25}, {COS}, r AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm UNION ALL SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) FROM co) SELECT doc_id, round(sum(1 / (60.0 + r)), 9) AS score FROM r WHERE r <= 50 GROUP BY doc_id",
    "hybrid_search": f"WITH {BASE} {BM25}, {COS}, m AS (SELECT max(score) AS m FROM bm), e AS (SELECT min(score) AS lo, max(score) AS hi FROM co), j AS (SELECT coalesce(bm.doc_id, co.doc_id) AS doc_id, 0.5 * coalesce(bm.score / (m + 1e-10), 0) + 0.5 * coalesce((co.score - lo) / (hi - lo), 0) AS score FROM bm FULL JOIN co ON bm.doc_id = co.doc_id, m, e) SELECT doc_id, round(score, 6) AS score FROM j WHERE score >= 0.01",
    "normalised_scores": f"WITH {BASE} {BM25} SELECT doc_id, round(tanh(score / 2), 6) AS tanh, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS min_max FROM bm",
    "rerank_features": f"""WITH w AS (SELECT doc_id, lower(text) AS low, {TOK} AS w FROM documents),
      f AS (SELECT doc_id, low, len(w) AS size, len(list_distinct(w)) AS dis, (length(low) - length(replace(low, 'of the', ''))) / 6 AS n,
        list_filter(range(len(w)), lambda k: list_contains(['of', 'the'], w[k + 1])) AS hits, len(list_intersect(list_distinct(w), ['of', 'the'])) AS bo FROM w)
      SELECT doc_id, round(CASE WHEN n > 0 THEN least(15 * ln(1 + n), 40.0) ELSE 0 END, 6) AS phrase,
        round(CASE WHEN len(hits) >= 2 THEN least(20.0 * len(hits) / (list_max(hits) - list_min(hits) + 1), 15.0) ELSE 0 END, 6) AS density,
        round(CASE WHEN len(hits) > 0 THEN 10 * (1 - list_min(hits) / size) ELSE 0 END, 6) AS position,
        round((CAST(contains(low, 'of') AS INT) + CAST(contains(low, 'the') AS INT)) * 5.0, 6) AS coverage,
        round(CASE WHEN bo > 0 THEN 20 * (bo / greatest(dis, 1)) * (bo / 2.0) / (bo / greatest(dis, 1) + bo / 2.0) ELSE 0 END, 6) AS keyword FROM f""",
    "diversified_results": f"{SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM s) SELECT doc_id, score, source FROM r WHERE k <= 3 ORDER BY score DESC, doc_id LIMIT 30",
    "round_robin_results": f"{SCORED} SELECT doc_id, score, lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS round FROM s ORDER BY round, score DESC, doc_id LIMIT 30",
    "fuzzy_names": f"WITH x AS ({NAMES}), y AS (SELECT name, 1 - levenshtein(upper(name), 'RED WIDGET BRAND#17') / greatest(length(name), 19) AS s FROM x) SELECT name, round(s, 6) AS score FROM y WHERE s >= 0.6",
    "contains_names": f"WITH x AS ({NAMES}) SELECT name, round(7 / length(name), 6) AS score FROM x WHERE contains(upper(name), 'BRAND#2')",
    "token_names": f"""WITH x AS ({NAMES}), y AS (SELECT name, regexp_split_to_array(upper(name), '[\\s_^#]+') AS p FROM x),
      z AS (SELECT name, {' + '.join(f"CASE WHEN list_contains(p, '{t}') THEN 1.0 WHEN len(list_filter(p, lambda a: length(a) >= 3 AND (contains(a, '{t}') OR contains('{t}', a)))) > 0 THEN 0.5 ELSE 0 END" for t in ('RED', 'BOLT'))} AS s FROM y)
      SELECT name, round(s / 2, 6) AS score FROM z WHERE s > 0""",
    "cascade_search": f"""WITH x AS ({NAMES}), y AS (SELECT name, upper(name) AS u, regexp_split_to_array(upper(name), '[\\s_^#]+') AS p FROM x),
      s AS (SELECT name, 0 AS k, 'exact' AS stage, 1.0 AS score FROM y WHERE u = 'RED WIDGET BRAND'
        UNION ALL SELECT name, 1, 'fuzzy', 0.95 * (1 - levenshtein(u, 'RED WIDGET BRAND') / greatest(length(name), 16)) FROM y WHERE 1 - levenshtein(u, 'RED WIDGET BRAND') / greatest(length(name), 16) >= 0.6
        UNION ALL SELECT name, 2, 'contains', 0.85 * 16 / length(name) FROM y WHERE contains(u, 'RED WIDGET BRAND')
        UNION ALL SELECT name, 3, 'token', 0.8 * t / 3 FROM (SELECT name, {' + '.join(f"CASE WHEN list_contains(p, '{t}') THEN 1.0 WHEN len(list_filter(p, lambda a: length(a) >= 3 AND (contains(a, '{t}') OR contains('{t}', a)))) > 0 THEN 0.5 ELSE 0 END" for t in ('RED', 'WIDGET', 'BRAND'))} AS t FROM y) WHERE t > 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) AS rn FROM s)
      SELECT name, stage, round(score, 6) AS score FROM r WHERE rn = 1 AND (k = 0 OR NOT EXISTS (SELECT 1 FROM s WHERE k = 0))""",
    "word_chunks": f"""WITH w AS (SELECT doc_id, {TOK} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS start_word FROM w),
      c AS (SELECT doc_id, start_word, array_to_string(w[start_word + 1 : start_word + 100], ' ') AS c FROM s)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_word) - 1 AS chunk_index, start_word, md5(c) AS chunk_id FROM c WHERE length(c) >= 50""",
    "garbage_texts": r"""WITH f AS (SELECT lang, text, length(text) AS n, length(text) - length(regexp_replace(text, '[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS u, length(text) - length(regexp_replace(text, '[^\x01-\x7F]', '', 'g')) AS x FROM documents)
      SELECT lang, CASE WHEN n < 10 THEN false ELSE u > 0.2 * n OR x > 0.5 * n OR contains(text, chr(65533)) END AS garbage, count(*) AS n FROM f GROUP BY 1, 2""",
    "sentence_contexts": "SELECT doc_id, sentence FROM (SELECT doc_id, unnest(list_transform(string_split(text, '.'), lambda s: trim(s, ' '))) AS sentence FROM documents) WHERE contains(lower(sentence), 'license')",
    "query_validation": "SELECT * FROM (SELECT doc_id, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'released') AS INT) AS matched FROM documents) WHERE matched >= 2",
    "numbered_lines": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) SELECT doc_id, max(k) AS lines, CAST(sum(length(l)) AS BIGINT) AS chars, max(length(l)) AS longest, arg_min(k, [-length(l), k]) AS longest_at FROM l GROUP BY doc_id",
    "line_chunks": r"""WITH RECURSIVE x AS (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM documents),
y AS (SELECT doc_id, l, len(l) AS n, greatest(1, CAST(floor(80 * len(l) / words) AS INT)) AS per, greatest(1, CAST(floor(15 * len(l) / words) AS INT)) AS lap FROM x WHERE words > 0),
z(doc_id, a, b, short) AS (SELECT doc_id, 0, least(per, n), length(regexp_replace(array_to_string(l[1:least(per, n)], ''), '^\s+|\s+$', '', 'g')) < 50 FROM y
  UNION ALL SELECT doc_id, s, least(s + per, n), length(regexp_replace(array_to_string(l[s + 1:least(s + per, n)], ''), '^\s+|\s+$', '', 'g')) < 50
  FROM (SELECT y.*, CASE WHEN short OR b = n OR b - lap <= 0 THEN b ELSE greatest(b - lap, a + 1) END AS s FROM z JOIN y USING (doc_id)) WHERE s < n)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS chunk_index, a + 1 AS start_line, b AS end_line, md5(array_to_string(l[a + 1:b], '')) AS chunk FROM z JOIN y USING (doc_id) WHERE NOT short""",
    "line_windows": "WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), h AS (SELECT doc_id, l, unnest(list_filter(range(1, len(l) + 1), lambda k: contains(lower(l[k]), 'license'))) AS line_no FROM x) SELECT doc_id, line_no, md5(array_to_string(l[greatest(1, line_no - 2) : line_no + 2], chr(10))) AS window_md5 FROM h",
    "near_duplicate_sets": f"""WITH s0 AS (SELECT doc_id, list_sort(list_distinct({TOK})) AS w FROM documents), c AS (SELECT w, min(doc_id) AS id FROM s0 WHERE len(w) > 0 GROUP BY 1), t AS (SELECT id, len(w) AS n, unnest(w) AS term FROM c),
      p AS (SELECT a.id AS doc_id, b.id AS other, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM t a JOIN t b ON a.term = b.term AND b.id < a.id AND a.n >= 0.85 * b.n AND b.n >= 0.85 * a.n GROUP BY 1, 2)
      SELECT doc_id, other, round(c / (n + m - c), 6) AS similarity FROM p WHERE c / (n + m - c) >= 0.85 UNION ALL SELECT doc_id, id, 1.0 FROM s0 JOIN c USING (w) WHERE doc_id <> id""",
    "word_lists": rf"SELECT doc_id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_-]+')) AS words, len(regexp_extract_all(lower(text), '[a-z_][a-z0-9_^]*')) AS identifiers, len(list_filter({TOK}, lambda x: x NOT IN ('the', 'of', 'a'))) AS core FROM documents",
    "name_tokens": "WITH n AS (SELECT replace(s_name, '#', '_') || '^K' || s_nationkey AS name FROM supplier) SELECT name, array_to_string(list_concat(list_filter(regexp_split_to_array(upper(name), '[_^]'), lambda p: length(p) >= 2), [upper(name)]), '|') AS parts FROM n",
    "name_wildcards": f"SELECT name FROM ({NAMES}) WHERE regexp_matches(name, 'r.d .*Brand#1.')",
    "word_variations": "WITH n AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), b AS (SELECT word, CASE WHEN word LIKE '%s' AND length(word) > 3 THEN left(word, length(word) - 1) ELSE word END AS b FROM n) SELECT word, array_to_string(list_sort(list_distinct([word, b, b || 's', b || 'ing', b || 'ed', b || 'ion', b || 'tion', b || 'ment', b || 'er', b || 'or'])), ',') AS forms FROM b",
    "phrase_lists": r"""SELECT doc_id, len(list_distinct(list_concat(regexp_extract_all(text, '"([^"]+)"', 1), regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')))) AS n FROM documents""",
}

QUERIES = {f.__name__: f for f in (
    bm25_topk, idf_vocabulary, idf_smoothed, tf_idf_weights, corpus_stats, tfidf_cosine, phrase_search, proximity_search, rrf_fusion, hybrid_search, normalised_scores, rerank_features,
    diversified_results, round_robin_results, fuzzy_names, contains_names, token_names, cascade_search, word_chunks, garbage_texts, sentence_contexts, query_validation, numbered_lines,
    line_chunks, line_windows, near_duplicate_sets, word_lists, name_tokens, name_wildcards, word_variations, snippets, phrase_lists,
)}
