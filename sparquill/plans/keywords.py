"""Keyword analytics over `documents`, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import keywords as op
from sparquill.sources.tables import table

DIM = [
    ("the", "article", "low"), ("a", "article", "low"), ("der", "article", "medium"), ("le", "article", "medium"), ("of", "link", "high"), ("and", "link", "high"),
    ("und", "link", "medium"), ("que", "link", "critical"), ("license", "legal", "critical"), ("licensed", "legal", "critical"), ("absent", "legal", "high"), ("is", "verb", "low"),
]
LANGS = ["de", "en", "es", "fr"]
MORE = [*DIM, ("of", "legal", "low"), ("the", "link", "low"), ("the", "legal", "low"), ("the", "verb", "low")]
VALUES = ", ".join(f"('{k}', '{c}', '{p}')" for k, c, p in DIM)
MORE_VALUES = ", ".join(f"('{k}', '{c}', '{p}')" for k, c, p in MORE)
TOK = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"


def _fact(size):
    return f"""f AS (SELECT keyword, category, priority, doc_id, pos // {size} AS chunk_index, CAST(least(count(*), 5) AS INT) AS relevance
      FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {TOK} AS w FROM documents)) t JOIN dim ON term = keyword GROUP BY ALL)"""


HEAD = f"WITH dim(keyword, category, priority) AS (VALUES {VALUES}), {_fact(200)}"


def _facts(spark, d, size=200):
    return op.mappings(table(spark, d, "documents"), op.taxonomy(spark, DIM), size)


def keyword_top(spark, d):
    return op.top_keywords(_facts(spark, d), 10)


def keyword_top_chunks(spark, d):
    return op.top_chunks(_facts(spark, d), 20)


def keyword_categories(spark, d):
    return op.roll(_facts(spark, d), "category")


def keyword_priorities(spark, d):
    return op.roll(_facts(spark, d), "priority")


def keyword_gaps(spark, d):
    return op.gaps(op.taxonomy(spark, DIM), _facts(spark, d), 100)


def keyword_relevance(spark, d):
    return op.relevance_distribution(_facts(spark, d))


def keyword_documents(spark, d):
    return op.documents_with(_facts(spark, d), ["the", "of", "license"], 2)


def keyword_distribution(spark, d):
    return op.distribution(op.taxonomy(spark, DIM), _facts(spark, d))


def keyword_heatmap(spark, d):
    groups = table(spark, d, "documents").select("doc_id", F.col("lang").alias("group"))
    return op.heatmap(_facts(spark, d), groups, LANGS)


def keyword_inverted(spark, d):
    return op.inverted_index(_facts(spark, d))


def taxonomy_faults(spark, d):
    return op.taxonomy_faults(op.taxonomy(spark, MORE), _facts(spark, d), 2)


def keyword_query_documents(spark, d):
    return op.query_distribution(_facts(spark, d), ["the", "of", "license"], 25)


def keyword_coverage(spark, d):
    return op.coverage(_facts(spark, d))


def keyword_compare(spark, d):
    docs = table(spark, d, "documents")
    dim = op.taxonomy(spark, DIM)
    # Two readings of all documents: by whole texts, and by what follows their first line break.
    after = docs.select("doc_id", F.regexp_replace("text", r"^[^\n]*\n", "").alias("text"))
    return op.compare(op.mappings(docs, dim), op.mappings(after, dim))


def _parts(spark, d):
    """Words of part names as keywords of brands."""
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("keyword"), F.col("p_brand").alias("category")).distinct()


def keyword_specificity(spark, d):
    return op.specificity(op.taxonomy(spark, MORE).select("keyword", "category").unionAll(_parts(spark, d)))


def keyword_scores(spark, d):
    return op.keyword_scores(table(spark, d, "documents"), ["the", "license", "and"], ["of"], 10)


def keyword_evidence(spark, d):
    docs = table(spark, d, "documents")
    return op.extended_scores(docs, [r"[0-9]+\.[0-9]+"], ["the", "license"], ["under the license", "of"], ["and", "der"], 10)


def capability_scores(spark, d):
    return op.capability_scores(op.keyword_scores(table(spark, d, "documents"), [k for k, _, _ in DIM], ["of"], 20), op.taxonomy(spark, MORE))


def keyword_in_all(spark, d):
    known = op.taxonomy(spark, MORE).select("keyword", "category").unionAll(_parts(spark, d))
    return op.implementing_all(known, ["article", "link", "legal"]).unionAll(op.implementing_all(known, ["Brand#1", "Brand#2", "Brand#3"]))


PARTS = f"SELECT keyword, category FROM (VALUES {MORE_VALUES}) v(keyword, category, priority) UNION ALL SELECT DISTINCT unnest(string_split(p_name, ' ')), p_brand FROM part"
ROLL = "count(DISTINCT keyword) AS keywords, count(DISTINCT doc_id) AS docs, round(avg(relevance), 4) AS mean, median(relevance) AS median, count(*) AS n"


def _scores(important, stop, n):
    imp = ", ".join(f"'{k}'" for k in important)
    return rf"""kw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_-]+')) AS word FROM documents),
      ks AS (SELECT doc_id, lower(word) AS keyword, round(CASE WHEN lower(word) IN ({imp}) THEN 3 * ln(1 + count(*)) ELSE 0 END + max(CASE WHEN regexp_matches(word, '^\p{{Lu}}\p{{Ll}}+$') THEN 1.5 ELSE 0 END), 6) AS score FROM kw GROUP BY 1, 2),
      kr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword) AS place FROM ks WHERE score > 0 AND length(keyword) > 2 AND keyword NOT IN ('{stop}') AND NOT regexp_matches(keyword, '^[0-9]+$')),
      kk AS (SELECT * FROM kr WHERE place <= {n})"""


BARE = r"list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda t: regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda t: t <> '')"
EVIDENCE = f"""b AS (SELECT doc_id, text, lower(text) AS low, {BARE} AS b FROM documents),
  s AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[0-9]+\\.[0-9]+'))) AS keyword, 3.0 AS score FROM b
    {' '.join(f"UNION ALL SELECT doc_id, '{t}', {w} * ln(1 + (length(low) - length(replace(low, '{t}', ''))) / {len(t)}) FROM b" for t, w in (('the', 3.0), ('license', 3.0), ('under the license', 2.0), ('of', 2.0), ('under', 1.5), ('license', 1.5)))}
    UNION ALL SELECT doc_id, lower(unnest(list_filter(b, lambda t: regexp_matches(t, '^[A-Z][a-z]{{2,}}$') AND lower(t) NOT IN ('and', 'der', 'the', 'license')))), 1.5 FROM b
    UNION ALL SELECT doc_id, lower(unnest(list_filter(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+){{1,2}}'), lambda t: length(t) > 5))), 2.0 FROM b
    UNION ALL SELECT doc_id, lower(unnest(list_filter(b, lambda t: regexp_matches(t, '^[A-Za-z]+-[A-Za-z]+$') AND length(t) > 5))), 1.5 FROM b
    UNION ALL SELECT doc_id, lower(unnest(list_filter(b, lambda t: regexp_matches(t, '^[A-Z]{{3,5}}$')))), 1.8 FROM b)"""

SQL = {
    "keyword_top": f"{HEAD} SELECT keyword, count(DISTINCT doc_id) AS docs FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "keyword_top_chunks": f"{HEAD} SELECT doc_id || '#' || chunk_index AS chunk, count(*) AS keywords FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "keyword_categories": f"{HEAD} SELECT category, {ROLL} FROM f GROUP BY 1",
    "keyword_priorities": f"{HEAD} SELECT priority, {ROLL} FROM f GROUP BY 1",
    "keyword_gaps": f"{HEAD} SELECT keyword, dim.category, dim.priority, count(DISTINCT doc_id) AS docs FROM dim LEFT JOIN f USING (keyword) GROUP BY ALL HAVING count(DISTINCT doc_id) < 100",
    "keyword_relevance": f"{HEAD} SELECT relevance, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 4) AS percent FROM f GROUP BY 1",
    "keyword_documents": f"{HEAD} SELECT doc_id, array_to_string(list_sort(list_distinct(list(keyword))), ',') AS found, round(avg(relevance), 4) AS mean, count(DISTINCT keyword) AS keywords FROM f WHERE keyword IN ('the', 'of', 'license') AND relevance >= 2 GROUP BY 1",
    "keyword_distribution": f"{HEAD} SELECT category, count(*) AS keywords, count(m) AS mapped, round(count(m) / count(*), 2) AS share FROM dim LEFT JOIN (SELECT DISTINCT keyword, 1 AS m FROM f) USING (keyword) GROUP BY 1",
    "keyword_evidence": f"WITH {EVIDENCE}, g AS (SELECT doc_id, keyword, round(sum(score), 6) AS score FROM s WHERE score > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword) AS place FROM g WHERE length(keyword) > 2 AND keyword NOT IN ('and', 'der') AND NOT regexp_matches(keyword, '^[0-9]+$')) SELECT * FROM r WHERE place <= 10",
    "keyword_heatmap": f"{HEAD} SELECT keyword, {', '.join(f"coalesce(max(relevance) FILTER (lang = '{k}'), 0) AS {k}" for k in LANGS)} FROM f JOIN documents USING (doc_id) GROUP BY 1",
    "keyword_inverted": f"{HEAD}, i AS (SELECT 'total' AS kind, keyword AS name, keyword, doc_id FROM f UNION ALL SELECT 'category', category, keyword, doc_id FROM f UNION ALL SELECT 'priority', priority, keyword, doc_id FROM f UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), keyword, doc_id FROM f) SELECT kind, name, keyword, count(*) AS n, count(DISTINCT doc_id) AS docs FROM i GROUP BY 1, 2, 3",
    "taxonomy_faults": f"WITH dim(keyword, category, priority) AS (VALUES {MORE_VALUES}) SELECT DISTINCT keyword, 'orphaned' AS fault FROM dim WHERE keyword NOT IN (SELECT unnest({TOK}) FROM documents) UNION ALL SELECT keyword, 'over-assigned' FROM dim GROUP BY 1 HAVING count(DISTINCT category) > 2",
    "keyword_query_documents": f"{HEAD} SELECT doc_id, count(DISTINCT keyword) AS matched, max(relevance) AS best, round(avg(relevance), 4) AS mean, round(count(DISTINCT keyword) / 3, 4) AS coverage FROM f WHERE keyword IN ('the', 'of', 'license') GROUP BY 1 ORDER BY 2 DESC, 4 DESC, 1 LIMIT 25",
    "keyword_coverage": f"{HEAD} SELECT keyword, count(DISTINCT doc_id) AS docs, count(*) AS chunks, array_to_string(list_sort(list_distinct(list(doc_id)))[1:3], ',') AS samples FROM f GROUP BY 1",
    "keyword_compare": rf"{HEAD}, a AS (SELECT keyword, count(DISTINCT doc_id) AS old FROM f GROUP BY 1), h AS (SELECT DISTINCT doc_id, unnest({TOK.replace('text', "regexp_replace(text, '^[^" + chr(92) + "n]*" + chr(92) + "n', '')")}) AS keyword FROM documents), b AS (SELECT keyword, count(*) AS new FROM h JOIN dim USING (keyword) GROUP BY 1) SELECT keyword, old, new, CASE WHEN new > old THEN 'improved' WHEN new < old THEN 'degraded' ELSE 'unchanged' END AS change FROM a JOIN b USING (keyword)",
    "keyword_specificity": f"WITH dim(keyword, category) AS ({PARTS}) SELECT keyword, round(1 / (1 + count(*)), 6) AS specificity, count(*) > 3 AS too_many FROM dim GROUP BY 1",
    "keyword_scores": f"WITH {_scores(['the', 'license', 'and'], 'of', 10)} SELECT doc_id, keyword, score, place FROM kk",
    "capability_scores": f"WITH dim(keyword, category, priority) AS (VALUES {MORE_VALUES}), {_scores([k for k, _, _ in DIM], 'of', 20)}, c AS (SELECT doc_id, category, sum(score) AS s FROM kk JOIN dim USING (keyword) GROUP BY 1, 2) SELECT doc_id, category, round(s / max(s) OVER (PARTITION BY doc_id), 6) AS score FROM c",
    "keyword_in_all": f"WITH dim(keyword, category) AS ({PARTS}) SELECT keyword FROM dim WHERE category IN ('article', 'link', 'legal') GROUP BY 1 HAVING count(DISTINCT category) = 3 UNION ALL SELECT keyword FROM dim WHERE category IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1 HAVING count(DISTINCT category) = 3",
}

QUERIES = {f.__name__: f for f in (
    keyword_top, keyword_top_chunks, keyword_categories, keyword_priorities, keyword_gaps, keyword_relevance, keyword_documents, keyword_distribution, keyword_heatmap, keyword_inverted, taxonomy_faults, keyword_query_documents,
    keyword_coverage, keyword_compare, keyword_specificity, keyword_scores, keyword_evidence, capability_scores, keyword_in_all,
)}
