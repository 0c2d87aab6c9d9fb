"""Queries of several weighted variants over `documents`, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import fuzzy
from sparquill.operators import variants as op
from sparquill.plans.search import BASE
from sparquill.sources.tables import table

ASKED = [
    {"name": "license", "variants": op.variants("the license of", ["license", "of"], ["license agreement", "under the license"], ["rights", "of"]), "phrases": ["of the", "License"], "capabilities": ["en", "src1", "src2"]},
    {"name": "wanted", "variants": op.variants("the and", [], ["in the"], []), "phrases": ["in the"], "wanted": ["src3", "fr"]},
]


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", F.array("lang", "source").alias("capabilities"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("score", "normalized", "overlap", "bonus", "combined") if c in df.columns})


def variant_search(spark, d):
    return _rounded(op.search(_docs(spark, d), ASKED, 25))


def okapi_scores(spark, d):
    rows = [("a", "the", 1.0), ("a", "license", 0.8), ("b", "license", 0.5), ("b", "of", 0.3)]
    return _rounded(op.okapi(_docs(spark, d), spark.createDataFrame(rows, "query string, term string, weight double")))


def phrase_bonuses(spark, d):
    return op.phrase_hits(_docs(spark, d), {q["name"]: q["phrases"] for q in ASKED}).withColumn("times", F.round("times", 6))


def fuzzy_keywords(spark, d):
    """Words of part names as keywords, in the texts of documents; tests hold it against difflib."""
    names = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), r"\s+")).alias("keyword"))
    names = names.unionAll(spark.createDataFrame([(x,) for x in ("license", "agreement", "copyright", "warranty")], "keyword string"))
    return fuzzy.fuzzy_keywords(table(spark, d, "documents"), names, 0.8).withColumn("ratio", F.round("ratio", 6))


_OKAPI = """
plain AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM plain) ELSE idf END AS idf FROM plain),
avgdl AS (SELECT avg(len(w)) AS a FROM w),
bm AS (SELECT query, doc_id, sum(weight * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM tc JOIN q USING (term) JOIN idf USING (term), avgdl GROUP BY query, doc_id)
"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_TERMS = f"""v(query, variant, weight) AS (VALUES {_values((q['name'], v, x) for q in ASKED for v, x in q['variants'])}),
q AS (SELECT query, term, sum(weight) AS weight FROM (SELECT query, weight, unnest(string_split(variant, ' ')) AS term FROM v) GROUP BY ALL)"""
_PHRASES = f"""ph(query, phrase) AS (VALUES {_values((q['name'], p.lower()) for q in ASKED for p in q['phrases'])}),
hit AS (SELECT query, doc_id, (length(lower(text)) - length(replace(lower(text), phrase, ''))) / length(phrase) AS places FROM documents, ph),
met AS (SELECT query, doc_id, sum(ln(1 + places)) AS times, count(*) FILTER (WHERE places > 0) AS met FROM hit GROUP BY ALL HAVING max(places) > 0)"""
SQL = {
    "okapi_scores": f"WITH {BASE} q(query, term, weight) AS (VALUES ('a', 'the', 1.0), ('a', 'license', 0.8), ('b', 'license', 0.5), ('b', 'of', 0.3)), {_OKAPI} SELECT query, doc_id, round(score, 6) AS score FROM bm",
    "phrase_bonuses": f"WITH {_PHRASES} SELECT query, doc_id, round(times, 6) AS times, met FROM met",
    "variant_search": f"""WITH {BASE} {_TERMS}, {_OKAPI}, {_PHRASES},
s AS (SELECT query, doc_id, round(coalesce(score, 0) + 0.3 * coalesce(times, 0), 9) AS score, 0.1 * coalesce(met, 0) AS bonus FROM bm FULL JOIN met USING (query, doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place, max(score) OVER (PARTITION BY query) AS most FROM s),
b AS (SELECT query, doc_id, score, bonus, score / most AS normalized, CASE query WHEN 'license' THEN (CAST(lang = 'en' AS INT) + CAST(source = 'src1' AS INT) + CAST(source = 'src2' AS INT)) / 3 ELSE 1 END AS overlap
      FROM o JOIN documents USING (doc_id) WHERE score >= 0.01 AND place <= CASE query WHEN 'license' THEN 25 ELSE 500 END AND (query = 'license' OR source = 'src3' OR lang = 'fr')),
c AS (SELECT *, round(0.5 * normalized + 0.3 * overlap + 0.2 * bonus, 9) AS combined FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY combined DESC, score DESC, doc_id) AS rank FROM c)
SELECT query, rank, doc_id, round(score, 6) AS score, round(normalized, 6) AS normalized, round(overlap, 6) AS overlap, round(bonus, 6) AS bonus, round(combined, 6) AS combined FROM r WHERE rank <= 25""",
}

QUERIES = {f.__name__: f for f in (variant_search, okapi_scores, phrase_bonuses, fuzzy_keywords)}
