"""The vector index of `embeddings`, alone and fused with lexical search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import vectors as op
from sparquill.plans.search import TOK
from sparquill.plans.variants import _values
from sparquill.sources.tables import table

# Queries: a name, a text, and the row of `embeddings` whose vector is asked for.
ASKED = [("first", "the license of the", 0), ("second", "steel widget nation7 brand#12", 50), ("third", "red ring Supplier#000000003", 101), ("lexical", "und der", None), ("vector", "", 7)]


def _index(spark, d):
    return op.build(table(spark, d, "embeddings"), "vec_id", "embedding")


def _every_fiftieth(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("vec_id").alias("own"), F.col("embedding").alias("v"))


def indexed_neighbours(spark, d):
    """The 20 nearest rows, exactly, by cells that cannot be skipped."""
    found = op.nearest_exact(_index(spark, d), _every_fiftieth(spark, d), 20)
    return found.select(F.col("query").cast("long").alias("query"), "rank", F.col("id").alias("vec_id"), "score")


def probed_neighbours(spark, d):
    """The 20 nearest rows of as many cells as reach a recall of 0.95 on a sample."""
    index = _index(spark, d)
    found = op.nearest(index, _every_fiftieth(spark, d), 20, op.probes_for(index, 20))
    return found.select(F.col("query").cast("long").alias("query"), "rank", F.col("id").alias("vec_id"), "score")


def hybrid_search(spark, d):
    docs, parts, suppliers = (table(spark, d, t) for t in ("documents", "part", "supplier"))
    asked = spark.createDataFrame(ASKED, "query string, text string, vec_id long")
    asked = asked.join(table(spark, d, "embeddings").withColumnRenamed("embedding", "v"), "vec_id", "left").select("query", "text", "v")
    procedures = docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("file"), F.concat_ws(" ", "lang", (F.col("doc_id") % 40).cast("string")).alias("name"))
    symbols = parts.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"), F.col("p_brand").alias("file"), F.col("p_name").alias("name"))
    structures = suppliers.select(F.col("s_suppkey").alias("id"), F.concat(F.col("s_name"), F.lit(" STRUCT nation"), F.col("s_nationkey").cast("string")).alias("text"), F.lit("suppliers").alias("file"), F.col("s_name").alias("name"))
    return op.hybrid(asked, procedures, _index(spark, d), symbols, structures, 10).withColumn("score", F.round("score", 6))


_COSINE = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 6) + 0.0"
SQL = {
    "indexed_neighbours": f"""WITH s AS (SELECT a.vec_id AS query, e.vec_id, {_COSINE} AS score FROM embeddings a, embeddings e WHERE a.vec_id % 50 = 0 AND e.vec_id <> a.vec_id),
r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 20""",
    "hybrid_search": f"""WITH asked(query, text, vec_id) AS (VALUES {_values(("NULL" if x is None else x for x in r) for r in ASKED).replace("'NULL'", "NULL")}),
e AS (SELECT 0 AS nr, doc_id AS id, text, source AS file, lang || ' ' || (doc_id % 40) AS name FROM documents
      UNION ALL SELECT 1, p_partkey, concat_ws(' ', p_name, p_brand, p_type), p_brand, p_name FROM part
      UNION ALL SELECT 2, s_suppkey, s_name || ' STRUCT nation' || s_nationkey, 'suppliers', s_name FROM supplier),
w AS (SELECT nr, id, {TOK} AS w FROM e), n AS (SELECT nr, count(*) AS n, avg(len(w)) AS a FROM w GROUP BY nr),
tc AS (SELECT nr, id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT nr, id, unnest(w) AS term, len(w) AS dl FROM w) GROUP BY nr, id, term),
plain AS (SELECT nr, term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tc JOIN n USING (nr) GROUP BY nr, term),
idf AS (SELECT nr, term, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY nr) ELSE idf END AS idf FROM plain),
q AS (SELECT query, term, count(*) AS weight FROM (SELECT query, unnest(string_split(lower(text), ' ')) AS term FROM asked) WHERE term <> '' GROUP BY ALL),
bm AS (SELECT nr, query, id, round(sum(weight * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score FROM tc JOIN q USING (term) JOIN idf USING (nr, term) JOIN n USING (nr) GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY nr, query ORDER BY score DESC, id) AS place FROM bm WHERE score > 0.1),
near AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY {_COSINE} DESC, e.vec_id) AS place, e.vec_id AS id FROM asked JOIN embeddings a USING (vec_id), embeddings e),
f AS (SELECT query, id, round(sum(1 / (60 + place)), 9) AS score FROM (SELECT query, id, place FROM lex WHERE nr = 0 UNION ALL SELECT query, id, place FROM near) WHERE place <= 20 GROUP BY ALL),
o AS (SELECT 0 AS nr, query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM f QUALIFY place <= 10
      UNION ALL SELECT nr, query, id, score * 0.5, place FROM lex WHERE nr = 1 AND place <= 10 OR nr = 2 AND place <= 5),
k AS (SELECT query, nr, place, id, file, name, score FROM o JOIN e USING (nr, id) QUALIFY row_number() OVER (PARTITION BY query, file, name ORDER BY nr, place, id) = 1)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY nr, place, id) AS rank, CASE nr WHEN 0 THEN 'procedure' WHEN 1 THEN 'symbol' ELSE 'structure' END AS kind, id, file, name, round(score, 6) AS score FROM k""",
}

QUERIES = {f.__name__: f for f in (indexed_neighbours, probed_neighbours, hybrid_search)}
