from pyspark.sql import functions as F

from sparquill.operators import search


def test_rows_of_frequent_terms_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(search, "FREQUENT", 100)
    rows = spark.range(0, 3000, numPartitions=3).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("term"), F.lit(1).alias("tf"), F.spark_partition_id().alias("at"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    got = search.with_df(rows, df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(df, "term").select(*got.columns).collect()))
    assert got.where("term = 'the'").select("at", F.spark_partition_id().alias("now")).distinct().count() == 3


def test_cosine_leaves_out_documents_without_a_term(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, ""), (4, None)], "doc_id long, text string")
    assert {r.doc_id for r in search.cosine(docs, "a z").collect()} == {1} and search.cosine(docs, "z").count() == 0
