"""The rows that asked terms meet are dealt to as many tasks as hold them, whatever the session's number of partitions."""

from pyspark.sql import functions as F

from shelfmark.operators import lexical
from shelfmark.operators.lexical import Strategy


def test_matches_of_a_task_are_bounded(spark, monkeypatch):
    docs = spark.range(600).select(
        F.col("id").cast("string").alias("product_id"), F.concat(F.lit("red chair "), F.col("id") % 150).alias("title"))
    queries = spark.createDataFrame([(str(i), f"red chair {i}") for i in range(20)], "qid string, query string")
    chosen = [Strategy("one", {"title": 1.0})]
    want = sorted(tuple(r) for r in lexical.rank(docs, queries, chosen, 5).collect())
    bound = 2_000
    monkeypatch.setattr(lexical, "MATCHES", bound, raising=False)
    texts = lexical.distinct_texts(docs, chosen)
    kinds = {"title": "text"}
    for rows, share in ((docs, ()), (texts.docs, (texts.share if hasattr(texts, "share") else 1.0,))):
        prepared = lexical.prepare(docs, queries, chosen)
        id_col = "product_id" if rows is docs else lexical.TEXT
        met = lexical.contributions(rows, prepared, kinds, id_col, *share).select(F.spark_partition_id().alias("p"))
        sizes = [r["count"] for r in met.groupBy("p").count().collect()]
        assert max(sizes) < 2 * bound, sizes
    got = sorted(tuple(r) for r in lexical.rank(docs, queries, chosen, 5).collect())
    assert got == want
