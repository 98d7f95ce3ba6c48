"""A corpus scored by its distinct texts gives the rows of scoring each document."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark import scale
from shelfmark.operators import lexical, tune
from shelfmark.operators.lexical import Strategy
from shelfmark.plans import strategies as st

SCHEMA = ("product_id string, title string, description string, brand string, category string, catalog_text string, search_profile string, "
          "price double, popularity_score double, availability string, updated_at timestamp")
OR = Strategy("or", {"description": 1.0, "title": 2.0})
ALL = [OR, st.strategy("baseline_bm25"), st.strategy("boosted_bm25"), st.strategy("enriched_profile"), st.strategy("boosted_lexical")]


def as_of():
    return F.lit("2026-05-01 00:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def shop(spark):
    """300 products with 25 texts; popularities repeat, differ by less than a rounded score shows, or are missing."""
    rng = random.Random(4)
    word = lambda n: " ".join(rng.choice(("red", "steel", "coffee", "maker", "grinder", "tent")) for _ in range(n))
    texts = [(word(2), word(6) if i % 6 else None, f"Brand {i % 3}", f"Cat {i % 2}", word(8), word(9)) for i in range(25)]
    rows = []
    for i in range(300):
        popularity = rng.choice((None, 40.0, 40.0, 40.0 + rng.random() * 1e-5, float(rng.randint(0, 50))))
        rows.append((f"p{rng.randrange(10**6)}-{i}", *texts[i % 25], 1.0, popularity, "in_stock", None))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn(
        "updated_at", F.when(F.col("popularity_score") < 20, F.lit("2026-04-01").cast("timestamp"))).checkpoint()
    asked = [f"{a} {b}" for a in ("red", "steel", "cofee") for b in ("maker", "tent", "grinder")] + ["red", "brand 1", "steel red coffee tent makr", "", " ", "unknown"]
    return docs, spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(asked)], "qid string, query string")


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark):
    scale.ensure_checkpoint_dir(spark)


def lines(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


RANKED = ("strategy", "qid", "rank", "product_id", "score")


@pytest.mark.parametrize("size, bound", [(1, None), (15, None), (4, 1)])
def test_same_rows_as_each_document(spark, shop, monkeypatch, size, bound):
    docs, queries = shop
    monkeypatch.setattr(lexical, "REPEATED", 10**9)
    want = lines(lexical.rank(docs, queries, ALL, size, as_of()), *RANKED)
    monkeypatch.setattr(lexical, "REPEATED", 2)
    if bound:
        monkeypatch.setattr(scale, "BROADCAST_BYTES", bound)
    assert lexical.distinct_texts(docs, ALL, as_of()).docs.count() == 25
    assert lines(lexical.rank(docs, queries, ALL, size, as_of()), *RANKED) == want and want


def test_scoring_meets_texts_not_documents(spark, shop):
    """The rows that are scored do not grow with the copies."""
    docs, queries = shop
    counts = []
    for times in (1, 8):
        more = docs.select(F.explode(F.sequence(F.lit(1), F.lit(times))).alias("n"), "*").withColumn("product_id", F.concat("product_id", F.col("n").cast("string"))).drop("n")
        texts = lexical.distinct_texts(more, ALL, as_of())
        counts.append(lexical.text_scores(texts, lexical.prepare(texts.docs, queries, ALL), ALL).count())
    assert counts[0] == counts[1] > 0


def test_hits_totals_and_explanations(spark, shop, monkeypatch):
    docs, queries = shop
    found = []
    for repeated in (10**9, 2):
        monkeypatch.setattr(lexical, "REPEATED", repeated)
        hits, totals = lexical.search(docs, queries, ALL, 4, as_of())
        parts = lexical.explain(docs, queries, [ALL[3]], 3, as_of()).withColumn("contribution", F.round("contribution", 9))
        found.append((lines(hits.df, *RANKED), lines(totals.df, "strategy", "qid", "total"),
                      lines(parts, "qid", "rank", "product_id", "field", "clause", "term", "tf", "df", "contribution")))
    assert found[0] == found[1] and all(found[0])


def test_tuned_configurations(spark, shop, monkeypatch):
    docs, queries = shop
    judged = docs.select(F.explode(F.array(F.lit("red maker"), F.lit("steel tent"))).alias("query"), "product_id", (F.length("product_id") % 3).alias("grade"))
    boosts = F.create_map(*(x for f, b in st.BASELINE_BOOSTS.items() for x in (F.lit(f), F.lit(b))))
    configs = tune.propose(spark.range(1).select(F.lit("baseline_bm25").alias("strategy"), boosts.alias("boosts")))
    found = []
    for repeated in (10**9, 2):
        monkeypatch.setattr(lexical, "REPEATED", repeated)
        found.append(sorted(map(tuple, tune.evaluate_configs(docs, queries, judged, "baseline_bm25", configs).collect())))
    assert found[0] == found[1] and len(found[0]) == 10
