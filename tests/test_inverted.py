"""The stored index: same rows as scoring the corpus, few folders read, few postings met."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark import scale
from shelfmark.operators import inverted, lexical
from shelfmark.operators.lexical import Strategy
from shelfmark.plans import strategies as st

SCHEMA = ("product_id string, title string, description string, brand string, category string, catalog_text string, search_profile string, "
          "price double, popularity_score double, availability string, updated_at timestamp")
def as_of():
    return F.lit("2026-05-01 00:00:00").cast("timestamp")


def catalog_rows(count=400):
    random.seed(3)
    rare = ["".join(random.choice("bcdfgklmnprst") + random.choice("aeiou") for _ in range(3)) for _ in range(150)]
    words = lambda n: " ".join(random.choice(rare) if random.random() < 0.6 else random.choice(("the", "red", "steel", "new")) for _ in range(n))
    return [
        (f"p{i:04}", words(4), words(25) if i % 9 else None, f"Brand {i % 7}", f"Cat {i % 5}", words(8), words(12), float(i % 90), float(random.randint(0, 500)),
         "in_stock" if i % 3 else "backorder", None) for i in range(count)], rare


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, rare = catalog_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("updated_at", F.expr("timestamp'2026-01-01' + make_interval(0, 0, 0, cast(price as int))"))
    return docs, rare, inverted.write_index(docs, str(tmp_path_factory.mktemp("index")), buckets=16)


def asked(spark, rare):
    texts = [f"the {rare[i]} red {rare[i + 40]}" for i in range(12)] + ["the", "the red steel", rare[0][:-1] + "x " + rare[9], "brand 3", "", "nothing-known", " "]
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, query string")


OR = Strategy("or", {"description": 1.0, "title": 2.0})
CHOSEN = {
    "or": [OR], "and": [st.strategy("baseline_bm25")], "fuzzy": [st.strategy("boosted_bm25")], "mixed": [OR, st.strategy("enriched_profile"), st.strategy("boosted_lexical")],
}


def same(found, wanted):
    key = lambda rows: sorted((r.strategy, r.qid, r["rank"], r.product_id, round(r.score, 5)) for r in rows.collect())
    found, wanted = key(found), key(wanted)
    assert [x[:4] for x in found] == [x[:4] for x in wanted] and found
    assert all(abs(a[4] - b[4]) < 2e-5 for a, b in zip(found, wanted, strict=True))


@pytest.mark.parametrize("name", CHOSEN)
def test_rows_equal_a_scan_of_the_corpus(spark, corpus, name):
    docs, rare, index = corpus
    same(inverted.search(index, asked(spark, rare), CHOSEN[name], 5, as_of()), lexical.rank(docs, asked(spark, rare), CHOSEN[name], 5, as_of()))


def test_filters_and_blank_queries(spark, corpus):
    docs, rare, index = corpus
    rows = [("a", f"the {rare[3]}", "CAT 1", None, None, None, 60.0), ("b", "", "cat 2", "brand 3", "in_stock", 10.0, 50.0), ("c", None, None, None, None, 20.0, None),
            ("d", " ", "", None, "backorder", None, None), ("e", "", "cat 2", "brand 3", "in_stock", 10.0, 50.0), ("f", "the red", None, "Brand 2", "in_stock", None, None)]
    requests = spark.createDataFrame(rows, "qid string, query string, f_category string, f_brand string, f_availability string, f_min_price double, f_max_price double")
    for chosen in ([st.strategy("boosted_lexical")], [OR]):
        same(inverted.search(index, requests, chosen, 4, as_of()), lexical.rank(docs, requests, chosen, 4, as_of()))


def test_frequent_words_are_not_met(spark, corpus):
    docs, rare, index = corpus
    queries = spark.createDataFrame([(f"q{i}", f"the {rare[i]} red {rare[i + 40]} steel") for i in range(20)], "qid string, query string")
    for chosen, share in (([OR], 0.5), ([st.strategy("baseline_bm25")], 0.2)):
        prepared = inverted.prepare(index, queries, chosen)
        everything = inverted.matches(index, prepared, prepared.scoring).count()
        met = inverted.pruned_matches(index, prepared, chosen, 3).count()
        assert met < share * everything


def test_only_the_folders_asked_for_are_read(spark, corpus):
    docs, rare, index = corpus
    prepared = inverted.prepare(index, spark.createDataFrame([("q", f"the {rare[0]}")], "qid string, query string"), [OR])
    scoring = scale.settle(prepared.scoring.df)
    plan = inverted.matches(index, prepared, scoring)._jdf.queryExecution().executedPlan().toString()
    numbers = {r[0] for r in scoring.df.select(inverted._bucket(F.col("tid"), index.buckets)).distinct().collect()}
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert "bucket" in filters and len(numbers) < index.buckets
    assert all(re.search(rf"\b{n}\b", filters) for n in numbers)
    # Postings stay where they are: no exchange but that of the query side's broadcast.
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_reopened_and_empty(spark, corpus, tmp_path):
    docs, rare, _ = corpus
    inverted.write_index(docs.where("false"), str(tmp_path), buckets=4)
    empty = inverted.open_index(spark, str(tmp_path))
    assert inverted.search(empty, asked(spark, rare), [OR], 5).collect() == []
    with pytest.raises(ValueError):
        inverted.write_index(docs, str(tmp_path), buckets=12)


def test_search_beyond_broadcast(spark, corpus, monkeypatch):
    docs, rare, index = corpus
    want = inverted.search(index, asked(spark, rare), [OR], 5).checkpoint()
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 1)
    same(inverted.search(index, asked(spark, rare), [OR], 5), want)
