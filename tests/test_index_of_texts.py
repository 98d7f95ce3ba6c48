"""The stored index of a corpus that repeats its texts: counted and searched by text, the rows those of a scan."""

import pytest
from pyspark.sql import functions as F
from test_inverted import OR, SCHEMA, as_of, same

from shelfmark import scale
from shelfmark.operators import inverted, lexical
from shelfmark.plans import strategies as st

WORDS = ("red", "steel", "coffee", "maker", "grinder", "tent", "lamp")


def shop(spark, copies):
    """30 texts, each as often as asked; prices, availability and popularity differ between documents of one text."""
    rows = []
    for i in range(30 * copies):
        n = i % 30
        text = [WORDS[n % 7], WORDS[n // 7 % 7], WORDS[(n * 3 + 1) % 7]]
        rows.append((f"p{i * 7919 % 100003:06}", " ".join(text[:2]), " ".join(text) if n % 5 else None, f"Brand {n % 3}", f"Cat {n % 2}", " ".join(text * 2),
                     f"Product {text[0]}", float(i % 37), float(i % 11), "in_stock" if i % 4 else "backorder", None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    scale.ensure_checkpoint_dir(spark)
    docs = shop(spark, 6).checkpoint()
    return docs, inverted.write_index(docs, str(tmp_path_factory.mktemp("index")), buckets=4)


def test_postings_do_not_grow_with_copies(spark, stored, tmp_path):
    docs, index = stored
    one = inverted.write_index(shop(spark, 1), str(tmp_path), buckets=4)
    assert index.postings.count() == one.postings.count() > 0
    counts = {(r.field, r.term): r.df for r in one.terms.collect()}
    assert {(r.field, r.term): r.df for r in index.terms.collect()} == {k: 6 * n for k, n in counts.items()}


def test_filters_that_tell_copies_apart(spark, stored):
    docs, index = stored
    rows = [("a", "red steel", None, None, "backorder", None, None), ("b", "coffee", "cat 1", None, None, 10.0, 20.0), ("c", "maker", "CAT 0", "brand 1", None, None, None),
            ("d", "", "cat 1", None, "in_stock", None, 30.0), ("e", "tent", None, None, None, None, None)]
    requests = spark.createDataFrame(rows, "qid string, query string, f_category string, f_brand string, f_availability string, f_min_price double, f_max_price double")
    chosen = [OR, st.strategy("boosted_lexical"), st.strategy("boosted_bm25")]
    same(inverted.search(index, requests, chosen, 4, as_of()), lexical.rank(docs, requests, chosen, 4, as_of()))


def test_postings_not_scores_are_exchanged(spark, stored):
    """What a frequent word gives to many queries stays in the task of its text."""
    docs, index = stored
    asked = spark.createDataFrame([(f"q{i}", f"{a} {b} steel") for i, (a, b) in enumerate((a, b) for a in WORDS for b in WORDS)], "qid string, query string")
    chosen = [st.strategy("boosted_bm25")]
    query = inverted.ask(index, inverted.prepare(index, asked, chosen), chosen, as_of())
    scores = inverted.text_scores(inverted.matches_by_text(index, query, query.prepared.scoring), query, chosen)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    # The others are of the query side.
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_text" in line]
    assert len(shuffles) == 1 and "slot" not in shuffles[0] and "qid" not in shuffles[0]
    same(inverted.search(index, asked, chosen, 3, as_of()), lexical.rank(docs, asked, chosen, 3, as_of()))


def test_only_texts_that_can_still_lead_are_completed(spark, tmp_path):
    """400 texts share the rare word; only the few with it twice can be among the first, whatever frequent words add."""
    rows = [(f"p{i:04}", "zebra zebra zebra" if i < 5 else "zebra" if i < 400 else f"w{i}", None, "b", "c", None, "common word", 1.0, 0.0, "in_stock", None) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("title", F.concat_ws(" ", "title", F.lit("common word"), F.concat(F.lit("n"), "product_id")))
    index = inverted.write_index(docs, str(tmp_path), buckets=4)
    asked = spark.createDataFrame([("q", "zebra np0001 np0002 np0003 common word")], "qid string, query string")
    chosen = [lexical.Strategy("or", {"title": 1.0})]
    met = inverted.pruned_matches(index, inverted.prepare(index, asked, chosen), chosen, 3)
    assert met.select("_text").distinct().count() < 50
    same(inverted.search(index, asked, chosen, 3), lexical.rank(docs, asked, chosen, 3))
