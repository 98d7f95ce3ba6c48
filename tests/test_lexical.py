import math
import random

import pytest
from pyspark.sql import functions as F

from shelfmark import scale
from shelfmark.operators import fuzzy, lexical
from shelfmark.operators.lexical import Strategy
from shelfmark.plans import strategies as st


def as_of():
    return F.lit("2026-05-01 00:00:00").cast("timestamp")


@pytest.fixture
def catalog(spark):
    data = [
        ("p1", "Red Coffee Maker", "Makes coffee", "Acme", "Kitchen", 20.0, "in_stock", 100.0, "2026-04-30 00:00:00"),
        ("p2", "Coffee Grinder", "Grinds beans", "Beanly", "Kitchen", 40.0, "in_stock", 25.0, "2026-03-25 00:00:00"),
        ("p3", "Red Running Shoes", "Light shoes", "Acme", "Sports", 60.0, "backorder", None, "2025-01-01 00:00:00"),
        ("p4", "Espresso Machine", "Coffee at home", "Crème", "Kitchen", 300.0, "in_stock", 0.0, None),
    ]
    df = spark.createDataFrame(data, (
        "product_id string, title string, description string, brand string, category string, price double, "
        "availability string, popularity_score double, updated_at string"))
    text = F.concat_ws(" ", "title", "description", "brand", "category")
    return df.withColumns({
        "catalog_text": text, "search_profile": F.concat(F.lit("Product: "), text),
        "updated_at": F.col("updated_at").cast("timestamp")})


def asked(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "qid string, query string")


def plain_bm25(docs, query):
    """Single-field BM25 by a plain loop."""
    toks = {d: t.lower().split() for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    out = {}
    for d, words in toks.items():
        score = 0.0
        for term in query.lower().split():
            tf = words.count(term)
            if tf:
                df = sum(term in w for w in toks.values())
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
        if score:
            out[d] = round(score, 6)
    return out


MATCH = Strategy("m", {"body": 1.0}, kinds={"body": "text"})


@pytest.mark.parametrize("bound", [None, 0])
def test_bm25_equals_plain_loop(spark, monkeypatch, bound):
    """Also on the path that shuffles instead of broadcasting."""
    if bound is not None:
        monkeypatch.setattr(scale, "BROADCAST_BYTES", bound)
    rng = random.Random(5)
    docs = {f"d{i}": " ".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for i in range(30)}
    queries = ["a b", "c c d", "h", "zz"]
    df = spark.createDataFrame(list(docs.items()), "product_id string, body string")
    got = lexical.rank(df, asked(spark, *queries), [MATCH], 30).collect()
    for i, q in enumerate(queries):
        assert {r["product_id"]: r["score"] for r in got if r["qid"] == str(i)} == pytest.approx(plain_bm25(docs, q))


def test_ties_go_to_the_smaller_id_and_size_cuts(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "x y")], "product_id string, body string")
    got = lexical.rank(df, asked(spark, "x"), [MATCH], 2).orderBy("rank").collect()
    assert [r["product_id"] for r in got] == ["a", "b"]


def found(ranking, qid="0"):
    return [r["product_id"] for r in ranking.where(F.col("qid") == qid).orderBy("rank").collect()]


def test_and_needs_all_terms_in_one_field(spark, catalog):
    got = st.search_all(catalog, asked(spark, "red coffee", "red grinder", "Acme", "creme"), ["baseline_bm25"])
    assert found(got) == ["p1"]
    assert found(got, "1") == []
    assert set(found(got, "2")) == {"p1", "p3"}
    # A keyword field compares the folded query as a whole.
    assert found(got, "3") == ["p4"]


def test_minimum_share_of_terms(spark, catalog):
    one = Strategy("s75", {"catalog_text": 1.0}, match_percent=75)
    two = Strategy("s70", {"catalog_text": 1.0}, match_percent=70)
    # Four terms: 75% wants three, 70% wants two.
    got = lexical.rank(catalog, asked(spark, "coffee machine with grinder"), [one, two], 10)
    assert found(got.where("strategy = 's75'")) == []
    assert set(found(got.where("strategy = 's70'"))) == {"p2", "p4"}


def test_fuzzy_match_and_long_queries(spark, catalog):
    got = st.search_all(catalog, asked(spark, "cofee grindr"), ["enriched_profile"])
    assert found(got)[0] == "p2"
    # More than 63 terms take the path that counts clauses one by one.
    long = " ".join(f"w{i}xyzq" for i in range(70)) + " coffee grinder"
    loose = Strategy("any", {"title": 1.0}, fuzzy=True)
    assert "p2" in found(lexical.rank(catalog, asked(spark, long), [loose], 10))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_expansion_equals_all_pairs(spark):
    rng = random.Random(11)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(300)})
    asked_words = words[::7] + ["abcabcabc", "bb", "cab"]
    vocabulary = spark.createDataFrame([("f", w, 1) for w in words], "field string, term string, df long")
    wanted = spark.createDataFrame([("f", w) for w in set(asked_words)], "field string, clause string")
    got = {(r["clause"], r["term"], r["distance"]) for r in fuzzy.expand(wanted, vocabulary).collect()}
    limit = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    expected = {(q, w, levenshtein(q, w)) for q in set(asked_words) for w in words if levenshtein(q, w) <= limit(q)}
    assert got == expected


def test_boosts(spark):
    df = spark.createDataFrame([("2026-04-26",), ("2026-03-25",), (None,)], "d string")
    fresh = df.select(F.round(lexical.freshness_boost(F.col("d").cast("timestamp"), as_of(), 0.2), 6).alias("x"))
    assert [r["x"] for r in fresh.collect()] == [0.2, 0.1, 0.2]
    pop = spark.createDataFrame([(100.0,), (None,)], "p double").select(lexical.popularity_boost(F.col("p"), 0.01))
    assert [r[0] for r in pop.collect()] == [1.0, 0.0]


def test_boosted_adds_to_the_text_score(spark, catalog):
    got = st.search_all(catalog, asked(spark, "coffee"), ["baseline_lexical", "boosted_lexical"], as_of=as_of())
    scores = {(r["strategy"], r["product_id"]): r["score"] for r in got.collect()}
    assert scores["boosted_lexical", "p1"] - scores["baseline_lexical", "p1"] == pytest.approx(math.sqrt(2) + 0.2, abs=1e-5)


def test_filters_and_match_all(spark, catalog):
    requests = spark.createDataFrame([
        ("0", "coffee", "KITCHEN", None, None, None, 40.0),
        ("1", " ", None, "ACME", "in_stock", None, None),
        ("2", "", None, None, None, 40.0, 60.0),
        ("3", "", None, None, None, None, None),
    ], "qid string, query string, f_category string, f_brand string, f_availability string, f_min_price double, f_max_price double")
    got = st.product_search(catalog, requests, boost=False)
    assert set(found(got)) == {"p1", "p2"}
    assert found(got, "1") == ["p1"]
    assert found(got, "2") == ["p2", "p3"]
    assert [r["score"] for r in got.where("qid = '3'").collect()] == [1.0] * 4


def test_explain_adds_up(spark, catalog):
    got = lexical.explain(catalog, asked(spark, "red coffee"), [st.strategy("baseline_bm25")], 5).collect()
    assert {r["field"] for r in got if r["wins"]} == {"title"}
    top = lexical.rank(catalog, asked(spark, "red coffee"), [st.strategy("baseline_bm25")], 5).head()
    assert sum(r["contribution"] for r in got if r["wins"]) == pytest.approx(top["score"], abs=1e-6)


def test_facet(catalog):
    assert [tuple(r) for r in lexical.facet(catalog, "category").collect()] == [("kitchen", 3), ("sports", 1)]
    with pytest.raises(ValueError):
        lexical.facet(catalog, "title")


def test_search_products_counts_and_defaults(spark, catalog):
    got = st.search_products(catalog, asked(spark, "coffee"), "baseline_bm25", size=2).collect()
    assert {(r["total"], r["count"]) for r in got} == {(3, 2)}
    assert got[0]["attributes"] == {} and got[0]["currency"] == "" and got[0]["productId"]


def test_unknown_strategy_and_empty_boosts():
    with pytest.raises(ValueError, match="no strategy is called"):
        st.strategy("nope")
    with pytest.raises(ValueError):
        st.tunable("baseline_bm25", {})


def test_corpus_is_shuffled_once(spark, catalog):
    """One exchange of the corpus by id, one of the cut-down rows by query."""
    plan = lexical.rank(catalog, asked(spark, "coffee"), [st.strategy("baseline_bm25")], 10)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("REPARTITION_BY_NUM") == 1
    assert physical.count("WindowGroupLimit") >= 2
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical


def test_requests_with_their_own_strategy_and_size(spark, catalog):
    asked = spark.createDataFrame([
        ("a", "coffee", "baseline_bm25", 1, None), ("b", "red cofee", "boosted_bm25", 2, None), ("c", "coffee", None, None, None), ("d", "", "boosted_lexical", 3, None),
        ("e", "nothing like it", "baseline_bm25", 5, None)], "qid string, query string, strategy string, size int, f_brand string")
    at = F.lit("2026-02-01").cast("timestamp")
    got = {}
    for r in st.search_requests(catalog, asked, at).orderBy("rank").collect():
        got.setdefault((r.qid, r.strategy, r.total), []).append((r.productId, r.score))
    for qid, text, name, size in (("a", "coffee", "baseline_bm25", 1), ("b", "red cofee", "boosted_bm25", 2), ("c", "coffee", "enriched_profile", 10), ("d", "", "boosted_lexical", 3)):
        one = spark.createDataFrame([(qid, text)], "qid string, query string")
        every = lexical.rank(catalog, one, [st.strategy(name)], 1000, at).orderBy("rank").collect()
        assert got[qid, name, len(every)] == [(r.product_id, r.score) for r in every[:size]] and every
    assert {k[0] for k in got} == set("abcd")
    with pytest.raises(Exception, match="not allowed"):
        st.search_requests(catalog, asked.where("qid = 'a'").withColumn("size", F.lit(51)), at)


def test_hits_and_totals_hand_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lexical, "HELD_ROWS", 3)
    rows = spark.range(500).select(F.lit("s").alias("strategy"), (F.col("id") % 7).alias("qid"), F.col("id").cast("string").alias("product_id"), (F.col("id") % 50).cast("double").alias("score"))
    monkeypatch.setattr(lexical, "HELD_ROWS", 3)
    hits, totals = lexical.hits_and_totals(rows.repartition(3), 4)
    want = lexical.top_k(rows, 4).orderBy("qid", "rank").collect()
    assert [tuple(r) for r in hits.df.orderBy("qid", "rank").collect()] == [tuple(r) for r in want]
    assert {r.qid: r.total for r in totals.df.collect()} == {q: len(range(q, 500, 7)) for q in range(7)}
