import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions.text import jaccard, token_set
from shelfmark.operators import rerank, vectors
from shelfmark.plans import evaluate, hybrid


def brute_knn(corpus, queries, k):
    out = {}
    for q, qv in queries.items():
        sims = []
        for c, cv in corpus.items():
            a, b = np.array(qv), np.array(cv)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            sims.append((-round(float(a @ b / n) if n else 0.0, 6), c))
        out[q] = [c for _, c in sorted(sims)[:k]]
    return out


@pytest.mark.parametrize("block", [None, 200])
def test_knn_equals_brute_force(spark, monkeypatch, block):
    """With the query side shared, and cut into blocks when it is too large."""
    if block:
        monkeypatch.setattr(vectors, "CORPUS_BLOCK_BYTES", 500)
    rng = np.random.default_rng(3)
    corpus = {f"c{i:03d}": rng.normal(size=8).tolist() for i in range(60)}
    # Exact copies tie and go by id.
    corpus |= {f"x{i}": corpus["c000"] for i in range(5)}
    queries = {f"q{i}": rng.normal(size=8).tolist() for i in range(9)} | {"q9": corpus["c000"]}
    c = spark.createDataFrame(list(corpus.items()), "product_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame(list(queries.items()), "qid string, embedding array<double>")
    got = vectors.knn(c, q, 7, block_bytes=block).orderBy("qid", "rank").collect()
    for name, expected in brute_knn(corpus, queries, 7).items():
        assert [r["product_id"] for r in got if r["qid"] == name] == expected


def plain_rrf(lists, size, constant=60):
    scores, seen = {}, {}
    for ranking in lists:
        for place, item in enumerate(ranking, 1):
            seen.setdefault(item, len(seen))
            scores[item] = scores.get(item, 0.0) + 1 / (constant + place)
    return sorted(scores, key=lambda x: (-scores[x], seen[x]))[:size]


def ranking(spark, ids, qid="q"):
    return spark.createDataFrame([(qid, x, i + 1) for i, x in enumerate(ids)], "qid string, product_id string, rank int")


def test_rrf_by_hand(spark):
    got = vectors.rrf([ranking(spark, "ABC"), ranking(spark, "BAD")], 3).orderBy("rank").collect()
    assert [r["product_id"] for r in got] == ["A", "B", "C"]


def test_rrf_equals_plain_loop(spark):
    rng = random.Random(2)
    lists = [[rng.sample("ABCDEFGHIJ", rng.randint(1, 10)) for _ in range(3)] for _ in range(6)]
    frames = []
    for n in range(3):
        data = [(str(q), x, i + 1) for q, many in enumerate(lists) for i, x in enumerate(many[n])]
        frames.append(spark.createDataFrame(data, "qid string, product_id string, rank int"))
    got = vectors.rrf(frames, 5).orderBy("qid", "rank").collect()
    for q, many in enumerate(lists):
        assert [r["product_id"] for r in got if r["qid"] == str(q)] == plain_rrf(many, 5)
    cut = vectors.rrf(frames, 5, window=2).orderBy("qid", "rank").collect()
    assert [r["product_id"] for r in cut if r["qid"] == "0"] == plain_rrf([m[:2] for m in lists[0]], 5)


@pytest.fixture
def catalog(spark):
    data = [("p1", "Red Mug", "mugs", 5.0), ("p2", "Blue Mug", "mugs", 4.0), ("p3", "Red Shoes", "shoes", 3.0)]
    df = spark.createDataFrame(data, "product_id string, title string, category string, popularity_score double")
    return df.withColumns({
        "brand": F.lit("acme"), "description": F.lit(""), "catalog_text": F.col("title"),
        "updated_at": F.lit("2026-01-01").cast("timestamp")})


def test_hybrid_finds_what_words_alone_miss(spark, catalog):
    as_of = F.lit("2026-01-02").cast("timestamp")
    queries = spark.createDataFrame([("q", "red mug")], "qid string, query string")
    fly = hybrid.hybrid(catalog, queries, as_of, 3).orderBy("rank").collect()
    assert [r["product_id"] for r in fly][0] == "p1" and len(fly) == 3
    stored = hybrid.embed_catalog(catalog)
    assert vectors.has_embeddings(stored) and not vectors.has_embeddings(catalog)
    kept = hybrid.hybrid(stored, queries, as_of, 3).orderBy("rank").collect()
    assert [r["product_id"] for r in kept] == [r["product_id"] for r in fly]
    # No vectors for the query: the lexical list stands alone.
    none = lambda df, i, t: vectors.hash_embedding(df.where("false"), i, t)
    alone = hybrid.hybrid(stored, queries, as_of, 3, embed=none).collect()
    assert [r["product_id"] for r in alone] == ["p1"]


def test_wrong_vector_length_fails(spark, catalog):
    short = vectors.column_embedder(lambda c: F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="Expected 384 dimensions, got 1"):
        hybrid.catalog_vectors(catalog, short).collect()


def test_jaccard(spark):
    def sim(a, b):
        return spark.range(1).select(jaccard(token_set(F.lit(a)), token_set(F.lit(b)))).head()[0]

    assert sim("wireless mouse", "wireless mouse pad") == pytest.approx(2 / 3)
    assert sim("", "x") == 0.0 and sim("x", "") == 0.0


def test_rerank_window_moves_only_the_head(spark):
    rows = spark.createDataFrame([
        ("s", "q", "a", 1, 9.0, "red mug", "blue shoes"), ("s", "q", "b", 2, 8.0, "red mug", "red mug"),
        ("s", "q", "c", 3, 7.0, "red mug", "red mug"), ("s", "q", "d", 4, 6.0, "red mug", "nothing"),
    ], "strategy string, qid string, product_id string, rank int, score double, query string, text string")
    got = rerank.rerank_window(rows, 2).orderBy("rank").collect()
    assert [r["product_id"] for r in got] == ["b", "a", "c", "d"]
    assert got[0]["score"] == pytest.approx(1.008) and got[2]["score"] == 7.0
    tied = rerank.rerank_window(rows.withColumn("score", F.lit(1.0)).withColumn("text", F.lit("red")), 4).orderBy("rank")
    assert [r["product_id"] for r in tied.collect()] == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        rerank.rerank_window(rows, 0)


def test_candidates_keep_gaps_in_positions(spark, catalog):
    ranked = spark.createDataFrame(
        [("s", "q", "p1", 1, 0.0), ("s", "q", "zz", 2, 1.0), ("s", "q", "p3", 3, None)],
        "strategy string, qid string, product_id string, rank int, score double")
    got = {r["product_id"]: r["score"] for r in rerank.candidates(ranked, catalog).collect()}
    assert got == {"p1": 1.0, "p3": pytest.approx(1 / 3)}


def test_metric_delta(spark):
    before = spark.createDataFrame([("a", 0.25), ("b", 0.5)], "metric string, value double")
    after = spark.createDataFrame([("a", 0.5), ("c", 0.3)], "metric string, value double")
    assert {r["metric"]: r["delta"] for r in rerank.metric_delta(before, after).collect()} == {"a": 0.25, "b": -0.5, "c": 0.3}


def test_rerank_summary_warns(spark):
    rows = spark.createDataFrame([(0.1, 10.0, 11.0), (0.0, 20.0, 22.0)],
                                 "delta_ndcg_at_10 double, first_stage_latency_ms double, total_latency_ms double")
    got = evaluate.rerank_summary(rows).head()
    assert got["mean_delta"] == 0.05 and got["warning"]
    assert got["p95_before_ms"] == pytest.approx(19.5) and got["p95_after_ms"] == pytest.approx(21.45)
