"""Candidate search over a stored vector index: recall, exactness with all candidates, hot folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import vector_index as vi
from shelfmark.operators import vectors


def made(spark, count=3000, dims=16, copies=0):
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((30, dims))
    rows = centres[draw.integers(0, 30, count)] + 0.6 * draw.standard_normal((count, dims))
    rows = np.concatenate([rows, np.repeat(rows[:1], copies, axis=0)])
    return spark.createDataFrame([(f"p{i:05}", v.tolist()) for i, v in enumerate(rows)], "product_id string, embedding array<double>")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    docs = made(spark).unionByName(spark.createDataFrame([("none", None)], "product_id string, embedding array<double>"))
    return docs, vi.write_vector_index(docs, str(tmp_path_factory.mktemp("vectors")), lists=40)


def asked(docs):
    return docs.where("product_id LIKE '%00'").select(F.col("product_id").alias("qid"), "embedding")


def lists(rows):
    return {(r.qid, r["rank"]): (r.product_id, round(r.score, 6)) for r in rows.collect()}


def test_recall_and_candidates(spark, corpus):
    docs, index = corpus
    assert index.rows.count() == 3000 and index.sizes.sum() == 3000
    want = vectors.knn(docs, asked(docs), 10)
    exact = {(r.qid, r.product_id) for r in want.collect()}
    recall = {}
    for n in (10, 300, 1200):
        got = {(r.qid, r.product_id) for r in vi.search(index, asked(docs), 10, n).collect()}
        recall[n] = len(got & exact) / len(exact)
    assert recall[300] >= 0.9 and recall[10] <= recall[300] <= recall[1200]
    matrix = vectors._unit_rows([r.embedding for r in asked(docs).collect()])
    wanted = vi.opened(index, matrix, 300)
    scored = (wanted * index.sizes).sum(axis=1)
    assert (scored >= 300).all() and scored.mean() < 1000


def test_all_candidates_are_the_exact_search(spark, corpus):
    docs, index = corpus
    want = lists(vectors.knn(docs, asked(docs), 7))
    assert lists(vi.search(index, asked(docs), 7, 10**9)) == want
    assert lists(vi.search(index, asked(docs), 7, 10**9, block_bytes=1000)) == want  # in several blocks of queries


def test_only_opened_folders_are_read(spark, corpus):
    docs, index = corpus
    plan = vi.search(index, asked(docs).limit(1), 3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1][:60]


def test_copies_and_empty(spark, tmp_path):
    docs = made(spark, 200, 4, copies=400)
    index = vi.write_vector_index(docs, str(tmp_path / "a"))
    assert index.rows.count() == 600
    got = vi.search(index, asked(docs).limit(1), 5, 50).orderBy("rank").collect()
    assert [r.product_id for r in got] == ["p00000", "p00200", "p00201", "p00202", "p00203"]
    none = vi.write_vector_index(docs.where("false"), str(tmp_path / "b"))
    assert vi.search(none, asked(docs), 5).collect() == [] and vi.search(index, asked(docs).where("false"), 5).collect() == []


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_calibrated_recall(spark, tmp_path, spread):
    """Clear clusters need few candidates, near noise needs many; either way the recall asked for is reached."""
    draw = np.random.default_rng(9)
    rows = draw.standard_normal((20, 12))[draw.integers(0, 20, 1500)] + spread * draw.standard_normal((1500, 12))
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "product_id bigint, embedding array<double>")
    index = vi.write_vector_index(docs, str(tmp_path))
    candidates = vi.calibrate(index, 10, 0.95, 150)
    asked_ = docs.where("product_id % 10 = 0").select(F.col("product_id").alias("qid"), "embedding")
    exact = {(r.qid, r.product_id) for r in vectors.knn(docs, asked_, 10).collect()}
    found = {(r.qid, r.product_id) for r in vi.search(index, asked_, 10, candidates).collect()}
    assert len(found & exact) >= 0.9 * len(exact) and candidates < len(rows)


def test_registered_recall(spark):
    from registry import all_queries

    folder = "/root/testdata/sf0.01"
    found = {(r.qid, r.product_id) for r in all_queries()["knn_candidates"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    exact = vectors.knn(rows.select(F.col("vec_id").alias("product_id"), "embedding"), rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 10)
    exact = {(r.qid, r.product_id) for r in exact.collect()}
    assert len(found & exact) >= 0.9 * len(exact)
