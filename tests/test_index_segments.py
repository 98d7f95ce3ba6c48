"""The stored index counts and scores whole texts in segments; its rows are those of a scan."""

import random

import pytest
from pyspark.sql import functions as F
from test_inverted import same

from shelfmark import scale
from shelfmark.operators import inverted, lexical, segments
from shelfmark.operators.lexical import Strategy

KINDS = {"title": "text", "brand": "keyword"}
CHOSEN = [Strategy("or", {"title": 2.0, "brand": 1.0}, kinds=KINDS), Strategy("half", {"title": 1.0}, match_percent=50, kinds=KINDS)]


def rows(spark, shared):
    """120 documents; ``shared`` gives some of them the id of another."""
    random.seed(5)
    words = [f"w{i}" for i in range(40)]
    data = [(f"p{i % 100 if shared else i:03}", " ".join(random.choices(words, range(40, 0, -1), k=random.randint(1, 30))) if i % 17 else None, f"Brand {i % 4}") for i in range(120)]
    return spark.createDataFrame([*data, ("p900", "w0 " * 400, None), ("p901", "", "")], "product_id string, title string, brand string")


def queries(spark):
    texts = [f"w{i} w{39 - i} w{i * 7 % 40} w0" for i in range(20)] + ["brand 2", "w39", "nothing", "w1 w2 w3 w4 w5 w38 w37"]
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, query string")


@pytest.fixture
def small(monkeypatch):
    for name, value in (("TERMS", 150), ("ROWS", 20), ("CELLS", 60), ("MET", 25)):
        monkeypatch.setattr(segments, name, value)


@pytest.mark.parametrize("shared", [False, True])
def test_rows_equal_a_scan(spark, small, tmp_path, shared):
    docs = rows(spark, shared)
    index = inverted.write_index(docs, str(tmp_path), KINDS, buckets=4)
    held = index.blocks.select("segment", F.explode("texts").alias("text")).distinct()
    assert held.select("segment").distinct().count() > 5
    assert held.groupBy("text").count().where("count > 1").isEmpty()
    assert 0 < index.blocks.count() < index.postings.count()
    wanted = {tuple(r) for r in lexical.postings(docs, KINDS, carry=["brand"]).groupBy("product_id", "dl", "term").agg(F.sum("tf")).collect()}
    assert {(r._text, r.dl, r.tf) for r in index.postings.collect()} == {(a, b, d) for a, b, _, d in wanted}
    if not shared:
        same(inverted.search(index, queries(spark), CHOSEN, 4), lexical.rank(docs, queries(spark), CHOSEN, 4))
        return
    # Texts that share an id count as one, as they do where postings are exchanged.
    asked = inverted.ask(index, inverted.prepare(index, queries(spark), CHOSEN), CHOSEN, None)
    ways = (inverted.segment_scores(index, asked, asked.prepared.scoring, 4),
            inverted.text_scores(inverted.matches_by_text(index, asked, asked.prepared.scoring), asked, CHOSEN))
    found, known = (sorted((r.strategy, r.qid, r._text, round(r.text_score, 5)) for r in lexical.top_texts(w, 4).collect()) for w in ways)
    assert found == known and found


def test_terms_are_counted_where_they_are_read(spark):
    """No row per term is exchanged, neither when the corpus is counted nor when it is searched."""
    docs = rows(spark, False).withColumnRenamed("product_id", "_text").withColumn("text_copies", F.lit(1).cast("bigint"))
    counted = inverted._counted(docs, KINDS, True)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in counted and "Exchange hashpartitioning" not in counted


def test_blocks_not_postings_are_exchanged(spark, tmp_path):
    scale.ensure_checkpoint_dir(spark)
    index = inverted.write_index(rows(spark, False), str(tmp_path), KINDS, buckets=4)
    asked = inverted.ask(index, inverted.prepare(index, queries(spark), CHOSEN), CHOSEN, None)
    scores = inverted.segment_scores(index, asked, asked.prepared.scoring, 4)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(segment" in line]
    assert len(shuffles) == 1 and "Exchange hashpartitioning(_text" not in plan
    # Of each list and segment only the best texts and their equals are handed on.
    whole = inverted.text_scores(inverted.matches_by_text(index, asked, asked.prepared.scoring), asked, CHOSEN)
    assert scores.count() < whole.count()
