"""Second-stage reranking of candidate lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import scale
from shelfmark.functions.text import jaccard, non_empty, token_set

TEXT_FIELDS = ("title", "brand", "category", "description", "catalog_text")

# (query tokens, document tokens, first-stage score) -> new score.
Reranker = Callable[[Column, Column, Column], Column]


def overlap_reranker(query_tokens: Column, doc_tokens: Column, score: Column) -> Column:
    """Token overlap plus a thousandth of the first-stage score (R2)."""
    return jaccard(query_tokens, doc_tokens) + score * 0.001


def candidate_text(df: DataFrame, fields: Sequence[str] = TEXT_FIELDS) -> Column:
    return F.concat_ws(" ", *(non_empty(F.col(f)) for f in fields if f in df.columns))


def candidates(ranking: DataFrame, catalog: DataFrame, id_col: str = "product_id") -> DataFrame:
    """Ranking rows with their catalog columns; a missing or zero score becomes
    1 / list position, and ids the catalog lacks fall out (S15, R4).

    Only the rows of ranked ids are read into the join.
    """
    settled = scale.settle(ranking)
    rows = scale.join_settled(catalog, settled, [id_col])
    return rows.withColumn("score", F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), 1.0 / F.col("rank")))


def rerank_window(
    rows: DataFrame, window: int, keys: Sequence[str] = ("strategy", "qid"), id_col: str = "product_id",
    query: str = "query", text: str = "text", reranker: Reranker = overlap_reranker,
) -> DataFrame:
    """Reorder the first ``window`` rows of every list, the tail stays."""
    if window < 1:
        raise ValueError("window_size must be positive")
    inside = F.col("rank") <= window
    # Tokens as columns of their own, so that each text is cut once.
    cut = rows.withColumns({
        "_asked": F.when(inside, token_set(F.col(query))), "_held": F.when(inside, token_set(F.col(text)))})
    fresh = reranker(F.col("_asked"), F.col("_held"), F.col("score"))
    scored = cut.withColumn("rerank_score", F.when(inside, fresh).otherwise(F.col("score")))
    order = Window.partitionBy(*keys).orderBy(
        F.asc(F.when(inside, 0).otherwise(1)),
        F.desc(F.when(inside, F.round("rerank_score", 9))), F.asc("rank"))
    return scored.withColumn("new_rank", F.row_number().over(order)).select(
        *keys, id_col, F.col("rank").alias("old_rank"), F.col("new_rank").alias("rank"),
        F.col("rerank_score").alias("score"))


def metric_delta(before: DataFrame, after: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """after - before for the union of metric names, missing counts as 0."""
    on = [*keys, "metric"]
    joined = before.withColumnRenamed("value", "before").join(
        after.withColumnRenamed("value", "after"), on, "full_outer")
    return joined.fillna(0.0, ["before", "after"]).select(
        *on, "before", "after", (F.col("after") - F.col("before")).alias("delta"))
