"""Evaluation jobs: search, judge, compare and gate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import scale
from shelfmark.operators import latency, metrics, rerank
from shelfmark.operators.metrics import DIGITS

# queries (qid, query) -> ranking (strategy, qid, product_id, rank).
SearchFn = Callable[[DataFrame], DataFrame]


def named(ranking: DataFrame, queries: DataFrame) -> DataFrame:
    """Ranking rows with the query text in place of the query id."""
    return ranking.join(queries.select("qid", "query"), "qid").drop("qid")


def report(rankings: DataFrame, judgments: DataFrame, strategies: Sequence[str], baseline: str) -> tuple[DataFrame, DataFrame]:
    """Summary per strategy, and the rows per query with their winners."""
    rows = metrics.evaluation_rows(rankings, judgments, strategies)
    return metrics.summary(rows, baseline), metrics.winners(rows)


def evaluate_search(search: SearchFn, queries: DataFrame, judgments: DataFrame, strategies: Sequence[str], baseline: str):
    return report(named(search(queries), queries), judgments, strategies, baseline)


def rerank_report(
    before: DataFrame, after: DataFrame, judgments: DataFrame, strategies: Sequence[str], k: int = 10,
) -> DataFrame:
    """Metrics before and after reranking per strategy and query."""
    names = (f"ndcg_at_{k}", "mrr", f"precision_at_{k}")

    def side(rankings: DataFrame, prefix: str) -> DataFrame:
        rows = metrics.query_metrics(rankings, judgments, strategies, (k,))
        return rows.select("strategy", "query", *(F.col(n).alias(f"{prefix}_{n}") for n in names))

    both = side(before, "before").join(side(after, "after"), ["strategy", "query"])
    return both.select("strategy", "query", *(
        c for n in names for c in (
            F.col(f"before_{n}"), F.col(f"after_{n}"),
            F.round(F.col(f"after_{n}") - F.col(f"before_{n}"), DIGITS).alias(f"delta_{n}"))))


def rerank_summary(rows: DataFrame, k: int = 10) -> DataFrame:
    """Mean nDCG change, 95th percentile times, and a warning when quality and
    time both rose (R8).  ``rows`` adds first_stage_latency_ms and total_latency_ms."""
    rows = scale.settle(rows.select(
        f"delta_ndcg_at_{k}", "first_stage_latency_ms", "total_latency_ms")).df
    mean = rows.agg(F.round(F.avg(f"delta_ndcg_at_{k}"), DIGITS).alias("mean_delta"))

    def p95(column: str) -> DataFrame:
        return latency.percentiles(rows, [], column, (95,)).select(F.max("value"))

    before, after = p95("first_stage_latency_ms").scalar(), p95("total_latency_ms").scalar()
    timed = mean.withColumns({"p95_before_ms": before, "p95_after_ms": after})
    return timed.withColumn(
        "warning", (F.col("mean_delta") > 0) & (F.col("p95_after_ms") > F.col("p95_before_ms")))


def rerank_ranking(ranking: DataFrame, catalog: DataFrame, queries: DataFrame, window: int, **options) -> DataFrame:
    """Rerank the head of every list of a ranking table."""
    rows = rerank.candidates(ranking, catalog).join(queries.select("qid", "query"), "qid")
    return rerank.rerank_window(rows.withColumn("text", rerank.candidate_text(rows)), window, **options)
