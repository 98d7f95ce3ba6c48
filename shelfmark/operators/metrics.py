"""Graded relevance metrics over ranking and judgment tables.

Rankings are (strategy, query, product_id, rank), judgments are (query,
product_id, grade).  Rows are driven by the judged queries, so a query without
results still counts.  Everything is a partially aggregated ``groupBy``; the
ideal gain needs only the best k grades of a query, which each task cuts down
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metrics are rounded so that equal rankings tie whatever the order of summing.
DIGITS = 12


def gain(grade: Column, rank: Column) -> Column:
    """Exponential gain discounted by the logarithm of the rank (M4)."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def _at(k: int, rank: Column, value: Column) -> Column:
    return F.sum(F.when(rank <= k, value).otherwise(F.lit(0)))


def ideal_gains(judgments: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per query: number of relevant products and the best possible gain at each k."""
    relevant = judgments.groupBy("query").agg(F.sum((F.col("grade") > 0).cast("bigint")).alias("relevant"))
    best = judgments.withColumn(
        "place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade")))
    ).where(F.col("place") <= max(ks))
    ideal = best.groupBy("query").agg(*(
        _at(k, F.col("place"), gain(F.col("grade"), F.col("place"))).alias(f"ideal_{k}") for k in ks))
    return relevant.join(ideal, "query")


def query_metrics(
    rankings: DataFrame, judgments: DataFrame, strategies: Sequence[str] | Column, ks: Sequence[int] = (5, 10),
    precision_denominator: str = "returned",
) -> DataFrame:
    """precision/recall/mrr/ndcg ``_at_k`` columns, uncut ``mrr`` and the ids (M1-M5).

    ``strategies`` are names, or an array column holding them.
    ``precision_denominator`` "returned" divides by min(k, rows returned), "k" by k.
    """
    if min(ks) <= 0:
        raise ValueError("k must be positive")
    if precision_denominator not in ("returned", "k"):
        raise ValueError("precision_denominator must be 'returned' or 'k'")
    rank, grade = F.col("rank"), F.coalesce(F.col("grade"), F.lit(0))
    graded = rankings.select("strategy", "query", "product_id", "rank").join(
        judgments.select("query", "product_id", "grade"), ["query", "product_id"], "left")
    hit = (grade > 0).cast("int")
    found = graded.groupBy("strategy", "query").agg(
        F.count(F.lit(1)).alias("returned"),
        F.min(F.when(grade > 0, rank)).alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id"))),
                    lambda x: x["product_id"]).alias("ranked_product_ids"),
        *(_at(k, rank, hit).alias(f"hits_{k}") for k in ks),
        *(_at(k, rank, gain(grade, rank)).alias(f"dcg_{k}") for k in ks),
    )
    names = F.explode(strategies if isinstance(strategies, Column) else F.array(*map(F.lit, strategies)))
    rows = ideal_gains(judgments, ks).withColumn("strategy", names).join(found, ["strategy", "query"], "left")

    def safe(top: Column, bottom: Column) -> Column:
        return F.round(F.coalesce(F.when(bottom > 0, top / bottom), F.lit(0.0)), DIGITS)

    out = ["strategy", "query"]
    for k in ks:
        divisor = F.least(F.lit(k), F.col("returned")) if precision_denominator == "returned" else F.lit(k)
        out += [
            safe(F.col(f"hits_{k}"), divisor).alias(f"precision_at_{k}"),
            safe(F.col(f"hits_{k}"), F.col("relevant")).alias(f"recall_at_{k}"),
            F.round(F.coalesce(F.when(F.col("first") <= k, 1 / F.col("first")), F.lit(0.0)), DIGITS)
            .alias(f"mrr_at_{k}"),
            safe(F.col(f"dcg_{k}"), F.col(f"ideal_{k}")).alias(f"ndcg_at_{k}"),
        ]
    out.append(F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), DIGITS).alias("mrr"))
    out.append(F.coalesce("ranked_product_ids", F.array().cast("array<string>")).alias("ranked_product_ids"))
    return rows.select(*out)


REPORT_METRICS = ("precision_at_5", "recall_at_5", "mrr_at_10", "ndcg_at_10")


def evaluation_rows(rankings: DataFrame, judgments: DataFrame, strategies: Sequence[str] | Column) -> DataFrame:
    """One row per strategy and judged query (M7)."""
    return query_metrics(rankings, judgments, strategies, (5, 10)).select(
        "strategy", "query", F.lit("ok").alias("status"), *REPORT_METRICS, "ranked_product_ids",
        F.lit("").alias("note"))


def summary(rows: DataFrame, baseline: str, metrics: Sequence[str] = REPORT_METRICS) -> DataFrame:
    """Means over the evaluated queries and their distance to the baseline (M8)."""
    ok = F.col("status") == "ok"
    means = rows.groupBy("strategy").agg(
        F.sum(ok.cast("bigint")).alias("evaluated_queries"),
        F.sum((~ok).cast("bigint")).alias("pending_queries"),
        *(F.round(F.coalesce(F.avg(F.when(ok, F.col(m))), F.lit(0.0)), DIGITS).alias(m) for m in metrics),
    ).withColumn("status", F.when(F.col("evaluated_queries") > 0, "ok").otherwise("pending"))
    base = F.struct(*metrics)
    # One row per strategy: the baseline's row is found by a global maximum.
    everyone = Window.partitionBy(F.lit(0))
    reference = F.max(F.when(F.col("strategy") == baseline, base)).over(everyone)
    return means.withColumn("_base", reference).select(
        "strategy", "status", "evaluated_queries", "pending_queries", *metrics,
        *(F.round(F.col(m) - F.coalesce(F.col("_base")[m], F.lit(0.0)), DIGITS).alias(f"delta_{m}") for m in metrics),
    )


def winners(rows: DataFrame) -> DataFrame:
    """Evaluation rows with the query's winning strategies.

    The best (nDCG, MRR, recall, precision) wins; ties share, all-zero wins nothing.
    """
    key = F.struct("ndcg_at_10", "mrr_at_10", "recall_at_5", "precision_at_5")
    ok = F.col("status") == "ok"
    per_query = Window.partitionBy("query")
    best = F.max(F.when(ok, key)).over(per_query)
    zero = (F.col("_best.ndcg_at_10") + F.col("_best.mrr_at_10")
            + F.col("_best.recall_at_5") + F.col("_best.precision_at_5")) == 0
    wins = F.coalesce(ok & (key == F.col("_best")) & ~zero, F.lit(False))
    marked = rows.withColumn("_best", best).withColumn("_wins", wins)
    # A query has one row per strategy, so this list is short.
    names = F.array_sort(F.collect_list(F.when(F.col("_wins"), F.col("strategy"))).over(per_query))
    return marked.withColumn("winners", names).withColumn(
        "winner",
        F.when(F.col("_wins") & (F.size("winners") > 1), "tie").when(F.col("_wins"), "yes").otherwise(""),
    ).withColumn(
        "top_results",
        F.coalesce(F.nullif(F.array_join(F.slice("ranked_product_ids", 1, 5), ", "), F.lit("")), F.lit("none")),
    ).drop("_best", "_wins")


def metrics_at(
    rankings: DataFrame, judgments: DataFrame, strategies: Sequence[str], ks: Sequence[int] = (1, 3, 5, 10),
    precision_denominator: str = "k",
) -> DataFrame:
    """Mean metrics in long form: (strategy, metric, k, value) (M6)."""
    per_query = query_metrics(rankings, judgments, strategies, ks, precision_denominator)
    names = [(m, k) for k in ks for m in ("precision", "recall", "mrr", "ndcg")]
    means = per_query.groupBy("strategy").agg(*(
        F.round(F.avg(f"{m}_at_{k}"), DIGITS).alias(f"{m}_{k}") for m, k in names))
    cells = F.array(*(
        F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(f"{m}_{k}").alias("value")) for m, k in names))
    return means.select("strategy", F.inline(cells))


def compare(rankings: DataFrame, judgments: DataFrame, strategies: Sequence[str], k: int = 10,
            latency: DataFrame | None = None) -> DataFrame:
    """Mean precision, uncut MRR and nDCG per strategy.

    ``latency`` (strategy, latency_ms) adds the mean time of each strategy.
    """
    means = query_metrics(rankings, judgments, strategies, (k,)).groupBy("strategy").agg(
        F.round(F.avg(f"precision_at_{k}"), DIGITS).alias(f"precision_at_{k}"),
        F.round(F.avg("mrr"), DIGITS).alias("mrr"),
        F.round(F.avg(f"ndcg_at_{k}"), DIGITS).alias(f"ndcg_at_{k}"),
    )
    if latency is None:
        return means
    times = latency.groupBy("strategy").agg(F.avg("latency_ms").alias("mean_latency_ms"))
    return means.join(times, "strategy", "left").fillna(0.0, ["mean_latency_ms"])


def ideal_ranking(judgments: DataFrame, size: int) -> DataFrame:
    """Best ``size`` judged products of a query, by grade then id."""
    order = Window.partitionBy("query").orderBy(F.desc("grade"), F.asc("product_id"))
    return judgments.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select(
        "query", "product_id", "rank", "grade")


def first_queries(judgments: DataFrame, n: int) -> DataFrame:
    """Judgments of the first ``n`` queries in text order."""
    chosen = judgments.select("query").distinct().orderBy("query").limit(n)
    return judgments.join(chosen, "query", "left_semi")
