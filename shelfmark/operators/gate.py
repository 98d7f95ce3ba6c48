"""Quality gates over report tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality_gate(relevance: DataFrame, latency: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Three checks per gated strategy, with the failure message (G1).

    ``thresholds`` has ``strategy`` and any of ``min_precision_at_5``,
    ``min_mrr_at_10`` and ``max_p95_ms``; missing bounds are 0, 0 and infinity.
    A strategy missing from a report is an error (G2).
    """
    for name in ("min_precision_at_5", "min_mrr_at_10", "max_p95_ms"):
        if name not in thresholds.columns:
            thresholds = thresholds.withColumn(name, F.lit(None).cast("double"))
    joined = (
        thresholds
        .join(relevance.select("strategy", "precision_at_5", "mrr_at_10", F.lit(True).alias("_r")), "strategy", "left")
        .join(latency.select("strategy", "p95", F.lit(True).alias("_l")), "strategy", "left")
    )
    missing = F.concat(F.lit("Strategy '"), F.col("strategy"), F.lit("' was not found in report summary"))
    present = F.when(F.col("_r").isNull() | F.col("_l").isNull(), F.raise_error(missing).cast("int")).otherwise(0)

    def check(number: int, metric: str, value: str, bound, label: str, at_least: bool, form: str):
        actual = F.coalesce(F.col(value), F.lit(0.0))
        passed = actual >= bound if at_least else actual <= bound
        sign = "<" if at_least else ">"
        message = F.format_string(f"{label} failed for %s: {form} {sign} {form}", "strategy", actual, bound)
        return F.struct(
            (F.lit(number) + present).alias("check_no"), F.lit(metric).alias("metric"), actual.alias("value"),
            bound.alias("bound"), passed.alias("passed"), F.when(~passed, message).alias("failure"))

    low = F.coalesce(F.col("min_precision_at_5"), F.lit(0.0))
    mrr = F.coalesce(F.col("min_mrr_at_10"), F.lit(0.0))
    high = F.coalesce(F.col("max_p95_ms"), F.lit(float("inf")))
    return joined.select("strategy", F.inline(F.array(
        check(1, "precision_at_5", "precision_at_5", low, "Precision@5", True, "%.3f"),
        check(2, "mrr_at_10", "mrr_at_10", mrr, "MRR@10", True, "%.3f"),
        check(3, "p95_ms", "p95", high, "p95 latency", False, "%.2fms"),
    )))


def gate_verdict(checks: DataFrame) -> DataFrame:
    """One row per strategy: passed, and the failures in check order."""
    failures = F.transform(
        F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("check_no", "failure")))),
        lambda x: x["failure"])
    return checks.groupBy("strategy").agg(F.every("passed").alias("passed"), failures.alias("failures"))


def threshold_table(relevance_at_k: DataFrame, thresholds: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """The thresholds mapping as rows; ``default`` applies to strategies without their own."""
    spark = relevance_at_k.sparkSession
    rows = [(s, *key.split("@"), float(bound)) for s, checks in thresholds.items() for key, bound in checks.items()]
    table = spark.createDataFrame(
        [(s, m, int(k), b) for s, m, k, b in rows], "strategy string, metric string, k int, bound double")
    own = [s for s in thresholds if s != "default"]
    others = relevance_at_k.select("strategy").distinct().where(~F.col("strategy").isin(own) if own else F.lit(True))
    default = table.where("strategy = 'default'").drop("strategy").withColumn("_one", F.lit(1))
    return table.where("strategy <> 'default'").unionByName(
        others.withColumn("_one", F.lit(1)).join(F.broadcast(default), "_one").drop("_one"))


def threshold_checks(relevance_at_k: DataFrame, thresholds: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``"metric@k"`` lower bounds against the long metric table."""
    wanted = threshold_table(relevance_at_k, thresholds)
    joined = wanted.join(relevance_at_k, ["strategy", "metric", "k"], "left")
    value = F.coalesce(F.col("value"), F.lit(0.0))
    return joined.select("strategy", "metric", "k", value.alias("value"), "bound", (value >= F.col("bound")).alias("passed"))
