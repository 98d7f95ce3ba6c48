"""One round of the tuning loop over an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import scale
from shelfmark.operators import metrics, tune
from shelfmark.plans.strategies import tunable
from shelfmark.sources.experiments import ExperimentStore, TableExperimentStore


def tune_round(
    store: ExperimentStore | TableExperimentStore, catalog: DataFrame, queries: DataFrame, judgments: DataFrame, name: str, timestamp: Column,
    min_precision_at_5: float = 0.0, min_mrr_at_10: float = 0.0, size: int = 10, judged_by: str = "query", first_only: bool = True,
) -> DataFrame:
    """Best of the log -> propose what was not tried -> measure -> decide -> record; returns the decisions.

    Without a passing record the strategy's own boosts are measured first and recorded as the baseline.
    Every measured candidate is recorded, the rejected too, so the next round proposes others.  With
    ``first_only`` a round takes the first candidate, otherwise all of them in one job.  No candidate left
    gives no row.
    """
    base = tunable(name)
    spark = catalog.sparkSession
    best = scale.settle(store.best()).df
    rules = (min_precision_at_5, min_mrr_at_10)

    def measured(configs: DataFrame) -> DataFrame:
        found = tune.evaluate_configs(catalog, queries, judgments, name, configs.select("key", "boosts"), size, judged_by)
        return scale.settle(configs.join(found, "key")).df

    if best.isEmpty():
        pairs = [x for field, boost in base.boosts.items() for x in (F.lit(field), F.lit(float(boost)))]
        own = spark.range(1).select(F.lit(name).alias("strategy"), F.create_map(*pairs).alias("boosts"))
        own = measured(own.withColumn("key", tune.config_key(F.col("strategy"), F.col("boosts"))))
        passed = (F.col("precision_at_5") >= min_precision_at_5) & (F.col("mrr_at_10") >= min_mrr_at_10)
        record = own.withColumns({"gate_passed": passed, "kept": F.lit(False), "reason": F.lit("baseline")})
        store.append(tune.experiment_records(record, name, timestamp).withColumn("extra", F.create_map().cast("map<string,string>")))
        reference, start = own.select(*metrics.REPORT_METRICS), own.select("strategy", "boosts")
    else:
        reference = best.select(*(F.col("metrics")[m].alias(m) for m in metrics.REPORT_METRICS))
        start = best.select("config.strategy", F.col("config.field_boosts").alias("boosts"))
    tried = store.all().select("config.strategy", F.col("config.field_boosts").alias("boosts"))
    candidates = scale.settle(tune.propose(start, tried)).df
    if first_only:
        candidates = candidates.orderBy("candidate_no").limit(1)
    decided = scale.settle(tune.decide(measured(candidates), reference, *rules)).df
    store.append(tune.experiment_records(decided, name, timestamp))
    return decided
