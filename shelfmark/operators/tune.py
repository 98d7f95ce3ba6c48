"""Tuning field boosts: all candidates are measured in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import scale
from shelfmark.operators import lexical, metrics
from shelfmark.plans.strategies import tunable

# Factors tried on one boost at a time, and the allowed range.
STEPS = (1.5, 0.5)
LOWEST, HIGHEST = 0.1, 10.0
HEADLINE = "precision_at_5"


def config_key(strategy: Column, boosts: Column) -> Column:
    """Identity of a configuration: strategy and its rounded boosts by field."""
    cells = F.transform(
        F.array_sort(F.map_entries(boosts)),
        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))
    return F.concat_ws("|", strategy, F.array_join(cells, "|"))


def propose(base: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """Candidates around each base (strategy, boosts): every boost up, then down."""
    fields = base.select("strategy", "boosts", F.posexplode(F.array_sort(F.map_keys("boosts"))).alias("f", "field"))
    steps = F.array(*(F.struct(F.lit(i).alias("s"), F.lit(x).alias("factor")) for i, x in enumerate(STEPS)))
    moved = fields.select("*", F.inline(steps)).withColumn(
        "value", F.round(F.greatest(F.lit(LOWEST), F.least(
            F.lit(HIGHEST), F.try_element_at("boosts", F.col("field")) * F.col("factor"))), 4))
    shifted = F.transform_values("boosts", lambda k, v: F.when(k == F.col("field"), F.col("value")).otherwise(v))
    listed = moved.select(
        "strategy", (F.col("f") * len(STEPS) + F.col("s")).alias("candidate_no"), "field", "value",
        shifted.alias("boosts")).withColumn("key", config_key(F.col("strategy"), F.col("boosts")))
    seen = base.select(config_key(F.col("strategy"), F.col("boosts")).alias("key"))
    if tried is not None:
        seen = seen.unionByName(tried.select(config_key(F.col("strategy"), F.col("boosts")).alias("key")))
    first = listed.withColumn(
        "_n", F.row_number().over(Window.partitionBy("key").orderBy("candidate_no"))).where("_n = 1").drop("_n")
    return first.join(seen, "key", "left_anti")


def evaluate_configs(
    catalog: DataFrame, queries: DataFrame, judgments: DataFrame, strategy: str, configs: DataFrame, size: int = 10,
    judged_by: str = "query",
) -> DataFrame:
    """Mean metrics of every configuration.

    Field scores do not depend on the boosts: the corpus is scored once with
    boosts of 1 and the configurations only weigh the fields afterwards.
    ``queries`` is (qid, query), ``configs`` is (key, boosts).  ``judged_by``
    names the column of ``queries`` that the judgments' ``query`` refers to.
    """
    base = tunable(strategy)
    plain = [base.with_boosts({f: 1.0 for f in base.boosts})]
    texts = lexical.distinct_texts(catalog, plain)
    docs, id_col = (catalog, "product_id") if texts is None else (texts.docs, lexical.TEXT)
    prepared = lexical.prepare(docs, queries, plain)
    fields = lexical.field_scores(lexical.contributions(docs, prepared, base.kinds_used, id_col), prepared, id_col)
    weights = scale.settle(configs.select("key", F.explode("boosts").alias("field", "boost")))
    scored = (
        scale.join_settled(fields, weights, ["field"], salt_by=id_col)
        .groupBy("key", "qid", id_col)
        .agg(F.round(F.max(F.col("field_score") * F.col("boost")), 6).alias("score"))
    )
    ranked = lexical.top_k(scored, size, keys=("key", "qid"), id_col=id_col)
    if texts is not None:
        hits = scale.settle(ranked.select("key", "qid", id_col, F.col("score").alias("text_score")))
        ranked = lexical.top_documents(texts, hits, plain, size, keys=("key", "qid"))
    named = ranked.join(queries, "qid").select(F.col("key").alias("strategy"), F.col(judged_by).alias("query"), "product_id", "rank")
    keys = configs.select(F.collect_set("key")).scalar()
    rows = metrics.evaluation_rows(named, judgments, keys)
    return rows.groupBy(F.col("strategy").alias("key")).agg(*(
        F.round(F.avg(m), metrics.DIGITS).alias(m) for m in metrics.REPORT_METRICS))


def decide(
    candidates: DataFrame, best: DataFrame, min_precision_at_5: float = 0.0, min_mrr_at_10: float = 0.0,
    metric: str = HEADLINE, first_only: bool = False,
) -> DataFrame:
    """Keep a candidate when it passes the gate and beats the best metric (U4).

    ``candidates`` has candidate_no, key and metrics; ``best`` is one row.
    """
    if first_only:
        candidates = candidates.orderBy("candidate_no").limit(1)
    reference = best.select(F.max(metric)).scalar()
    passed = (F.col("precision_at_5") >= min_precision_at_5) & (F.col("mrr_at_10") >= min_mrr_at_10)
    better = F.col(metric) > F.coalesce(reference, F.lit(0.0))
    return candidates.withColumns({
        "gate_passed": passed,
        "delta": F.round(F.col(metric) - F.coalesce(reference, F.lit(0.0)), metrics.DIGITS),
        "kept": passed & better,
        "reason": F.when(~passed, "rejected: below gate")
        .when(~better, f"rejected: does not improve {metric}")
        .otherwise(f"kept: passes gate and improves {metric}"),
    })


def best_experiment(log: DataFrame, metric: str = HEADLINE) -> DataFrame:
    """Gate-passing record with the highest metric; the oldest wins ties."""
    value = F.try_element_at("metrics", F.lit(metric))
    return log.where(F.col("gate_passed") & value.isNotNull()).orderBy(F.desc(value), F.asc("timestamp")).limit(1)


def experiment_id(strategy: Column, boosts: Column, timestamp: Column) -> Column:
    """Deterministic id of a configuration at a time."""
    def plain(value: Column) -> Column:
        text = F.format_string("%.4f", value)
        return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")

    cells = F.transform(F.array_sort(F.map_entries(boosts)), lambda e: F.concat(e["key"], plain(e["value"])))
    joined = F.concat_ws("-", strategy, F.array_join(cells, "_"), timestamp)
    return F.regexp_replace(joined, "[:.]", "")


def experiment_records(
    decided: DataFrame, strategy: str, timestamp: Column, metric_names: Sequence[str] = metrics.REPORT_METRICS,
) -> DataFrame:
    """Decided candidates in the shape of the experiment log."""
    cells = [x for m in metric_names for x in (F.lit(m), F.col(m))]
    note = F.when(F.col("kept"), F.concat(F.lit("staged ("), F.col("reason"), F.lit(")"))).otherwise(F.col("reason"))
    return decided.select(
        experiment_id(F.lit(strategy), F.col("boosts"), timestamp).alias("id"),
        timestamp.alias("timestamp"),
        F.struct(F.lit(strategy).alias("strategy"), F.col("boosts").alias("field_boosts")).alias("config"),
        F.create_map(*cells).alias("metrics"), "gate_passed", note.alias("note"),
        F.create_map(F.lit("kept"), F.col("kept").cast("string"), F.lit("baseline_strategy"), F.lit(strategy)).alias("extra"),
    )
