"""Latency statistics: exact percentiles without gathering a group."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import scale

# Half-width, as a share of the rows, of the first bracket put around a percentile.
BRACKET = 0.0001
SKETCH_ACCURACY = 20000
# Rows of a bracket that are ranked one by one, and cuts that narrow a larger one further.
RANKED_ROWS, CUTS = 100_000, 16


def is_timeout(error: Column) -> Column:
    """Timeout by message text (L3)."""
    text = F.lower(F.coalesce(error, F.lit("")))
    return F.contains(text, F.lit("timeout")) | F.contains(text, F.lit("timed out"))


def percentiles(
    samples: DataFrame, keys: Sequence[str], value: str, ranks: Sequence[float],
) -> DataFrame:
    """Exact percentiles with linear interpolation: (keys, rank, value) (L1).

    A sketch puts cut values around every percentile.  Counting the rows at and between the
    cuts is an ordinary aggregate and tells for certain where the wanted order statistics lie: at a cut, which is
    then the answer, or strictly between two.  Such a bracket is cut again, in rounds, until it holds at most
    ``RANKED_ROWS`` rows; only those are ranked.  A poor sketch costs rounds, never a wrong answer, and a value
    that fills any share of the rows becomes a cut and is counted, not ranked.
    """
    if not keys:
        whole = percentiles(samples.withColumn("_all", F.lit(0)), ["_all"], value, ranks)
        return whole.drop("_all")
    keys = list(keys)
    data = samples.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), F.monotonically_increasing_id().alias("_row"))
    inner = [p for p in ranks if 0 < p < 100]
    shares = sorted({min(1.0, max(0.0, p / 100 + d)) for p in inner for d in (-BRACKET, BRACKET)}) or [0.5]
    settled = scale.settle(data.groupBy(*keys).agg(
        F.percentile_approx("v", [float(s) for s in shares], SKETCH_ACCURACY).alias("cuts"),
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    sketch = settled.df
    wanted = sketch.select(*keys, "n", F.explode(F.array(*(F.lit(float(p)) for p in inner or [50.0]))).alias("p"))
    position = (F.col("n") - 1) * (F.col("p") / 100.0)
    lower = F.floor(position).cast("bigint")
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("bigint")
    places = wanted.select(*keys, "p", F.inline(F.array(
        F.struct(lower.alias("place"), (1 - (position - lower)).alias("share")),
        F.struct(F.least(lower + 1, F.col("n") - 1).alias("place"), (position - lower).alias("share"))))).withColumns(
        {"lo": none, "hi": none, "below": zero, "size": F.lit(None).cast("bigint"), "value": none})
    cuts = replace(settled, df=sketch.select(*keys, none.alias("lo"), none.alias("hi"), "cuts"))
    while True:
        places = scale.settle(_narrowed(data, places, cuts, keys))
        wide = places.df.where(F.col("value").isNull() & (F.col("size") > RANKED_ROWS))
        if wide.isEmpty():
            break
        held = _inside(data, replace(places, df=wide.select(*keys, "lo", "hi").distinct()), keys)
        cuts = scale.settle(held.groupBy(*keys, "lo", "hi").agg(
            F.percentile_approx("v", [i / (CUTS + 1) for i in range(1, CUTS + 1)], SKETCH_ACCURACY).alias("cuts")))
        places = places.df
    done, open_ = places.df.where("value IS NOT NULL"), places.df.where("value IS NULL").drop("value")
    # At most RANKED_ROWS rows in each bracket.
    ordered = _inside(data, replace(places, df=open_.select(*keys, "lo", "hi").distinct()), keys).groupBy(*keys, "lo", "hi", "v").agg(F.count(F.lit(1)).alias("repeats"))
    last = F.sum("repeats").over(Window.partitionBy(*keys, "lo", "hi").orderBy("v"))
    ordered = ordered.withColumn("last", last).withColumn("first", F.col("last") - F.col("repeats"))
    picked = _same_bracket(open_, ordered, keys).where(
        (F.col("place") - F.col("below") >= F.col("first")) & (F.col("place") - F.col("below") < F.col("last"))).select(*keys, "p", "share", F.col("v").alias("value"))
    out = done.select(*keys, "p", "share", "value").unionByName(picked).groupBy(*keys, "p").agg(F.sum(F.col("value") * F.col("share")).alias("value"))
    if not inner:
        out = out.where("false")
    edges = [p for p in ranks if not 0 < p < 100]
    if edges:
        cells = F.array(*(
            F.struct(F.lit(float(p)).alias("p"), F.col("low" if p <= 0 else "high").alias("value")) for p in edges))
        out = out.unionByName(sketch.select(*keys, F.inline(cells)))
    return out.select(*keys, F.col("p").alias("rank"), "value")


def _inside(data: DataFrame, brackets: scale.Settled, keys: list[str]) -> DataFrame:
    """The rows strictly between a bracket's ends; a null end is open."""
    joined = scale.join_settled(data, brackets, keys, salt_by="_row")
    return joined.where((F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi"))))


def _same_bracket(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    names = {c: f"_{c}" for c in (*keys, "lo", "hi")}
    other = right.withColumnsRenamed(names)
    same = F.lit(True)
    for c, renamed in names.items():
        same = same & F.col(c).eqNullSafe(F.col(renamed))
    return left.join(other, same).drop(*names.values())


def _narrowed(data: DataFrame, places: DataFrame, cuts: scale.Settled, keys: list[str]) -> DataFrame:
    """Each open place with a narrower bracket, or with its value where that is a cut.

    Cells of a bracket alternate between the open intervals (even) and the cuts (odd).
    """
    cuts = replace(cuts, df=cuts.df.withColumn("cuts", F.array_sort(F.array_distinct("cuts"))))
    cell = sum((F.when(F.get("cuts", F.lit(i)) < F.col("v"), 2).when(F.get("cuts", F.lit(i)) == F.col("v"), 1).otherwise(0) for i in range(2 * CUTS)), F.lit(0))
    counts = _inside(data, cuts, keys).groupBy(*keys, "lo", "hi", cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    in_order = Window.partitionBy(*keys, "lo", "hi").orderBy("cell")
    counts = _same_bracket(counts.withColumn("before", F.sum("rows").over(in_order) - F.col("rows")), cuts.df, keys)
    waiting = places.where(F.col("value").isNull())
    found = _same_bracket(waiting.drop("size", "value"), counts, keys).where(
        (F.col("place") - F.col("below") >= F.col("before")) & (F.col("place") - F.col("below") < F.col("before") + F.col("rows")))
    half = F.floor(F.col("cell") / 2).cast("int")
    at_cut = F.col("cell") % 2 == 1
    narrower = found.select(
        *keys, "p", "place", "share", F.when(half > 0, F.get("cuts", half - 1)).otherwise(F.col("lo")).alias("lo"), F.coalesce(F.get("cuts", half), "hi").alias("hi"),
        (F.col("below") + F.col("before")).alias("below"), F.col("rows").alias("size"), F.when(at_cut, F.get("cuts", half)).alias("value"))
    # Places whose bracket was not cut stay as they are.
    still = waiting.where(F.col("size") <= RANKED_ROWS)
    return narrower.unionByName(still).unionByName(places.where(F.col("value").isNotNull()))


def summarize(attempts: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Counts and rates over all attempts, latencies over the successful ones (L2)."""
    keys = list(keys)
    good = F.when(F.col("success"), F.col("latency_ms"))
    base = attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(F.col("success").cast("bigint")).alias("success_count"),
        F.sum((~F.col("success")).cast("bigint")).alias("error_count"),
        F.sum(F.col("timed_out").cast("bigint")).alias("timeout_count"),
        F.min(good).alias("min"), F.max(good).alias("max"), F.avg(good).alias("avg"),
    )
    tall = percentiles(attempts.where("success"), keys, "latency_ms", (50, 95, 99))
    wide = tall.groupBy(*keys).agg(*(
        F.max(F.when(F.col("rank") == p, F.col("value"))).alias(f"p{p}") for p in (50, 95, 99)))
    joined = base.join(wide, keys, "left").fillna(0.0, ["p50", "p95", "p99", "min", "max", "avg"])
    return joined.select(
        *keys, "count", "success_count", "error_count", "timeout_count", "p50", "p95", "p99", "min", "max", "avg",
        (F.col("error_count") / F.col("count")).alias("error_rate"),
        (F.col("timeout_count") / F.col("count")).alias("timeout_rate"))


def run_counters(attempts: DataFrame) -> DataFrame:
    """Distinct queries, attempts, and the most repeats of a query within one
    strategy (L4).  ``strategy`` pairs are counted before anything is shuffled."""
    pairs = attempts.groupBy("strategy", "query").agg(F.count(F.lit(1)).alias("repeats"))
    per_query = pairs.groupBy("query").agg(F.max("repeats").alias("repeat"), F.sum("repeats").alias("attempts"))
    return per_query.agg(
        F.count(F.lit(1)).alias("query_count"),
        F.coalesce(F.max("repeat"), F.lit(0)).alias("repeat"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempt_count"))


def ingest_lag(catalog: DataFrame) -> DataFrame:
    """Seconds between the last change of a product and its indexing."""
    lag = (F.unix_micros(F.col("indexed_at").cast("timestamp"))
           - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 1e6
    return catalog.withColumn("lag_seconds", lag)
