import math
import random

import pytest
from pyspark.sql import functions as F

from shelfmark import scale
from shelfmark.operators import gate, latency, metrics, tune
from shelfmark.sources.experiments import ExperimentStore, TableExperimentStore

RANKING = "strategy string, query string, product_id string, rank int"
JUDGED = "query string, product_id string, grade int"


def ranking(spark, lists):
    data = [(s, q, x, i + 1) for (s, q), ids in lists.items() for i, x in enumerate(ids)]
    return spark.createDataFrame(data, RANKING)


def judged(spark, grades):
    return spark.createDataFrame([(q, p, g) for q, many in grades.items() for p, g in many.items()], JUDGED)


def dcg(grades):
    return sum((2 ** g - 1) / math.log2(i + 2) for i, g in enumerate(grades))


def test_metrics_by_hand(spark):
    got = metrics.query_metrics(
        ranking(spark, {("s", "q"): "BAC", ("s", "one"): "A", ("s", "late"): "ABC"}),
        judged(spark, {"q": {"A": 3, "B": 2, "C": 1}, "one": {"A": 3}, "late": {"C": 3}, "none": {"A": 0}, "miss": {"Z": 1}}),
        ["s"], (3, 10))
    r = {x["query"]: x for x in got.collect()}
    assert r["q"]["ndcg_at_3"] == pytest.approx(dcg([2, 3, 1]) / dcg([3, 2, 1]))
    assert dcg([3, 2, 1]) == pytest.approx(7 + 3 / math.log2(3) + 1 / 2)
    # The divisor is the number returned.
    assert r["one"]["precision_at_10"] == 1.0 and r["one"]["ndcg_at_10"] == 1.0
    assert r["late"]["mrr"] == pytest.approx(1 / 3)
    assert r["none"]["ndcg_at_10"] == 0.0 and r["none"]["recall_at_10"] == 0.0
    assert r["miss"]["precision_at_10"] == 0.0 and r["miss"]["ranked_product_ids"] == []
    with pytest.raises(ValueError):
        metrics.query_metrics(ranking(spark, {("s", "q"): "A"}), judged(spark, {"q": {"A": 1}}), ["s"], (0,))


def test_reciprocal_rank_is_cut(spark):
    ids = [f"x{i}" for i in range(10)] + ["hit"]
    got = metrics.query_metrics(ranking(spark, {("s", "q"): ids}), judged(spark, {"q": {"hit": 1}}), ["s"], (10,)).head()
    assert got["mrr_at_10"] == 0.0 and got["mrr"] == pytest.approx(1 / 11)


def test_precision_over_k(spark):
    long = metrics.metrics_at(ranking(spark, {("s", "q"): "A"}), judged(spark, {"q": {"A": 3}}), ["s"], (1, 5))
    got = {(r["metric"], r["k"]): r["value"] for r in long.collect()}
    assert got["precision", 5] == pytest.approx(0.2) and got["precision", 1] == 1.0 and got["mrr", 5] == 1.0


EVAL = "strategy string, query string, status string, precision_at_5 double, recall_at_5 double, mrr_at_10 double, ndcg_at_10 double, ranked_product_ids array<string>"


def test_summary_and_winners(spark):
    rows = spark.createDataFrame([
        ("base", "q1", "ok", 0.2, 0.1, 0.5, 0.5, ["a"]), ("new", "q1", "ok", 0.4, 0.1, 0.5, 0.5, ["b"]),
        ("base", "q2", "ok", 0.0, 0.0, 0.0, 0.0, []), ("new", "q2", "ok", 0.0, 0.0, 0.0, 0.0, []),
        ("base", "q3", "ok", 1.0, 1.0, 1.0, 1.0, ["a", "b"]), ("new", "q3", "ok", 1.0, 1.0, 1.0, 1.0, ["a", "b"]),
        ("later", "q1", "pending", 0.9, 0.9, 0.9, 0.9, []),
    ], EVAL)
    s = {r["strategy"]: r for r in metrics.summary(rows, "base").collect()}
    assert s["new"]["delta_precision_at_5"] == pytest.approx((1.4 - 1.2) / 3)
    assert s["later"]["status"] == "pending" and s["later"]["pending_queries"] == 1 and s["later"]["ndcg_at_10"] == 0.0
    assert {r["delta_ndcg_at_10"] for r in metrics.summary(rows, "absent").collect()} == {0.0, 0.5}
    w = {(r["query"], r["strategy"]): r for r in metrics.winners(rows).collect()}
    assert w["q1", "new"]["winner"] == "yes" and w["q1", "base"]["winner"] == "" and w["q1", "later"]["winner"] == ""
    assert w["q2", "new"]["winners"] == [] and w["q2", "new"]["top_results"] == "none"
    assert w["q3", "new"]["winner"] == "tie" and w["q3", "new"]["winners"] == ["base", "new"]
    assert w["q3", "new"]["top_results"] == "a, b"


def test_compare_ideal_and_first(spark):
    j = judged(spark, {"a": {"x": 1, "y": 3, "w": 3}, "b": {"z": 2}})
    times = spark.createDataFrame([("s", 10.0), ("s", 20.0)], "strategy string, latency_ms double")
    got = metrics.compare(ranking(spark, {("s", "a"): "yx", ("s", "b"): "q"}), j, ["s"], 10, times).head()
    assert got["mrr"] == 0.5 and got["mean_latency_ms"] == 15.0
    best = metrics.ideal_ranking(j, 2).where("query = 'a'").orderBy("rank").collect()
    assert [r["product_id"] for r in best] == ["w", "y"]
    assert {r["query"] for r in metrics.first_queries(j, 1).collect()} == {"a"}


def interpolated(values, p):
    ordered = sorted(values)
    at = (len(ordered) - 1) * p / 100
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] * (1 - (at - low)) + ordered[high] * (at - low)


@pytest.mark.parametrize("bound", [None, 0])
def test_percentiles(spark, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr(scale, "BROADCAST_BYTES", bound)
    rng = random.Random(4)
    groups = {
        "hand": [10.0, 20.0, 30.0, 40.0], "single": [7.0], "same": [5.0] * 50,
        # One value holds a third of the group.
        "hot": [1.0] * 400 + [round(rng.random() * 100, 2) for _ in range(800)],
    }
    df = spark.createDataFrame([(g, v) for g, many in groups.items() for v in many], "g string, v double")
    got = {(r["g"], r["rank"]): r["value"] for r in latency.percentiles(df, ["g"], "v", (0, 50, 95, 99, 100)).collect()}
    assert got["hand", 50.0] == pytest.approx(25.0) and got["hand", 95.0] == pytest.approx(38.5)
    for g, many in groups.items():
        for p in (0, 50, 95, 99, 100):
            assert got[g, float(p)] == pytest.approx(interpolated(many, p)), (g, p)


def test_a_bad_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(latency, "SKETCH_ACCURACY", 2)
    rng = random.Random(9)
    many = [rng.expovariate(1) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in many], "v double")
    got = {r["rank"]: r["value"] for r in latency.percentiles(df, [], "v", (50, 99)).collect()}
    assert got == {p: pytest.approx(interpolated(many, p)) for p in (50.0, 99.0)}


ATTEMPT = "strategy string, query string, latency_ms double, success boolean, timed_out boolean, error string"


def test_latency_summary(spark):
    df = spark.createDataFrame([
        ("a", "q1", 10.0, True, False, None), ("a", "q1", 20.0, True, False, None),
        ("a", "q2", 999.0, False, True, "Connection timed out"), ("b", "q1", 5.0, False, False, "boom"),
    ], ATTEMPT)
    got = {r["strategy"]: r for r in latency.summarize(df).collect()}
    assert got["a"]["p50"] == 15.0 and got["a"]["avg"] == 15.0 and got["a"]["max"] == 20.0
    assert got["a"]["error_rate"] == pytest.approx(1 / 3) and got["a"]["timeout_count"] == 1
    assert got["b"]["p95"] == 0.0 and got["b"]["success_count"] == 0 and got["b"]["error_rate"] == 1.0
    assert tuple(latency.run_counters(df).head()) == (2, 2, 4)
    flags = [r[0] for r in df.orderBy("latency_ms").select(latency.is_timeout(F.col("error"))).collect()]
    assert flags == [False, False, False, True]


def reports(spark, p, mrr, p95):
    rel = spark.createDataFrame([("s", p, mrr)], "strategy string, precision_at_5 double, mrr_at_10 double")
    lat = spark.createDataFrame([("s", p95)], "strategy string, p95 double")
    return rel, lat


def test_gate(spark):
    bounds = spark.createDataFrame([("s", 0.6, 0.75, 100.0)], "strategy string, min_precision_at_5 double, min_mrr_at_10 double, max_p95_ms double")
    bad = gate.gate_verdict(gate.quality_gate(*reports(spark, 0.4, 0.5, 150.0), bounds)).head()
    assert not bad["passed"] and bad["failures"] == [
        "Precision@5 failed for s: 0.400 < 0.600", "MRR@10 failed for s: 0.500 < 0.750",
        "p95 latency failed for s: 150.00ms > 100.00ms"]
    good = gate.gate_verdict(gate.quality_gate(*reports(spark, 0.6, 0.75, 100.0), bounds)).head()
    assert good["passed"] and good["failures"] == []
    free = gate.gate_verdict(gate.quality_gate(*reports(spark, 0.0, 0.0, 1e9), bounds.select("strategy"))).head()
    assert free["passed"]
    absent = bounds.withColumn("strategy", F.lit("other"))
    with pytest.raises(Exception, match="was not found in report summary"):
        gate.quality_gate(*reports(spark, 1.0, 1.0, 1.0), absent).collect()


def test_threshold_checks(spark):
    at = spark.createDataFrame([("a", "mrr", 10, 0.8), ("b", "mrr", 10, 0.7)], "strategy string, metric string, k int, value double")
    got = {(r["strategy"], r["metric"]): r["passed"] for r in gate.threshold_checks(
        at, {"a": {"precision@5": 0.6, "mrr@10": 0.75}, "default": {"mrr@10": 0.75}}).collect()}
    assert got == {("a", "precision"): False, ("a", "mrr"): True, ("b", "mrr"): False}


BASE = "strategy string, boosts map<string,double>"


def test_propose_order_clamp_and_tried(spark):
    base = spark.createDataFrame([("s", {"title": 4.0, "brand": 0.1, "x": 10.0})], BASE)
    got = tune.propose(base).orderBy("candidate_no").collect()
    # brand down and x up stay at their limits, which is the base itself.
    assert [(r["field"], r["value"]) for r in got] == [("brand", 0.15), ("title", 6.0), ("title", 2.0), ("x", 5.0)]
    tried = spark.createDataFrame([("s", {"title": 6.0, "brand": 0.1, "x": 10.0})], BASE)
    assert [r["value"] for r in tune.propose(base, tried).orderBy("candidate_no").collect()] == [0.15, 2.0, 5.0]


def test_decide(spark):
    schema = "candidate_no int, key string, boosts map<string,double>, precision_at_5 double, recall_at_5 double, mrr_at_10 double, ndcg_at_10 double"
    rows = spark.createDataFrame([
        (0, "a", {"t": 1.5}, 0.7, 0.1, 0.8, 0.5), (1, "b", {"t": 0.5}, 0.6, 0.1, 0.8, 0.5), (2, "c", {"t": 2.0}, 0.9, 0.1, 0.1, 0.5)], schema)
    best = rows.where("candidate_no = 1")
    got = {r["key"]: r for r in tune.decide(rows, best, 0.5, 0.5).collect()}
    assert got["a"]["kept"] and got["a"]["delta"] == pytest.approx(0.1)
    assert got["b"]["reason"] == "rejected: does not improve precision_at_5"
    assert got["c"]["reason"] == "rejected: below gate" and not got["c"]["kept"]
    assert tune.decide(rows, best, first_only=True).count() == 1


def test_experiment_store(spark, tmp_path):
    store = ExperimentStore(spark, str(tmp_path / "log"))
    assert store.all().count() == 0 and store.best().count() == 0
    decided = spark.createDataFrame(
        [({"title": 6.0, "brand": 0.75}, 0.5, 0.1, 0.2, 0.3, True, True, "kept: x")],
        "boosts map<string,double>, precision_at_5 double, recall_at_5 double, mrr_at_10 double, ndcg_at_10 double, gate_passed boolean, kept boolean, reason string")
    for ts in ("2026-01-02T00:00:00Z", "2026-01-01T00:00:00Z"):
        store.append(tune.experiment_records(decided, "s", F.lit(ts)))
    everything = store.all().collect()
    assert [r["timestamp"] for r in everything] == ["2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z"]
    assert everything[0]["id"] == "s-brand075_title6-2026-01-01T000000Z"
    assert everything[0]["config"]["field_boosts"] == {"title": 6.0, "brand": 0.75}
    assert everything[0]["note"] == "staged (kept: x)"
    # Equal metrics: the oldest record wins; failed gates never do.
    assert store.best().head()["timestamp"] == "2026-01-01T00:00:00Z"
    table = TableExperimentStore(store.all().withColumn("gate_passed", F.lit(False)))
    assert table.best().count() == 0


@pytest.mark.parametrize("ranked", [5, 100_000])
def test_percentiles_in_rounds(spark, monkeypatch, ranked):
    """Constant, skewed, tied and spread latencies; brackets narrowed to a few rows give the same as one ranking."""
    import numpy as np

    from shelfmark.operators import latency

    monkeypatch.setattr(latency, "RANKED_ROWS", ranked)
    monkeypatch.setattr(latency, "SKETCH_ACCURACY", 20)
    draw = np.random.default_rng(2)
    samples = {
        "constant": np.full(700, 3.5), "half": np.concatenate([np.full(500, 1.0), draw.random(500)]), "skewed": draw.lognormal(0, 3, 1500),
        "two": np.array([1.0, 2.0] * 200), "one": np.array([7.0]), "spread": np.arange(1200) / 7}
    rows = [(k, float(x)) for k, xs in samples.items() for x in xs]
    random.Random(1).shuffle(rows)
    found = latency.percentiles(spark.createDataFrame(rows, "strategy string, ms double"), ["strategy"], "ms", (0, 50, 95, 99, 100)).collect()
    got = {(r.strategy, r["rank"]): r.value for r in found}
    assert len(got) == len(found) == 5 * len(samples)
    for k, xs in samples.items():
        for p in (0, 50, 95, 99, 100):
            assert got[k, p] == pytest.approx(np.percentile(xs, p), rel=1e-12), (k, p)
