"""Rounds of the tuning loop: the log decides what is proposed next."""

from pyspark.sql import functions as F

from shelfmark.operators import tune
from shelfmark.plans.strategies import STRATEGIES
from shelfmark.plans.tuning import tune_round
from shelfmark.sources.experiments import ExperimentStore

CATALOG = [
    ("p1", "red coffee maker", "makes coffee", "acme", "kitchen"), ("p2", "coffee grinder red", "coffee coffee", "beanly", "coffee"),
    ("p3", "red shoes", "running red shoes", "acme", "sports"), ("p4", "coffee table", "a table of oak", "oakly", "home"), ("p5", "green cup", "for red coffee", "acme", "coffee")]


def test_rounds_follow_the_log(spark, tmp_path):
    catalog = spark.createDataFrame(CATALOG, "product_id string, title string, description string, brand string, category string").withColumns(
        {"catalog_text": F.concat_ws(" ", "title", "description"), "search_profile": F.col("title")})
    queries = spark.createDataFrame([("red coffee", "red coffee"), ("coffee", "coffee")], "qid string, query string")
    judgments = spark.createDataFrame([("red coffee", "p2", 3), ("red coffee", "p5", 1), ("coffee", "p5", 3)], "query string, product_id string, grade int")
    store = ExperimentStore(spark, str(tmp_path / "log.jsonl"))
    name = "baseline_bm25"
    seen = []
    for i in range(3):
        best = store.best().collect()
        decided = tune_round(store, catalog, queries, judgments, name, F.lit(f"2026-01-0{i + 1}T00:00:00Z")).collect()
        assert len(decided) == 1
        d = decided[0]
        base = best[0].config.field_boosts if best else STRATEGIES[name].boosts
        changed = {f for f in base if abs(base[f] - d.boosts[f]) > 1e-9}
        assert len(changed) == 1 and d.key not in seen
        seen.append(d.key)
        if best:
            assert d.kept == (d.gate_passed and d.precision_at_5 > best[0].metrics["precision_at_5"])
    log = store.all().collect()
    assert [r.note.split(" ")[0] for r in log][0] == "baseline" and len(log) == 4 and log[0].extra == {}
    assert all(r.extra["baseline_strategy"] == name for r in log[1:])
    # The proposals are the first that propose() gives without those in the log.
    first = tune.propose(spark.createDataFrame([(name, dict(STRATEGIES[name].boosts))], "strategy string, boosts map<string,double>")).orderBy("candidate_no").first()
    assert seen[0] == first.key


def test_no_candidate_is_left(spark, tmp_path):
    catalog = spark.createDataFrame(CATALOG, "product_id string, title string, description string, brand string, category string").withColumns(
        {"catalog_text": F.col("title"), "search_profile": F.col("title")})
    queries = spark.createDataFrame([("coffee", "coffee")], "qid string, query string")
    judgments = spark.createDataFrame([("coffee", "p1", 3)], "query string, product_id string, grade int")
    store = ExperimentStore(spark, str(tmp_path / "log.jsonl"))
    rounds = [tune_round(store, catalog, queries, judgments, "baseline_bm25", F.lit(f"2026-01-0{i + 1}T00:00:00Z"), min_precision_at_5=2.0, first_only=False).count() for i in range(2)]
    assert rounds == [10, 0]  # nothing passes, so the second round starts from the same boosts
    assert [r.note for r in store.all().collect()].count("baseline") == 2
