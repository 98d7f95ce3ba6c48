import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import events as ev
from shelfmark.streaming.replay import StreamReplay, read_event_stream

EVENT = "seq long, product_id string, source_system string, event_type string, event_time timestamp, payload string, source_version long"
PRODUCT = (
    "product_id string, title string, description string, brand string, category string, attributes map<string,string>, "
    "price double, currency string, availability string, popularity_score double, seller_id string, updated_at timestamp, "
    "source_versions map<string,string>, indexed_at timestamp, catalog_text string, search_profile string")


def when(text):
    from datetime import datetime
    return datetime.fromisoformat(text)


def product(pid, versions=None):
    return (pid, "Old title", "", "Acme", "Old", {"color": "red", "size": "1"}, 10.0, "USD", "in_stock", 1.0, "s1",
            when("2026-01-01 00:00:00"), versions or {"sample_jsonl": "2026-01-01T00:00:00Z"}, when("2026-01-01 00:00:00"), "old", "old")


def as_of():
    return F.lit("2026-06-01 00:00:00").cast("timestamp")


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame([product("p1"), product("p2", {"pricing": "7"})], PRODUCT)


def events(spark, *items):
    data = [(i, p, s, t, when(f"2026-05-01 09:0{i % 10}:00"), json.dumps(load), v) for i, (p, s, t, load, v) in enumerate(items)]
    return spark.createDataFrame(data, EVENT)


def test_every_kind_of_change(spark, catalog):
    df = events(
        spark,
        ("p1", "content", ev.TITLE, {"title": "New"}, 1),
        ("p1", "cats", ev.CATEGORY, {"category": "New > Cat"}, 12),
        ("p1", "stock", ev.AVAILABILITY, {"availability": "limited_stock"}, 88),
        ("p1", "pricing", ev.PRICE, {"price": 7.5, "currency": "eur"}, 55),
        ("p1", "sellers", ev.SELLER, {"seller_id": "s9", "brand": None}, 7),
        ("p1", "content", ev.ATTRIBUTES, {"attributes": {"color": "black", "new": "x"}}, 2),
        ("p2", "stock", ev.DELETED, {}, 89),
        ("p1", "stock", ev.AVAILABILITY, {"availability": "in_stock"}, 80),
        ("p2", "pricing", ev.PRICE, {"price": 1.0}, 7),
        ("nobody", "stock", ev.DELETED, {}, 1),
    )
    judged = ev.outcomes(df, catalog)
    assert [r["outcome"] for r in judged.orderBy("seq").collect()] == ["updated"] * 7 + ["skipped_stale"] * 2 + ["failed"]
    assert tuple(ev.replay_summary(judged).head()) == (10, 7, 2, 1)
    done = {r["product_id"]: r for r in ev.replay(catalog, judged, as_of()).collect()}
    p1, p2 = done["p1"], done["p2"]
    assert (p1["title"], p1["category"], p1["availability"], p1["price"], p1["currency"]) == (
        "New", "New > Cat", "limited_stock", 7.5, "EUR")
    assert p1["seller_id"] == "s9" and p1["brand"] is None and p1["popularity_score"] == 1.0
    assert p1["attributes"] == {"color": "black", "size": "1", "new": "x"}
    assert p1["source_versions"] == {
        "sample_jsonl": "2026-01-01T00:00:00Z", "content": "2", "cats": "12", "stock": "88", "pricing": "55", "sellers": "7"}
    assert p1["updated_at"] == when("2026-05-01 09:05:00") and p1["indexed_at"] == when("2026-06-01 00:00:00")
    # Derived text is left as it was unless asked for.
    assert p1["search_profile"] == "old"
    assert p2["availability"] == "discontinued" and p2["price"] == 10.0
    fresh = ev.replay(catalog, judged, as_of(), replace_attributes=True, refresh_derived=True).where("product_id = 'p1'").head()
    assert fresh["attributes"] == {"color": "black", "new": "x"} and fresh["search_profile"].startswith("Product: New.")


def loop(items, versions):
    """One event after the other."""
    state = {k: dict(v) for k, v in versions.items()}
    out = []
    for p, s, v in items:
        if p not in state:
            out.append("failed")
        elif state[p].get(s) is not None and state[p][s] >= v:
            out.append("skipped_stale")
        else:
            state[p][s] = v
            out.append("updated")
    return out


@pytest.mark.parametrize("slices", [1, 7, 1000])
def test_outcomes_equal_the_loop(spark, slices):
    """Random events, one product holding a third of them."""
    rng = random.Random(slices)
    items = [("hot" if rng.random() < 0.34 else f"p{rng.randint(0, 6)}", f"s{rng.randint(0, 2)}", rng.randint(0, 60)) for _ in range(400)]
    seeds = {"hot": {"s0": 5}, **{f"p{i}": {"s1": i} for i in range(6)}}
    catalog = spark.createDataFrame([(p, {k: str(v) for k, v in m.items()}) for p, m in seeds.items()],
                                    "product_id string, source_versions map<string,string>")
    df = spark.createDataFrame([(i * 3, p, s, v) for i, (p, s, v) in enumerate(items)],
                               "seq long, product_id string, source_system string, source_version long")
    got = ev.outcomes(df.repartition(5), catalog, slices).orderBy("seq").collect()
    assert [r["outcome"] for r in got] == loop(items, seeds)


def test_stream_equals_batch(spark, catalog, tmp_path):
    """Several micro-batches, snapshots between them, and one batch run twice."""
    rng = random.Random(8)
    kinds = [(ev.TITLE, "title"), (ev.CATEGORY, "category")]
    items = []
    for i in range(60):
        kind, field = rng.choice(kinds)
        items.append((rng.choice(["p1", "p2", "zz"]), rng.choice(["a", "pricing"]), kind, {field: f"v{i}"}, rng.randint(0, 40)))
    df = events(spark, *items).withColumn("event_id", F.col("seq").cast("string"))
    folder = tmp_path / "in"
    for n in range(4):
        df.where(f"seq div 15 = {n}").coalesce(1).write.mode("append").json(str(folder))
    stream = read_event_stream(spark, str(folder), maxFilesPerTrigger="1")
    replay = StreamReplay(catalog, str(tmp_path / "state"), snapshot_every=2)
    replay.start(stream, available_now=True).awaitTermination()
    batch = {r["seq"]: r["outcome"] for r in ev.outcomes(df, catalog).collect()}
    assert {r["seq"]: r["outcome"] for r in replay.outcomes().collect()} == batch
    assert replay._epochs("snapshot") == [1, 3]
    # The last batch again: nothing changes.
    replay.apply(df.where("seq >= 45"), 3)
    assert {r["seq"]: r["outcome"] for r in replay.outcomes().collect()} == batch
    expected = ev.replay(catalog, ev.outcomes(df, catalog), as_of()).orderBy("product_id").collect()
    assert replay.current_catalog(as_of()).orderBy("product_id").collect() == expected


def test_clustered_arrival_is_cut_into_slices_of_like_size(spark):
    seqs = [*range(5000), *range(10**12, 10**12 + 300), 10**15, *range(-40, -20)]
    df = spark.createDataFrame([(x,) for x in seqs], "seq long").repartition(6)
    got = ev.arrival_slices(df, 20).groupBy("_slice").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("_slice").collect()
    assert sum(r["n"] for r in got) == len(seqs)
    assert len(got) >= 15 and max(r["n"] for r in got) <= 2 * len(seqs) / 20
    assert all(x["b"] < y["a"] for x, y in zip(got, got[1:]))


def test_slices_of_repeated_missing_and_no_arrival_numbers(spark):
    hot = spark.createDataFrame([*((7,) for _ in range(600)), *((7 + i,) for i in range(400)), (None,)], "seq long")
    got = {r["_slice"]: (r["n"], r["a"]) for r in ev.arrival_slices(hot, 10).groupBy("_slice").agg(F.count("*").alias("n"), F.min("seq").alias("a")).collect()}
    assert got.pop(None) == (1, None)
    assert sorted(got.values(), key=lambda x: x[1])[0][1] == 7 and sum(n for n, _ in got.values()) == 1000
    assert sum(n > 200 for n, _ in got.values()) == 1
    assert ev.arrival_slices(hot.limit(0), 10).count() == 0
    assert {r["_slice"] for r in ev.arrival_slices(hot, 1).collect()} == {None, 0}


def test_outcomes_of_clustered_arrival_equal_the_loop(spark):
    catalog = spark.createDataFrame([product("p1"), product("p2", {"a": "3"})], PRODUCT)
    rng = random.Random(5)
    seqs = sorted(rng.sample(range(400), 200) + rng.sample(range(10**9, 10**9 + 90), 60))
    data = [(q, rng.choice(["p1", "p1", "p2", "p9"]), rng.choice("ab"), ev.PRICE, when("2026-05-01 09:00:00"), "{}", rng.randint(1, 30)) for q in seqs]
    seen, expected = {("p2", "a"): 3}, []
    for _, p, s, *_, v in data:
        known = seen.get((p, s))
        expected.append("failed" if p == "p9" else "skipped_stale" if known is not None and known >= v else "updated")
        if expected[-1] == "updated":
            seen[p, s] = v
    got = ev.outcomes(spark.createDataFrame(data, EVENT).repartition(5), catalog, 9).orderBy("seq").collect()
    assert [r["outcome"] for r in got] == expected
