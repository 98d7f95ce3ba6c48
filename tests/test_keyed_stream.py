"""The stream with keyed state: batches, restart, quarantine, hot products; and the bucketed catalog."""

import json
import os
import random

from pyspark.sql import functions as F

from shelfmark.operators import events as ev
from shelfmark.sources.buckets import BucketedTable
from shelfmark.streaming.keyed import KeyedReplay
from tests.test_events import PRODUCT, as_of, product

WIRE = "event_id string, product_id string, source_system string, event_type string, event_time string, payload string, source_version bigint, seq bigint"


def wire(spark, items):
    rows = [(f"e{i}", p, s, t, f"2026-05-01T09:{i // 60:02}:{i % 60:02}Z", json.dumps(load), v, i) for i, (p, s, t, load, v) in enumerate(items)]
    return spark.createDataFrame(rows, WIRE)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_stream_in_batches_with_a_restart(spark, tmp_path):
    rng = random.Random(5)
    items = []
    for i in range(90):
        name = "p1" if rng.random() < 0.4 else rng.choice(["p2", "p3", "zz"])  # one hot product
        kind, load = rng.choice([(ev.TITLE, {"title": f"t{i}"}), (ev.PRICE, {"price": i, "currency": "eur"}), (ev.ATTRIBUTES, {"attributes": {"color": f"c{i}"}})])
        items.append((name, rng.choice(["a", "pricing"]), kind, load, rng.randint(0, 60)))
    for i in (4, 40, 77):
        items[i] = ("p1", "a", ev.PRICE, {"price": -1}, 1000)  # breaks a rule; must not raise the version
    df = wire(spark, items)
    start = spark.createDataFrame([product("p1"), product("p2", {"pricing": "7"}), product("p3", {"a": "x"})], PRODUCT)
    table = BucketedTable.create(start, str(tmp_path / "catalog"), buckets=8)
    folder, root = tmp_path / "in", str(tmp_path / "state")

    def arrive(lo, hi):
        df.where(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.mode("append").json(str(folder))

    def run():
        stream = spark.readStream.schema(WIRE).option("maxFilesPerTrigger", 1).json(str(folder))
        replay = KeyedReplay(BucketedTable(spark, table.path, buckets=8), root, as_of, slice_width=7)
        replay.start(stream, available_now=True).awaitTermination()
        return replay

    arrive(0, 20)
    arrive(20, 45)
    assert run().outcomes().count() == 45
    arrive(45, 60)
    arrive(60, 90)
    replay = run()  # a new query goes on with the stored state
    good = df.where("NOT (source_version = 1000)").withColumn("event_time", F.to_timestamp("event_time"))
    judged = ev.outcomes(good, start)
    want = {r.seq: r.outcome for r in judged.collect()} | {4: "rejected", 40: "rejected", 77: "rejected"}
    got = replay.outcomes()
    assert {r.seq: r.outcome for r in got.collect()} == want and got.count() == 90
    assert [r.errors for r in replay.quarantine().collect()] == [["price"]] * 3
    assert len([d for d in os.listdir(f"{root}/outcomes") if d.startswith("epoch=")]) >= 4
    expected = ev.replay(start, judged, as_of()).orderBy("product_id").collect()
    assert table.read().orderBy("product_id").collect() == expected
    # The last batch once more: nothing changes.
    last = max(int(d.split("=")[1]) for d in os.listdir(f"{root}/arrived") if d.startswith("epoch="))
    replay.apply(spark.read.parquet(f"{root}/arrived/epoch={last}").checkpoint(), last)
    assert table.read().orderBy("product_id").collect() == expected and replay.outcomes().count() == 90


def test_an_upsert_rewrites_only_its_buckets(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("string").alias("product_id"), F.lit("old").alias("v"))
    table = BucketedTable.create(rows, str(tmp_path / "t"), buckets=16)
    before = files(table.path)
    touched = table.upsert(spark.createDataFrame([("7", "new", 1), ("7", "newer", 2), ("x", "added", 1)], "product_id string, v string, seq int"))
    after = files(table.path)
    assert 1 <= len(touched) <= 2
    changed = {p for p in before.keys() ^ after.keys()} | {p for p in before.keys() & after.keys() if before[p] != after[p]}
    assert changed and all(any(f"_bucket={b}/" in p for b in touched) for p in changed)
    got = {r.product_id: r.v for r in table.read().collect()}
    assert len(got) == 201 and got["7"] == "newer" and got["x"] == "added" and got["8"] == "old"
    again = files(table.path)
    assert table.upsert(rows.where("false").withColumn("seq", F.lit(1))) == [] and files(table.path) == again


def test_an_empty_table_keeps_its_columns(spark, tmp_path):
    table = BucketedTable.create(spark.range(0).select(F.col("id").cast("string").alias("product_id")), str(tmp_path / "t"))
    assert table.read().columns == ["product_id"] and table.read().count() == 0
    table.upsert(spark.createDataFrame([("a", 1)], "product_id string, seq int"))
    assert [r.product_id for r in table.read().collect()] == ["a"]


def test_the_query_takes_a_quarter_of_many_files_as_one_batch(spark, tmp_path):
    """One file a batch would take files of a quarter in the order in which their writing ended, not in that of the events."""
    from registry import result_queries, views

    kinds = ("error", "click", "view", "purchase", "signup")
    rows = [(i, "2024-01-01", i * 7 % 5, kinds[i % 5], 1.0, json.dumps({"k": i * 37 % 100})) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    # Files of mixed order, the latest events first.
    events.repartitionByRange(5, (-F.col("event_id")) % 100).write.parquet(str(tmp_path / "events.parquet"))
    customers = [(i, f"c{i}", "m", 1.0, 10 * i) for i in range(4)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    changes = views.change_events(views.table(spark, str(tmp_path), "events")).where("seq % 29 <> 0")
    judged = ev.outcomes(changes, views.change_target(spark, str(tmp_path)))
    want = {r.seq: r.outcome for r in judged.collect()} | {i: "rejected" for i in range(0, 400, 29)}
    assert {r.seq: r.outcome for r in result_queries.keyed_stream(spark, str(tmp_path)).collect()} == want
    assert {"updated", "skipped_stale", "failed"} <= set(want.values())
