"""Change events as a stream with keyed state.

Spark's state store holds, per product, the newest version seen from each source.  The versions
that the catalog held at the first start are stored beside it and meet only the keys that a batch asks for.
Events are checked first; broken ones go to quarantine and touch no state.

Arrival numbers are cut into slices of fixed width.  Every input partition reduces its
events to the newest version per (product, source, slice), and only these maxima, a few numbers
whatever the number of events, are grouped by product and meet the state, which answers each
slice with the newest version before it.  Events themselves are never gathered by key: in the batch
they look back inside their slice and at the slice's answer.  A product with a third of all
changes is thereby spread over its slices.

Each micro-batch writes its judged events under ``outcomes/epoch=N`` (with the broken ones, and
their errors, as ``rejected``) and rewrites the touched buckets of the catalog.  A batch that is run again
overwrites its own folder and sets the same values, so each event takes effect once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from shelfmark.operators import events as ev
from shelfmark.operators.validate import event_errors
from shelfmark.sources.buckets import BucketedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["product_id", "source_system"]
SLICE = "_slice"


class _Versions(StatefulProcessor):
    """State: the newest version of one product by source.  Answers each slice with the newest version before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "versions map<string,bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        tops: dict[tuple[str, int], int] = {}
        for row in rows:
            place = (row["source_system"], row[SLICE])
            tops[place] = max(row["top"], tops.get(place, row["top"]))
        newest = dict(self.newest.get()[0]) if self.newest.exists() else {}
        for source, number in sorted(tops):
            before = newest.get(source)
            yield Row(product_id=key[0], source_system=source, _slice=number, start=before)
            newest[source] = tops[source, number] if before is None else max(before, tops[source, number])
        self.newest.update((newest,))

    def close(self) -> None:
        pass


def _tops(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The newest version per key and slice of each piece of a partition."""
    for part in parts:
        yield part.groupby([*KEY, SLICE], as_index=False)["source_version"].max().rename(columns={"source_version": "top"})


class KeyedReplay:
    """Applies a stream of change events to a bucketed catalog.

    ``as_of`` gives the time that applied rows are stamped with.
    """

    def __init__(self, catalog: BucketedTable, root: str, as_of: Callable[[], Column], slice_width: int = 100_000):
        self.catalog, self.root, self.as_of, self.slice_width = catalog, root.rstrip("/"), as_of, slice_width
        self.spark: SparkSession = catalog.spark

    def start(self, events: DataFrame, available_now: bool = False, **trigger) -> StreamingQuery:
        """Begin, or go on where the last run under this root ended.

        ``events`` is a streaming table with the event columns (``event_time`` as text with its zone) and ``seq``.
        """
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        checked = event_errors(events).withColumn(SLICE, F.floor(F.col("seq") / F.lit(self.slice_width)))
        good = checked.where(F.size("errors") == 0).select(*KEY, SLICE, "source_version")
        tops = good.mapInPandas(_tops, f"product_id string, source_system string, {SLICE} bigint, top bigint")
        self._keep_seeds()
        starts = tops.groupBy("product_id").transformWithState(
            _Versions(), f"product_id string, source_system string, {SLICE} bigint, start bigint", "Append", "None")
        both = checked.withColumn("_event", F.lit(True)).unionByName(starts.withColumn("_event", F.lit(False)), allowMissingColumns=True)
        writer = both.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/progress")
        if available_now:
            trigger = {"availableNow": True}
        return (writer.trigger(**trigger) if trigger else writer).start()

    def _keep_seeds(self) -> None:
        """Store the catalog's versions before the first batch changes them; later starts and repeated batches find the same."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/seeds/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            seeds = ev.known_versions(self.catalog.read()).where("current IS NOT NULL")
            seeds.groupBy(*KEY).agg(F.max("current").alias("seed")).write.mode("overwrite").parquet(f"{self.root}/seeds")

    def apply(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        arrived = f"{self.root}/arrived/epoch={epoch}"
        batch.write.mode("overwrite").parquet(arrived)  # the state is asked once
        rows = spark.read.schema(batch.schema).parquet(arrived)
        events, starts = rows.where("_event").drop("_event", "start"), rows.where("NOT _event").select(*KEY, SLICE, "start")
        seeds = spark.read.schema("product_id string, source_system string, seed bigint").parquet(f"{self.root}/seeds")
        starts = starts.join(seeds, KEY, "left").withColumn("start", F.greatest("start", "seed")).drop("seed")
        current, _ = self.catalog.holding(events.where("size(errors) = 0"))
        done = f"{self.root}/outcomes/epoch={epoch}"
        judge(events, starts, current).write.mode("overwrite").parquet(done)
        judged = spark.read.parquet(done)
        changed = judged.where("outcome = 'updated'")
        touched = current.join(changed.select("product_id").distinct(), "product_id", "left_semi")
        fresh = ev.replay(touched, judged, self.as_of())
        self.catalog.upsert(fresh.withColumn("seq", F.lit(0)))

    def outcomes(self) -> DataFrame:
        """All judged events; those that break a rule have their ``errors`` and the outcome ``rejected``."""
        return self.spark.read.parquet(f"{self.root}/outcomes")

    def quarantine(self) -> DataFrame:
        return self.outcomes().where("outcome = 'rejected'")


def judge(events: DataFrame, starts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Outcome of each event of a batch, from what precedes it in its slice and the slice's start."""
    bad = F.size("errors") > 0
    earlier = Window.partitionBy(*KEY, SLICE, bad).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    looked = events.withColumn("_before", F.max("source_version").over(earlier)).join(starts, [*KEY, SLICE], "left").join(
        catalog.select("product_id", F.lit(True).alias("_known")), "product_id", "left")
    return looked.withColumn(
        "outcome",
        F.when(bad, "rejected").when(F.col("_known").isNull(), "failed")
        .when(F.greatest("_before", "start") >= F.col("source_version"), "skipped_stale").otherwise("updated"),
    ).drop("_before", "start", "_known", SLICE)
