"""Change events as a stream.

Every micro-batch is judged by the same operator as the batch replay, against
the versions that earlier batches left behind.  State lives in plain Parquet
folders of the shared ``root``:

``outcomes/epoch=N``  the events of batch N with their outcome
``versions/epoch=N``  the versions batch N accepted, per (product, source)
``snapshot/epoch=N``  now and then: all versions up to and including batch N

A batch that is run again after a failure overwrites its own folders and reads
only older ones, so each event takes effect once.  Late events are judged by
version, not dropped by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from shelfmark.operators import events as ev

VERSION_SCHEMA = "product_id string, source_system string, version bigint, epoch bigint"


class StreamReplay:
    """Applies a stream of change events to a catalog."""

    def __init__(self, catalog: DataFrame, root: str, snapshot_every: int = 50):
        self.catalog, self.root, self.snapshot_every = catalog, root.rstrip("/"), snapshot_every
        self.spark: SparkSession = catalog.sparkSession

    def start(self, events: DataFrame, available_now: bool = False, **trigger) -> StreamingQuery:
        """Begin; ``events`` is a streaming table with the event columns and ``seq``."""
        writer = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/progress")
        if available_now:
            trigger = {"availableNow": True}
        return (writer.trigger(**trigger) if trigger else writer).start()

    def apply(self, batch: DataFrame, epoch: int) -> None:
        known = self.catalog.select("product_id", "source_versions")
        judged = ev.outcomes(batch, self._with_versions(known, batch, epoch))
        self._write(judged, "outcomes", epoch)
        done = self.spark.read.parquet(f"{self.root}/outcomes/epoch={epoch}")
        fresh = done.where(F.col("outcome") == "updated").groupBy("product_id", "source_system").agg(
            F.max("source_version").alias("version"))
        self._write(fresh, "versions", epoch)
        if self.snapshot_every and (epoch + 1) % self.snapshot_every == 0:
            self._write(self.versions(epoch + 1), "snapshot", epoch)

    def versions(self, before: int) -> DataFrame:
        """Newest accepted version per (product, source) of the batches before ``before``."""
        snapshots = [e for e in self._epochs("snapshot") if e < before]
        base = max(snapshots, default=-1)
        parts = [f"{self.root}/versions/epoch={e}" for e in self._epochs("versions") if base < e < before]
        if snapshots:
            parts.append(f"{self.root}/snapshot/epoch={base}")
        if not parts:
            return self.spark.createDataFrame([], "product_id string, source_system string, version bigint")
        return self.spark.read.parquet(*parts).groupBy("product_id", "source_system").agg(
            F.max("version").alias("version"))

    def outcomes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/outcomes")

    def current_catalog(self, as_of) -> DataFrame:
        """The catalog with everything accepted so far applied."""
        return ev.replay(self.catalog, self.outcomes().drop("epoch"), as_of)

    def _with_versions(self, known: DataFrame, batch: DataFrame, epoch: int) -> DataFrame:
        """Catalog versions overlaid with the accepted ones, for the batch's products."""
        touched = batch.select("product_id").distinct()
        fresh = self.versions(epoch).join(touched, "product_id", "left_semi").groupBy("product_id").agg(
            F.map_from_entries(F.collect_list(F.struct("source_system", F.col("version").cast("string")))).alias("_new"))
        rows = known.join(touched, "product_id", "left_semi").join(fresh, "product_id", "left")
        return rows.select("product_id", ev.overlay(F.col("source_versions"), F.col("_new")).alias("source_versions"))

    def _write(self, df: DataFrame, name: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/epoch={epoch}")

    def _epochs(self, name: str) -> list[int]:
        """Epoch numbers whose folder was completely written."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        pattern = hadoop.Path(f"{self.root}/{name}/epoch=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def read_event_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Change events as they arrive in a folder of JSON files; each line carries ``seq``."""
    schema = ("event_id string, product_id string, source_system string, event_type string, event_time timestamp, "
              "payload string, source_version bigint, seq bigint")
    return spark.readStream.schema(schema).options(**options).json(folder)
