"""A catalog table whose upserts rewrite only the buckets they touch.

Rows lie in one folder per hash bucket of their id.  An upsert reads the touched buckets,
replaces their rows, keeps the result in the checkpoint folder and then overwrites just these
folders.  Applying the same rows again gives the same table, so an upsert that failed half-way is repeated as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from shelfmark import scale
from shelfmark.sources.catalog import upsert

BUCKET = "_bucket"


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, id_col: str = "product_id", buckets: int = 64):
        self.spark, self.path, self.id_col, self.buckets = spark, path.rstrip("/"), id_col, buckets

    @classmethod
    def create(cls, rows: DataFrame, path: str, id_col: str = "product_id", buckets: int = 64) -> BucketedTable:
        table = cls(rows.sparkSession, path, id_col, buckets)
        table._write(rows, "overwrite")
        # An empty file keeps the columns of a table without rows.
        rows.limit(0).write.mode("overwrite").parquet(f"{table.path}-columns")
        return table

    def read(self) -> DataFrame:
        return self._all().drop(BUCKET)

    def holding(self, ids: DataFrame) -> tuple[DataFrame, list[int]]:
        """The rows of every bucket that one of the ids falls into, and these buckets (at most ``buckets`` numbers)."""
        touched = sorted(r[0] for r in ids.select(self._bucket()).distinct().collect())
        return self._all().where(F.col(BUCKET).isin(touched) if touched else F.lit(False)).drop(BUCKET), touched

    def upsert(self, incoming: DataFrame, seq: str = "seq") -> list[int]:
        """Replace or add rows by id, of repeated ids the one with the highest ``seq``; returns the rewritten buckets."""
        current, touched = self.holding(incoming)
        if touched:
            scale.ensure_checkpoint_dir(self.spark)
            # Settled before its own folders are replaced.
            self._write(upsert(current, incoming, self.id_col, seq).checkpoint(eager=True), "overwrite", partitionOverwriteMode="dynamic")
        return touched

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.id_col), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _all(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}-columns").schema.add(BUCKET, IntegerType())
        return self.spark.read.schema(columns).parquet(self.path)

    def _write(self, rows: DataFrame, mode: str, **options: str) -> None:
        # One file a bucket and writing task; rows of a bucket meet in one task unless it is large.
        placed = rows.select("*", self._bucket()).repartition(BUCKET)
        placed.write.mode(mode).options(**options).partitionBy(BUCKET).parquet(self.path)
