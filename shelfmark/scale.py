"""Size checks: what may be broadcast, and what has to be shuffled instead.

A side is broadcast only after its real size was measured against a bound.
``settle`` writes an intermediate table to the session's checkpoint folder (a
reliable, shared location, so a lost executor loses nothing), which also makes
measuring it cheap and stops it from being computed twice.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes (as JSON text) up to which a side may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
# Copies of the small side in a salted join that cannot broadcast.
SALTS = 32


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured


@dataclass(frozen=True)
class Settled:
    """A checkpointed table with its measured size."""

    df: DataFrame
    rows: int
    bytes: int

    def fits(self, bound: int | None = None) -> bool:
        return self.bytes <= (BROADCAST_BYTES if bound is None else bound)


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and text bytes of a table, in one aggregate."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b"),
    ).head()
    return int(row["n"]), int(row["b"])


def settle(df: DataFrame) -> Settled:
    ensure_checkpoint_dir(df.sparkSession)
    stored = df.checkpoint(eager=True)
    rows, size = measure(stored)
    return Settled(stored, rows, size)


def join_settled(
    big: DataFrame,
    small: Settled,
    on: list[str],
    how: str = "inner",
    salt_by: str | None = None,
    bound: int | None = None,
) -> DataFrame:
    """Join a large table with a settled one.

    Within the bound the settled side is broadcast and the large side keeps its
    partitioning.  Beyond it both sides are shuffled on the keys plus a salt
    taken from ``salt_by`` (a high-cardinality column of the large side), so a
    key that holds a large share of the rows is spread over ``SALTS`` tasks.
    """
    if small.fits(bound):
        return big.join(F.broadcast(small.df), on, how)
    if salt_by is None:
        return big.join(small.df, on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    copies = small.df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


# Below this many estimated bytes per core a table is spread before heavy work.
SPREAD_BYTES = 16 * 1024 * 1024


def spread(df: DataFrame, bound: int | None = None) -> DataFrame:
    """Give every core a share of a small table.

    A table of a few megabytes may come as one unsplittable file, which would
    keep one task busy and the others idle.  Larger tables are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * (SPREAD_BYTES if bound is None else bound) else df


def gather(df: DataFrame, share: int) -> DataFrame:
    """Join the partitions of a table that comes in many small pieces: about ``share`` estimated bytes each, two for every core at least."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    # Estimates of joins may be beyond any number of tasks.
    return df.coalesce(max(2 * cores, min(estimated_bytes(df) // share, 100_000)))


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def by_key(df: DataFrame, key: str, parts: int = 1) -> DataFrame:
    """Hash-partition by a key ahead of steps that multiply the rows.

    The number of partitions is fixed: judged by its input alone such a stage
    looks small and would be merged into too few tasks.  ``parts`` asks for more
    than the session's, where the multiplied rows would not fit a task's memory.
    """
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
