"""Session defaults that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Results depend on the first two; the rest are plan-quality defaults which a
# cluster's own configuration overrides.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "false",
}
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    # One task per core: a task's matrix products start no threads of their own.
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    # Settled tables are removed once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "shelfmark", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; keyword arguments are extra Spark settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
