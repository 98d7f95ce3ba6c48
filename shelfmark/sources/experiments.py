"""The experiment log and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.tune import HEADLINE, best_experiment

SCHEMA = (
    "id string, timestamp string, config struct<strategy:string,field_boosts:map<string,double>>, "
    "metrics map<string,double>, gate_passed boolean, note string, extra map<string,string>")


class ExperimentStore:
    """Append-only JSON-lines log of tried configurations."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, records: DataFrame) -> None:
        records.write.mode("append").option("ignoreNullFields", False).json(self.path)

    def all(self) -> DataFrame:
        """Every record, oldest first; empty before the first append."""
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(self.path).orderBy("timestamp", "id")

    def best(self, metric: str = HEADLINE) -> DataFrame:
        return best_experiment(self.all(), metric)

    def _exists(self) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(conf).exists(path)


class TableExperimentStore:
    """The same interface over a DataFrame kept by the caller (for tests)."""

    def __init__(self, records: DataFrame):
        self.records = records

    def append(self, records: DataFrame) -> None:
        self.records = self.records.unionByName(records)

    def all(self) -> DataFrame:
        return self.records.orderBy("timestamp", "id")

    def best(self, metric: str = HEADLINE) -> DataFrame:
        return best_experiment(self.records, metric)


def write_report(summary: DataFrame, rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report tables as JSON lines under ``summary`` and ``per_query``."""
    summary.orderBy("strategy").coalesce(1).write.mode(mode).json(f"{path}/summary")
    rows.write.mode(mode).json(f"{path}/per_query")


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    def table(name: str) -> DataFrame:
        return spark.read.json(f"{path}/{name}")
    return table("summary"), table("per_query").withColumn("winners", F.coalesce("winners", F.array().cast("array<string>")))
