"""What the operators of this folder share: words, bindings and stored steps."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.scale import ensure_checkpoint_dir

#: One run of the six ASCII white-space characters, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words between ASCII white space; an empty array for a null text.

    The other five separators become spaces first: splitting at one plain character
    is much faster than at a pattern.
    """
    flat = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\f\r", F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(flat, " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole row in one struct beside id and text, so that no name clashes."""
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def with_text(docs: DataFrame, text_col: str, frame: DataFrame, text: Column) -> DataFrame:
    """The original columns of ``frame.row`` with another text (and length, where they have ``n_chars``)."""
    columns = []
    for name in docs.columns:
        if name.lower() == text_col.lower():
            columns.append(text.alias(name))
        elif name.lower() == "n_chars":
            columns.append(F.length(text).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col("row").getField(name).alias(name))
    return frame.select(*columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step as Parquet under the shared checkpoint folder and read it back.

    It cuts the lineage: a lost executor costs no earlier step.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*steps: DataFrame) -> None:
    """Remove stored steps whose last reader has itself been stored; what is not a stored step is left alone."""
    for step in steps:
        path = getattr(step, "_stored_at", None)
        if path:
            spark = step.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
