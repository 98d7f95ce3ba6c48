"""The catalog table: upserts, partial updates and lookups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import scale

RETRYABLE = (429, 503)


def upsert(current: DataFrame, incoming: DataFrame, id_col: str = "product_id", seq: str = "seq") -> DataFrame:
    """Full rows replaced by id; of repeated ids the highest ``seq`` wins.

    Writing the same rows again changes nothing.  The incoming side is reduced
    and measured first: while it is small the current table is not moved.
    """
    columns = [c for c in current.columns if c != id_col]
    latest = scale.settle(
        incoming.groupBy(id_col).agg(F.max_by(F.struct(*columns), seq).alias("row")).select(id_col, "row.*"))
    replaced = replace(latest, df=latest.df.select(id_col))
    kept = scale.join_settled(current, replaced, [id_col], "left_anti")
    return kept.unionByName(latest.df.select(*current.columns))


def upsert_summary(incoming: DataFrame, checked_errors: str = "errors") -> DataFrame:
    """How many incoming rows were indexed and how many failed validation."""
    failed = F.size(checked_errors) > 0
    return incoming.agg(
        F.coalesce(F.sum((~failed).cast("bigint")), F.lit(0)).alias("indexed"),
        F.coalesce(F.sum(failed.cast("bigint")), F.lit(0)).alias("failed"))


def write_outcome(status: Column) -> Column:
    """ok, retryable or failed by status code; no status is a failure."""
    return (
        F.when(status.between(200, 299), "ok")
        .when(status.isin(*RETRYABLE), "retryable")
        .otherwise("failed")
    )


def outcome_counts(sent: DataFrame, responses: DataFrame, on: str = "product_id") -> DataFrame:
    """Rows per write outcome; sent rows without a response count as failed."""
    joined = sent.select(on).join(responses.select(on, "status"), on, "left")
    return joined.groupBy(write_outcome(F.col("status")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


def update_column(
    catalog: DataFrame, updates: DataFrame, column: str = "embedding", id_col: str = "product_id", seq: str = "seq",
) -> tuple[DataFrame, DataFrame]:
    """The catalog with one column replaced, and the updates of unknown ids.

    Of repeated ids the update with the highest ``seq`` wins; without such a column
    the updates must not repeat an id in different versions.
    """
    value = F.struct(F.col(column).alias("v"))
    if seq in updates.columns:
        newest = F.max_by(value, seq)
    else:
        version = F.xxhash64(column)
        clash = F.raise_error(F.format_string("updates of %s differ and have no order", F.first(F.col(id_col).cast("string"))))
        newest = F.when(F.min(version) == F.max(version), F.first(value)).otherwise(clash.cast(updates.select(value.alias("v")).schema["v"].dataType))
    new = updates.groupBy(id_col).agg(newest.alias("_new"))
    joined = catalog.join(new, id_col, "left")
    old = F.col(column) if column in catalog.columns else F.lit(None)
    value = F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(old).alias(column)
    kept = [F.col(c) for c in catalog.columns if c != column]
    failed = updates.join(catalog.select(id_col), id_col, "left_anti")
    return joined.select(*kept, value), failed


def lookup(catalog: DataFrame, product_id: str, id_col: str = "product_id") -> DataFrame:
    """The row of one id; an unknown id gives an empty table."""
    return catalog.where(F.col(id_col) == product_id)


def multi_get(lists: DataFrame, catalog: DataFrame, ids: str = "ids", id_col: str = "product_id") -> DataFrame:
    """Catalog rows for every id of every list with its position; unknown ids drop out."""
    keep = [c for c in lists.columns if c != ids]
    return lists.select(*keep, F.posexplode(ids).alias("pos", id_col)).join(catalog, id_col)
