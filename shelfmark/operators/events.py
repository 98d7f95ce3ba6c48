"""Versioned catalog changes: outcomes and the replayed catalog.

Changes apply in arrival order (``seq``).  A change is stale when its source
has already sent an equal or newer version for the product, so the test is a
running maximum per (product, source).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import scale
from shelfmark.functions.enrich import catalog_text, search_profile
from shelfmark.functions.text import parse_version

PAYLOAD = "map<string,string>"
# Text columns an event sets, by event type (fixed values).
TITLE, CATEGORY = "product_title_updated", "product_category_updated"
AVAILABILITY, PRICE = "product_availability_updated", "product_price_updated"
SELLER, ATTRIBUTES = "seller_enrichment_updated", "attributes_updated"
DELETED = "product_deleted_or_unavailable"
EVENT_TYPES = (TITLE, CATEGORY, AVAILABILITY, PRICE, SELLER, ATTRIBUTES, DELETED)
CHANGED = ("title", "category", "availability", "price", "currency", "seller_id", "brand", "popularity_score",
           "attributes")


def partial_columns(events: DataFrame) -> DataFrame:
    """One ``set_<column>`` struct per changed column, null when untouched.

    The struct tells "set to null" from "not set".
    """
    kind, payload = F.col("event_type"), F.col("payload")
    given = F.from_json(payload, PAYLOAD)

    def has(name: str) -> Column:
        return F.coalesce(F.map_contains_key(given, name), F.lit(False))

    def text(name: str) -> Column:
        return F.get_json_object(payload, f"$.{name}")

    def put(condition: Column, value: Column) -> Column:
        return F.when(condition, F.struct(value.alias("v")))

    return events.withColumns({
        "set_title": put(kind == TITLE, text("title")),
        "set_category": put(kind == CATEGORY, text("category")),
        "set_availability": F.when(kind == AVAILABILITY, F.struct(text("availability").alias("v"))).when(
            kind == DELETED, F.struct(F.coalesce(text("availability"), F.lit("discontinued")).alias("v"))),
        "set_price": put(kind == PRICE, text("price").try_cast("double")),
        "set_currency": put((kind == PRICE) & has("currency"), F.upper(text("currency"))),
        "set_seller_id": put((kind == SELLER) & has("seller_id"), text("seller_id")),
        "set_brand": put((kind == SELLER) & has("brand"), text("brand")),
        "set_popularity_score": put(
            (kind == SELLER) & has("popularity_score"), text("popularity_score").try_cast("double")),
        "set_attributes": put(kind == ATTRIBUTES, F.from_json(text("attributes"), PAYLOAD)),
    })


def known_versions(catalog: DataFrame) -> DataFrame:
    """(product_id, source_system, current): the versions the catalog holds."""
    return catalog.select("product_id", F.explode("source_versions").alias("source_system", "text")).select(
        "product_id", "source_system", parse_version(F.col("text")).alias("current"))


def arrival_slices(events: DataFrame, slices: int, rounds: int = 4) -> DataFrame:
    """Events with ``_slice``: successive stretches of the arrival order that hold like numbers of rows.

    The cuts are quantiles of a sketch, so gaps and clusters in ``seq`` do not
    matter.  An exact count checks them: a slice of more than twice its share is
    cut again, unless it holds one ``seq`` only.  Cuts never change an outcome.
    """
    seq = events.select("seq").where("seq IS NOT NULL")

    def quantiles(column: Column, parts: int) -> Column:
        return F.percentile_approx(column, [i / parts for i in range(1, parts)], max(1000, 4 * parts))

    def sliced(df: DataFrame, cuts: list[float]) -> DataFrame:
        ends = [float("-inf"), *cuts, float("inf")]
        if len(ends) < 3:
            return df.withColumn("_slice", F.when(F.col("seq").isNotNull(), F.lit(0)))
        cut = Bucketizer(splits=ends, inputCol="seq", outputCol="_slice", handleInvalid="keep").transform(df)
        return cut.withColumn("_slice", F.when(F.col("seq").isNotNull(), F.col("_slice").cast("int")))

    if slices < 2:
        return sliced(events, [])
    cuts = sorted(set(map(float, seq.agg(quantiles(F.col("seq"), slices)).head()[0] or [])))
    for _ in range(rounds):
        sizes = sliced(seq, cuts).groupBy("_slice").agg(
            F.count(F.lit(1)).alias("n"), (F.min("seq").cast("double") < F.max("seq").cast("double")).alias("several")).collect()
        share = sum(r["n"] for r in sizes) / slices
        large = {r["_slice"]: -int(-r["n"] // share) for r in sizes if r["n"] > 2 * share and r["several"]}
        if not large:
            break
        again = sliced(seq, cuts).where(F.col("_slice").isin(list(large))).groupBy("_slice").agg(
            quantiles(F.col("seq"), max(large.values())).alias("cuts"), F.min("seq").alias("low"))
        # The lowest value can't part a slice, so the next one up does where a quantile falls on it.
        more = {float(c) if c > r["low"] else float(c) + 1 for r in again.collect() for c in r["cuts"]}
        if more <= set(cuts):
            break
        cuts = sorted({*cuts, *more})
    return sliced(events, cuts)


def outcomes(events: DataFrame, catalog: DataFrame, slices: int | None = None) -> DataFrame:
    """Events with ``outcome`` updated / skipped_stale / failed.

    The running maximum is taken in two steps: inside a slice of the arrival
    order, and over the slices' own maxima (about ``slices`` rows per product
    and source).  Slices hold like numbers of rows (``arrival_slices``).  A product with a large share of all changes is thereby spread
    over the slices (by default as many as shuffle partitions) instead of being
    sorted in one task.  Catalog facts join the maxima, not the changes.
    """
    slices = slices or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = arrival_slices(events, slices)

    key = ["product_id", "source_system"]
    in_slice = Window.partitionBy(*key, "_slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    running = sliced.withColumn("_in_slice", F.max("source_version").over(in_slice))
    tops = sliced.groupBy(*key, "_slice").agg(F.max("source_version").alias("top"))
    over_slices = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = tops.withColumn("_start", F.max("top").over(over_slices)).drop("top")
    ids = catalog.select("product_id", F.lit(True).alias("_known"))
    starts = starts.join(ids, "product_id", "left").join(known_versions(catalog), key, "left")

    joined = running.join(starts, [*key, "_slice"], "left")
    newest = F.greatest("_in_slice", "_start", "current")
    return joined.withColumn(
        "outcome",
        F.when(F.col("_known").isNull(), "failed")
        .when(newest >= F.col("source_version"), "skipped_stale")
        .otherwise("updated"),
    ).drop("_slice", "_in_slice", "_start", "current", "_known")


def replay_summary(judged: DataFrame) -> DataFrame:
    """Processed, updated, skipped and failed counts."""
    def count(name: str) -> Column:
        return F.coalesce(F.sum((F.col("outcome") == name).cast("bigint")), F.lit(0))

    return judged.agg(
        F.count(F.lit(1)).alias("processed"), count("updated").alias("updated"),
        count("skipped_stale").alias("skipped_stale"), count("failed").alias("failed"))


def replay(
    catalog: DataFrame, judged: DataFrame, as_of: Column,
    replace_attributes: bool = False, refresh_derived: bool = False,
) -> DataFrame:
    """The catalog after the accepted changes.

    Every changed column keeps the last accepted value by arrival; attributes
    merge key by key unless ``replace_attributes``.  Latest values combine
    before the shuffle, so a hot product costs one row per task.
    """
    accepted = partial_columns(judged.where(F.col("outcome") == "updated"))
    plain = [c for c in CHANGED if c != "attributes" and c in catalog.columns]
    # First per source, then per product: gives the versions and the last values
    # in one pass.  A struct led by ``seq`` is greatest for the latest change.
    def latest(name: str) -> Column:
        return F.max(F.col(name)).alias(name)

    per_source = accepted.groupBy("product_id", "source_system").agg(
        F.max("source_version").cast("string").alias("version"),
        F.max(F.struct("seq", "event_time")).alias("_time"),
        *(F.max(F.when(F.col(f"set_{c}").isNotNull(), F.struct("seq", f"set_{c}.v"))).alias(f"set_{c}") for c in plain))
    changes = per_source.groupBy("product_id").agg(
        F.map_from_entries(F.collect_list(F.struct("source_system", "version"))).alias("_versions"),
        F.max("_time")["event_time"].alias("_event_time"), *(latest(f"set_{c}") for c in plain))
    if "attributes" in catalog.columns and replace_attributes:
        whole = accepted.where(F.col("set_attributes").isNotNull()).groupBy("product_id").agg(
            F.max_by("set_attributes", "seq").alias("_attrs"))
        changes = changes.join(whole, "product_id", "left")
    if "attributes" in catalog.columns and not replace_attributes:
        merged = accepted.where(F.col("set_attributes").isNotNull()).select(
            "product_id", "seq", F.explode("set_attributes.v").alias("key", "value")
        ).groupBy("product_id", "key").agg(F.max_by(F.struct("value"), "seq").alias("value")).groupBy("product_id").agg(
            F.map_from_entries(F.collect_list(F.struct("key", "value.value"))).alias("_merged"))
        changes = changes.join(merged, "product_id", "left")

    # Measured: a small set of changes leaves the catalog where it is.
    joined = scale.join_settled(catalog, scale.settle(changes), ["product_id"], "left")
    touched = F.col("_event_time").isNotNull()
    new = {
        c: F.when(F.col(f"set_{c}").isNotNull(), F.col(f"set_{c}.v").cast(catalog.schema[c].dataType)).otherwise(F.col(c))
        for c in plain
    }
    if "attributes" in catalog.columns:
        new["attributes"] = (
            F.when(F.col("_attrs").isNotNull(), F.col("_attrs.v")).otherwise(F.col("attributes")) if replace_attributes
            else overlay(F.col("attributes"), F.col("_merged")))
    new["source_versions"] = overlay(F.col("source_versions"), F.col("_versions"))
    if "updated_at" in catalog.columns:
        new["updated_at"] = F.coalesce("_event_time", "updated_at")
    if "indexed_at" in catalog.columns:
        new["indexed_at"] = F.when(touched, as_of).otherwise(F.col("indexed_at"))
    out = joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in catalog.columns))
    if refresh_derived:
        out = out.withColumns({
            "catalog_text": catalog_text(*(F.col(c) for c in ("title", "description", "brand", "category", "attributes"))),
            "search_profile": search_profile(out),
        })
    return out


def overlay(old: Column, new: Column) -> Column:
    """Keys of ``new`` replace those of ``old``."""
    base = F.coalesce(old, F.create_map().cast(PAYLOAD))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(new, k))
    return F.when(new.isNull(), old).otherwise(F.map_concat(kept, new))
