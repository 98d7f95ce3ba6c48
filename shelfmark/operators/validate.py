"""Validation rules as columns: bad rows are marked, never lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import strip
from shelfmark.operators import events as ev
from shelfmark.plans.strategies import DEFAULT_STRATEGY, EVALUATED, MAX_SIZE

# Fixed values.
AVAILABILITY = ("in_stock", "limited_stock", "backorder", "out_of_stock", "discontinued")
REQUIRED_PAYLOAD = {
    ev.TITLE: ["title"],
    ev.CATEGORY: ["category"],
    ev.AVAILABILITY: ["availability"],
    ev.PRICE: ["price"],
    ev.ATTRIBUTES: ["attributes"],
}
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|z|[+-]\d{2}:?\d{2})$"


def zoned_timestamp(text: Column) -> Column:
    """UTC timestamp of a text that names its zone, else null."""
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text))


def _errors(rules: dict[str, Column]) -> Column:
    """Names of the broken rules; a rule that is null counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def _filled(name: str) -> Column:
    return F.length(F.col(name)) > 0


def product_errors(df: DataFrame) -> DataFrame:
    """Adds ``errors`` for the product rules and normalises the row.

    ``updated_at`` is text on input and a timestamp on output; an optional
    ``extra_fields`` column (array) lists input fields that are not allowed, and
    ``wrong_types`` (array) those whose value has another type.
    """
    rules = {name: _filled(name) for name in ("product_id", "title", "brand", "category", "seller_id")}
    rules |= {
        # Spark counts NaN as larger than any number.
        "price": (F.col("price") >= 0) & ~F.isnan("price"),
        "popularity_score": (F.col("popularity_score") >= 0) & ~F.isnan("popularity_score"),
        "currency": F.length("currency") == 3,
        "availability": F.col("availability").isin(*AVAILABILITY),
        "updated_at": zoned_timestamp(F.col("updated_at")).isNotNull(),
    }
    if "extra_fields" in df.columns:
        rules["extra_fields"] = F.size(F.coalesce("extra_fields", F.array().cast("array<string>"))) == 0
    if "wrong_types" in df.columns:
        rules["wrong_types"] = F.size("wrong_types") == 0
    changed = {
        "currency": F.upper("currency"),
        "updated_at": zoned_timestamp(F.col("updated_at")),
    }
    if "description" in df.columns:
        changed["description"] = F.coalesce("description", F.lit(""))
    return df.withColumn("errors", _errors(rules)).withColumns(changed)


def event_errors(df: DataFrame) -> DataFrame:
    """Adds ``errors`` for the change-event rules and parses the time."""
    payload = F.coalesce(F.col("payload"), F.lit("{}"))
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    required = F.lit(None).cast("array<string>")
    for kind, names in REQUIRED_PAYLOAD.items():
        required = F.when(F.col("event_type") == kind, F.array(*map(F.lit, names))).otherwise(required)
    missing = F.array_except(F.coalesce(required, F.array().cast("array<string>")), keys)
    price = F.get_json_object(payload, "$.price").try_cast("double")
    text_set = (
        F.when(F.col("event_type") == ev.TITLE, F.get_json_object(payload, "$.title"))
        .when(F.col("event_type") == ev.CATEGORY, F.get_json_object(payload, "$.category"))
        .when(F.col("event_type") == ev.AVAILABILITY, F.get_json_object(payload, "$.availability"))
        .otherwise(F.lit(""))
    )
    attributes = F.ltrim(F.get_json_object(payload, "$.attributes"))
    rules = {name: _filled(name) for name in ("event_id", "product_id", "source_system")}
    rules |= {
        "event_type": F.col("event_type").isin(*ev.EVENT_TYPES),
        "event_time": zoned_timestamp(F.col("event_time")).isNotNull(),
        "source_version": F.col("source_version") >= 0,
        "payload": F.json_object_keys(payload).isNotNull(),
        "required_payload": F.size(missing) == 0,
        "null_payload": (F.size(missing) > 0) | text_set.isNotNull(),
        "attributes_object": (F.col("event_type") != ev.ATTRIBUTES) | F.coalesce(attributes.startswith("{"), F.lit(False)),
        "price": (F.col("event_type") != ev.PRICE) | (price >= 0),
    }
    if "extra_fields" in df.columns:
        rules["extra_fields"] = F.size(F.coalesce("extra_fields", F.array().cast("array<string>"))) == 0
    if "wrong_types" in df.columns:
        rules["wrong_types"] = F.size("wrong_types") == 0
    return df.withColumn("errors", _errors(rules)).withColumn("event_time", zoned_timestamp(F.col("event_time")))


def request_errors(requests: DataFrame) -> DataFrame:
    """Search-request rules; the query is trimmed and defaults are filled in."""
    def has(name: str) -> bool:
        return name in requests.columns

    df = requests.withColumn("query", strip("query"))
    df = df.withColumn("strategy", F.coalesce("strategy", F.lit(DEFAULT_STRATEGY)) if has("strategy") else F.lit(DEFAULT_STRATEGY))
    df = df.withColumn("size", F.coalesce("size", F.lit(10)) if has("size") else F.lit(10))
    rules = {
        "query": F.length("query") > 0,
        "strategy": F.col("strategy").isin(*EVALUATED),
        "size": F.col("size").between(1, MAX_SIZE),
    }
    for name in ("f_min_price", "f_max_price"):
        if has(name):
            rules[name] = F.col(name).isNull() | (F.col(name) >= 0)
    if has("f_min_price") and has("f_max_price"):
        rules["price_range"] = F.coalesce(F.col("f_min_price") <= F.col("f_max_price"), F.lit(True))
    return df.withColumn("errors", _errors(rules))


def embedding_errors(df: DataFrame, column: str = "embedding", dims: int = 384) -> DataFrame:
    """Adds ``errors`` naming the vector rule when the length is wrong."""
    return df.withColumn("errors", _errors({"embedding": F.size(column) == dims}))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0)


def required(checked: DataFrame, where: str = "row") -> DataFrame:
    """Strict mode: the first bad row read fails the job."""
    message = F.concat(F.lit(f"Invalid {where} "), F.coalesce(
        F.col("line_no").cast("string") if "line_no" in checked.columns else F.lit("?"), F.lit("?")),
        F.lit(": "), F.array_join("errors", ", "))
    guard = F.when(F.size("errors") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return checked.where(guard).drop("errors")
