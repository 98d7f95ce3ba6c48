"""Derived product text: catalog text, search profile, embedding text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import let, non_empty, plain, stringify, strip, utc_text

# When a trigger occurs in the product text, its use cases apply.
USE_CASE_RULES = [
    (("headphone", "noise cancel", "bluetooth"), ["travel", "office", "commuting", "music"]),
    (("mouse", "keyboard", "computer accessories"), ["work", "gaming", "home office"]),
    (("backpack", "laptop", "waterproof"), ["commuting", "school", "travel", "laptop carry"]),
    (("coffee", "espresso", "maker"), ["coffee", "kitchen", "morning routine", "coffee machine"]),
    (("charger", "power bank", "usb-c", "usb c"), ["laptop charging", "travel", "mobile devices"]),
    (("water bottle", "travel mug", "insulated"), ["hydration", "gym", "commuting", "outdoors"]),
    (("cast iron", "skillet", "cookware"), ["camping", "stovetop", "oven cooking"]),
    (("smartwatch", "running", "fitness"), ["running", "training", "fitness"]),
    (("ebook", "e-reader", "reader", "waterproof"), ["reading", "travel", "beach", "commuting"]),
    (("speaker", "ssd", "airtag", "tracker"), ["gift", "gamer", "tech gift"]),
    (("skin care", "serum", "ordinary"), ["self care", "beauty", "skin routine"]),
]
AUDIENCE_KEYS = ("target_audience", "audience", "use_case")
LOCALE_KEY = "product_locale"


def attribute(attributes: Column, key: str) -> Column:
    return F.try_element_at(attributes, F.lit(key))


def catalog_text(title: Column, description: Column, brand: Column, category: Column, attributes: Column) -> Column:
    """All non-empty text of a product, attribute values in stored order."""
    values = F.array_join(F.map_values(attributes), " ", "None")
    return F.concat_ws(" ", *(non_empty(c) for c in (title, description, brand, category, values)))


def embedding_text(title: Column, brand: Column, category: Column, description: Column) -> Column:
    """Text that is embedded."""
    return F.concat_ws(" ", *(non_empty(c) for c in (title, brand, category, description)))


def attribute_values(attributes: Column) -> Column:
    """Trimmed attribute values by key order, without empties and the locale."""
    pairs = F.array_sort(F.map_entries(attributes))
    texts = F.transform(
        F.filter(pairs, lambda e: e["key"] != LOCALE_KEY), lambda e: stringify(e["value"])
    )
    return F.coalesce(F.filter(texts, lambda v: v != ""), F.array().cast("array<string>"))


def use_cases(title: Column, category: Column, description: Column, attributes: Column) -> Column:
    """Inferred then explicit use cases, first-seen order, no repeats (P5)."""
    values = F.array_join(attribute_values(attributes), " ")
    text = F.lower(F.concat(
        plain(title), F.lit(" "), plain(category), F.lit(" "), plain(description), F.lit(" "), values))
    empty = F.array().cast("array<string>")

    def inferred(t: Column) -> Column:
        lists = []
        for triggers, additions in USE_CASE_RULES:
            fires = F.contains(t, F.lit(triggers[0]))
            for trigger in triggers[1:]:
                fires = fires | F.contains(t, F.lit(trigger))
            lists.append(F.when(fires, F.array(*map(F.lit, additions))).otherwise(empty))
        return F.concat(*lists)

    explicit = stringify(F.coalesce(*(non_empty(attribute(attributes, key)) for key in AUDIENCE_KEYS)))
    named = F.filter(F.transform(F.split(explicit, ","), strip), lambda v: v != "")
    return F.array_distinct(F.concat(let(text, inferred), named))


def search_profile(df: DataFrame) -> Column:
    """Labelled sentences in fixed order, empty ones left out.

    Reads the columns that exist: ``title`` falls back to ``name``; colour,
    material and tags come from the attributes, else from columns of that name.
    """
    def column(name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    attributes = (
        F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>"))
        if "attributes" in df.columns else F.create_map().cast("map<string,string>")
    )
    title = plain(F.coalesce(non_empty(column("title")), column("name")))
    brand, category, description = (plain(column(c)) for c in ("brand", "category", "description"))

    def either(name: str) -> Column:
        return stringify(F.coalesce(non_empty(attribute(attributes, name)), column(name)))

    sentences = [
        ("Product", title),
        ("Brand", brand),
        ("Category", category),
        ("Description", description),
        ("Color", either("color")),
        ("Material", either("material")),
        ("Useful for", F.array_join(use_cases(title, category, description, attributes), ", ")),
        ("Tags", either("tags")),
        ("Attributes", F.array_join(attribute_values(attributes), ", ")),
    ]
    def sentence(label: str, value: Column) -> Column:
        return let(value, lambda v: F.when(v != "", F.concat(F.lit(f"{label}: "), v, F.lit("."))))

    return F.concat_ws(" ", *(sentence(label, value) for label, value in sentences))


def index_documents(products: DataFrame, as_of: Column, source: str = "sample_jsonl") -> DataFrame:
    """Products plus every derived column of the catalog."""
    attributes = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    return products.withColumns({
        "catalog_text": catalog_text(
            F.col("title"), F.col("description"), F.col("brand"), F.col("category"), attributes),
        "search_profile": search_profile(products),
        "source_versions": F.create_map(F.lit(source), utc_text(F.col("updated_at"))),
        "indexed_at": as_of,
    })


def shaped_product(df: DataFrame) -> list[Column]:
    """Result columns with defaults and public names."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    empty = F.create_map().cast("map<string,string>")
    updated = utc_text(F.col("updated_at").cast("timestamp")) if "updated_at" in df.columns else F.lit("")
    return [
        text("product_id").alias("productId"),
        text("title").alias("title"),
        text("description").alias("description"),
        text("brand").alias("brand"),
        text("category").alias("category"),
        (F.coalesce("attributes", empty) if "attributes" in df.columns else empty).alias("attributes"),
        number("price").alias("price"),
        text("currency").alias("currency"),
        text("availability").alias("availability"),
        number("popularity_score").alias("popularityScore"),
        text("seller_id").alias("sellerId"),
        F.coalesce(updated, F.lit("")).alias("updatedAt"),
    ]
