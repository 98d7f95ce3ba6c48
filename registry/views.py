"""Product, query, judgment and change tables derived from the test tables.

Each view exists twice: as a DataFrame, and as a SQL common table expression
with the same columns for the cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.enrich import index_documents

AS_OF = "2001-10-01 00:00:00"
# What a product of each kind is described as.
KINDS = {
    "plate": "Cast iron cooking plate",
    "rod": "Insulated tent rod",
    "anvil": "Keyboard stand shaped like an anvil",
    "ring": "Bluetooth fitness ring",
    "bolt": "Waterproof bolt for boats",
    "gear": "Running gear",
    "gizmo": "USB-C charger gizmo",
    "widget": "Coffee maker widget",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their sales: the twelve input columns of a product."""
    sales = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("popularity_score"), F.max("l_shipdate").cast("timestamp").alias("updated_at"),
        F.min("l_suppkey").alias("supplier"))
    part = table(spark, sf_dir, "part")
    noun = F.substring_index("p_name", " ", -1)
    text = F.try_element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), noun)
    return part.join(sales, part.p_partkey == sales.l_partkey, "left").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("title"),
        F.concat(F.coalesce(text, noun), F.lit(", size "), F.col("p_size").cast("string")).alias("description"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.create_map(
            F.lit("size"), F.col("p_size").cast("string"),
            F.lit("color"), F.substring_index("p_name", " ", 1),
            F.lit("product_locale"), F.lit("us"),
            F.lit("audience"), F.concat(F.lower("p_type"), F.lit(" buyers, travel , ")),
        ).alias("attributes"),
        F.col("p_retailprice").alias("price"),
        F.lit("USD").alias("currency"),
        F.when(F.col("p_size") > 40, "out_of_stock").when(F.col("p_size") > 30, "limited_stock")
        .otherwise("in_stock").alias("availability"),
        "popularity_score",
        F.concat(F.lit("seller-"), F.col("supplier").cast("string")).alias("seller_id"),
        "updated_at",
    )


_NOUN_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())
PRODUCTS = f"""
sales AS (
  SELECT l_partkey, sum(l_quantity) AS popularity_score, max(l_shipdate) AS updated_at, min(l_suppkey) AS supplier
  FROM lineitem GROUP BY l_partkey),
products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS title,
    coalesce(CASE split_part(p_name, ' ', -1) {_NOUN_SQL} END, split_part(p_name, ' ', -1))
      || ', size ' || CAST(p_size AS VARCHAR) AS description,
    p_brand AS brand, p_type AS category, CAST(p_size AS VARCHAR) AS a_size,
    split_part(p_name, ' ', 1) AS a_color, 'us' AS a_locale,
    lower(p_type) || ' buyers, travel , ' AS a_audience,
    p_retailprice AS price, 'USD' AS currency,
    CASE WHEN p_size > 40 THEN 'out_of_stock' WHEN p_size > 30 THEN 'limited_stock' ELSE 'in_stock' END AS availability,
    popularity_score, 'seller-' || CAST(supplier AS VARCHAR) AS seller_id, updated_at
  FROM part LEFT JOIN sales ON p_partkey = l_partkey)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_documents(products(spark, sf_dir), as_of())


# Fixed values, written out again so that a change in the library shows.
_USE_CASES = [
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


def _use_case_sql() -> str:
    """The use-case list of a product as a SQL expression over ``txt``."""
    rules = []
    for triggers, additions in _USE_CASES:
        test = " OR ".join(f"contains(txt, '{t}')" for t in triggers)
        items = ", ".join(f"'{a}'" for a in additions)
        rules.append(f"CASE WHEN {test} THEN [{items}] ELSE [] END")
    joined = ", ".join(rules)
    named = "list_filter(list_transform(string_split(trim(a_audience), ','), lambda x: trim(x)), lambda x: x <> '')"
    return f"flatten([{joined}, {named}])"


CATALOG = PRODUCTS + f""",
described AS (
  SELECT *, [trim(a_audience), a_color, a_size] AS attr_values,
    lower(title || ' ' || category || ' ' || description || ' ' || trim(a_audience) || ' ' || a_color || ' ' || a_size) AS txt
  FROM products),
cased AS (SELECT *, {_use_case_sql()} AS cases_raw FROM described),
catalog AS (
  SELECT * EXCLUDE (cases_raw, txt),
    list_filter(cases_raw, lambda x, i: list_position(cases_raw, x) = i) AS use_cases,
    title || ' ' || description || ' ' || brand || ' ' || category || ' '
      || a_size || ' ' || a_color || ' ' || a_locale || ' ' || a_audience AS catalog_text,
    'Product: ' || title || '. Brand: ' || brand || '. Category: ' || category || '. Description: ' || description
      || '. Color: ' || a_color || '. Useful for: '
      || array_to_string(list_filter(cases_raw, lambda x, i: list_position(cases_raw, x) = i), ', ')
      || '. Attributes: ' || array_to_string(attr_values, ', ') || '.' AS search_profile
  FROM cased)"""


def catalog_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that occur in the data: names, misspelt names, brands, longer texts."""
    part = table(spark, sf_dir, "part")
    names = part.select("p_name").distinct()
    misspelt = F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)"))
    return (
        names.select(F.concat(F.lit("n:"), "p_name").alias("qid"), F.col("p_name").alias("query"))
        .unionByName(names.select(F.concat(F.lit("t:"), "p_name").alias("qid"), misspelt.alias("query")))
        .unionByName(part.select("p_brand").distinct().select(
            F.concat(F.lit("b:"), "p_brand").alias("qid"), F.col("p_brand").alias("query")))
        .unionByName(part.select("p_name", "p_type").distinct().select(
            F.concat(F.lit("l:"), "p_name", F.lit("|"), "p_type").alias("qid"),
            F.concat("p_name", F.lit(" for "), F.lower("p_type"), F.lit(" use")).alias("query")))
    )


CATALOG_QUERIES = """
queries AS (
  SELECT 'n:' || p_name AS qid, p_name AS query FROM (SELECT DISTINCT p_name FROM part)
  UNION ALL
  SELECT 't:' || p_name, substr(p_name, 1, 1) || substr(p_name, 3) FROM (SELECT DISTINCT p_name FROM part)
  UNION ALL
  SELECT 'b:' || p_brand, p_brand FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL
  SELECT 'l:' || p_name || '|' || p_type, p_name || ' for ' || lower(p_type) || ' use'
  FROM (SELECT DISTINCT p_name, p_type FROM part))"""


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is judged for the queries that come from it; ``query`` is the qid."""
    part = table(spark, sf_dir, "part")
    ids = F.array(
        F.concat(F.lit("n:"), "p_name"), F.concat(F.lit("t:"), "p_name"), F.concat(F.lit("b:"), "p_brand"),
        F.concat(F.lit("l:"), "p_name", F.lit("|"), "p_type"))
    return part.select(
        F.explode(ids).alias("query"), F.col("p_partkey").cast("string").alias("product_id"),
        (F.col("p_size") % 4).cast("int").alias("grade"))


JUDGMENTS = """
judgments AS (
  SELECT unnest(['n:' || p_name, 't:' || p_name, 'b:' || p_brand, 'l:' || p_name || '|' || p_type]) AS query,
    CAST(p_partkey AS VARCHAR) AS product_id, p_size % 4 AS grade
  FROM part)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("product_id"), F.col("text").alias("body"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as timed requests."""
    failed = F.col("event_type") == "error"
    late = failed & (F.get_json_object("props", "$.k").cast("int") < 30)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("strategy"),
        F.col("user_id").cast("string").alias("query"), F.col("value").alias("latency_ms"),
        (~failed).alias("success"), late.alias("timed_out"),
        F.when(late, "Request timed out").when(failed, "Connection refused").alias("error"))


ATTEMPTS = """
attempts AS (
  SELECT 's' || CAST(user_id % 3 AS VARCHAR) AS strategy, CAST(user_id AS VARCHAR) AS query, value AS latency_ms,
    event_type <> 'error' AS success,
    event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 30 AS timed_out
  FROM events)"""


def change_events(events: DataFrame) -> DataFrame:
    """Events read as catalog changes; works on a batch or a streaming table."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "click", "product_title_updated")
        .when((F.col("event_type") == "view") & (k < 50), "product_category_updated")
        .when(F.col("event_type") == "view", "product_availability_updated")
        .when(F.col("event_type") == "purchase", "product_price_updated")
        .when(F.col("event_type") == "signup", "seller_enrichment_updated")
        .when(k < 80, "attributes_updated").otherwise("product_deleted_or_unavailable"))
    text = k.cast("string")
    payload = (
        F.when(F.col("event_type") == "click", F.to_json(F.struct(F.concat(F.lit("T"), text).alias("title"))))
        .when((F.col("event_type") == "view") & (k < 50),
              F.to_json(F.struct(F.concat(F.lit("C"), text).alias("category"))))
        .when(F.col("event_type") == "view", F.lit('{"availability": "limited_stock"}'))
        .when(F.col("event_type") == "purchase",
              F.to_json(F.struct(F.col("value").alias("price"), F.lit("eur").alias("currency"))))
        .when(F.col("event_type") == "signup",
              F.to_json(F.struct(F.concat(F.lit("S"), text).alias("seller_id"), F.col("value").alias("popularity_score"))))
        .when(k < 80, F.to_json(F.struct(F.create_map(
            F.concat(F.lit("a"), (k % 5).cast("string")), F.concat(F.lit("v"), F.col("event_id").cast("string"))
        ).alias("attributes"))))
        .otherwise(F.lit("{}")))
    return events.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("seq"),
        # Some changes name products that the catalog lacks.
        F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("gone-"), F.col("user_id").cast("string"))).otherwise(
            F.col("user_id").cast("string")).alias("product_id"),
        F.col("event_type").alias("source_system"),
        kind.alias("event_type"), F.col("ts").cast("timestamp").alias("event_time"), payload.alias("payload"),
        k.cast("bigint").alias("source_version"))


CHANGES = """
changes AS (
  SELECT event_id AS seq, CASE WHEN event_id % 17 = 0 THEN 'gone-' ELSE '' END || CAST(user_id AS VARCHAR) AS product_id, event_type AS source_system, ts AS event_time,
    value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE WHEN event_type = 'click' THEN 'product_title_updated'
      WHEN event_type = 'view' AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'product_category_updated'
      WHEN event_type = 'view' THEN 'product_availability_updated'
      WHEN event_type = 'purchase' THEN 'product_price_updated'
      WHEN event_type = 'signup' THEN 'seller_enrichment_updated'
      WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 80 THEN 'attributes_updated'
      ELSE 'product_deleted_or_unavailable' END AS kind
  FROM events)"""


def change_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog the changes go to: every customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("product_id"), F.col("c_name").alias("title"),
        F.lit("").alias("description"), F.lit("none").alias("brand"), F.col("c_mktsegment").alias("category"),
        F.create_map(F.lit("a0"), F.lit("old"), F.lit("b"), F.lit("kept")).alias("attributes"),
        F.col("c_acctbal").alias("price"), F.lit("USD").alias("currency"), F.lit("in_stock").alias("availability"),
        F.lit(0.0).alias("popularity_score"), F.lit("none").alias("seller_id"), as_of().alias("updated_at"),
        F.create_map(
            F.lit("click"), F.col("c_nationkey").cast("string"), F.lit("seed"), F.lit("2001-10-01T00:00:00Z"),
        ).alias("source_versions"),
        as_of().alias("indexed_at"))


TARGET = """
target AS (
  SELECT CAST(c_custkey AS VARCHAR) AS product_id, c_name AS title, c_mktsegment AS category, c_acctbal AS price,
    CAST(c_nationkey AS BIGINT) AS click_version
  FROM customer),
judged AS (
  SELECT c.*, t.product_id AS known, t.click_version,
    max(k) OVER (PARTITION BY c.product_id, source_system ORDER BY seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM changes c LEFT JOIN target t ON c.product_id = t.product_id),
outcomes AS (
  SELECT *, CASE WHEN known IS NULL THEN 'failed'
      WHEN greatest(coalesce(seen, -1), CASE WHEN source_system = 'click' THEN click_version ELSE -1 END) >= k
        THEN 'skipped_stale'
      ELSE 'updated' END AS outcome
  FROM judged)"""
