"""Enrichment, validation, catalog table and dataset queries (P, C, S, D, F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import views as v
from registry.core import query
from registry.text_queries import map_text
from shelfmark.functions import enrich
from shelfmark.functions.text import normalise, token_set, utc_text
from shelfmark.operators import datasets, latency, validate
from shelfmark.sources import catalog as store

CATALOG = f"WITH {v.CATALOG.strip()}"


@query(f"{CATALOG} SELECT product_id, catalog_text FROM catalog")
def catalog_text(spark, d):
    return v.catalog(spark, d).select("product_id", "catalog_text")


@query(f"{CATALOG} SELECT product_id, search_profile FROM catalog")
def search_profile(spark, d):
    return v.catalog(spark, d).select("product_id", "search_profile")


@query(f"{CATALOG} SELECT product_id, array_to_string(use_cases, '|') AS use_cases FROM catalog")
def use_cases(spark, d):
    cases = enrich.use_cases(F.col("title"), F.col("category"), F.col("description"), F.col("attributes"))
    return v.products(spark, d).select("product_id", F.array_join(cases, "|").alias("use_cases"))


@query(f"{CATALOG} SELECT product_id, array_to_string(attr_values, '|') AS attribute_values FROM catalog")
def attribute_values(spark, d):
    return v.products(spark, d).select(
        "product_id", F.array_join(enrich.attribute_values(F.col("attributes")), "|").alias("attribute_values"))


@query(f"{CATALOG} SELECT product_id, title || ' ' || brand || ' ' || category || ' ' || description AS embedding_text FROM catalog")
def embedding_text(spark, d):
    text = enrich.embedding_text(F.col("title"), F.col("brand"), F.col("category"), F.col("description"))
    return v.products(spark, d).select("product_id", text.alias("embedding_text"))


@query(f"""{CATALOG} SELECT product_id,
  'sample_jsonl=' || strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS source_versions,
  '{v.AS_OF.replace(' ', 'T')}Z' AS indexed_at,
  CAST(epoch_us(TIMESTAMP '{v.AS_OF}') - epoch_us(updated_at) AS DOUBLE) / 1000000 AS lag_seconds FROM catalog""")
def index_documents(spark, d):
    rows = latency.ingest_lag(v.catalog(spark, d))
    return rows.select(
        "product_id", map_text("source_versions").alias("source_versions"),
        utc_text(F.col("indexed_at")).alias("indexed_at"), "lag_seconds")


@query(r"""SELECT CAST(doc_id AS VARCHAR) AS product_id,
  CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS distinct_tokens
FROM documents""")
def ascii_token_set(spark, d):
    return v.documents(spark, d).select(
        "product_id", F.size(token_set(F.col("body"))).cast("bigint").alias("distinct_tokens"))


@query("""SELECT strip_accents(lower(word)) AS folded, CAST(count(*) AS BIGINT) AS words FROM (
  SELECT unnest(regexp_extract_all(text, '[a-zA-ZàâäçéèêëîïôöùûüñáíóúÀÂÄÇÉÈÊËÎÏÔÖÙÛÜÑÁÍÓÚ]+')) AS word FROM documents)
GROUP BY 1""")
def keyword_folding(spark, d):
    words = F.regexp_extract_all(
        F.col("body"), F.lit("[a-zA-ZàâäçéèêëîïôöùûüñáíóúÀÂÄÇÉÈÊËÎÏÔÖÙÛÜÑÁÍÓÚ]+"), F.lit(0))
    return v.documents(spark, d).select(F.explode(words).alias("word")).groupBy(
        normalise(F.col("word")).alias("folded")).agg(F.count(F.lit(1)).alias("words"))


RAW_PRODUCTS = f"""{v.PRODUCTS.strip()},
raw AS (SELECT CASE WHEN p_size = 7 THEN '' ELSE product_id END AS product_id, title, brand, category, seller_id,
    CASE WHEN p_size = 9 THEN -price ELSE price END AS price, popularity_score,
    CASE WHEN p_size = 11 THEN 'us' ELSE 'usd' END AS currency,
    CASE WHEN p_size = 13 THEN 'sold' ELSE availability END AS availability,
    strftime(updated_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN p_size = 15 THEN '' WHEN p_size > 25 THEN '+02:00' ELSE 'Z' END AS updated_at,
    updated_at AS local_time, p_size
  FROM products JOIN part ON product_id = CAST(p_partkey AS VARCHAR))"""


def raw_products(spark, d):
    """Products as they arrive: text times, some rows breaking a rule."""
    size = F.try_element_at("attributes", F.lit("size")).cast("int")
    rows = v.products(spark, d).withColumn("p_size", size)
    zone = F.when(F.col("p_size") == 15, "").when(F.col("p_size") > 25, "+02:00").otherwise("Z")
    return rows.withColumns({
        "updated_at": F.concat(F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss"), zone),
        "product_id": F.when(F.col("p_size") == 7, "").otherwise(F.col("product_id")),
        "price": F.when(F.col("p_size") == 9, -F.col("price")).otherwise(F.col("price")),
        "currency": F.when(F.col("p_size") == 11, "us").otherwise("usd"),
        "availability": F.when(F.col("p_size") == 13, "sold").otherwise(F.col("availability")),
    })


@query(f"""WITH {RAW_PRODUCTS}
SELECT product_id, title, upper(currency) AS currency,
  CASE WHEN p_size = 15 THEN NULL WHEN p_size > 25 THEN strftime(local_time - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ')
    ELSE strftime(local_time, '%Y-%m-%dT%H:%M:%SZ') END AS updated_at,
  CASE WHEN product_id = '' THEN 'product_id' WHEN price < 0 THEN 'price' WHEN length(currency) <> 3 THEN 'currency'
    WHEN availability = 'sold' THEN 'availability' WHEN p_size = 15 THEN 'updated_at' ELSE '' END AS errors
FROM raw""")
def product_validation(spark, d):
    checked = validate.product_errors(raw_products(spark, d))
    return checked.select(
        "product_id", "title", "currency", utc_text(F.col("updated_at")).alias("updated_at"),
        F.array_join("errors", ",").alias("errors"))


@query("""WITH raw AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, value FROM events)
SELECT CAST(event_id AS VARCHAR) AS event_id,
  CASE WHEN k < 5 THEN 'event_type' WHEN k < 10 THEN 'event_time' WHEN k < 15 THEN 'source_version'
    WHEN k < 20 THEN 'required_payload' WHEN k < 25 THEN 'null_payload' WHEN k < 30 THEN 'attributes_object'
    WHEN k < 35 THEN 'price' ELSE '' END AS errors FROM raw""")
def event_validation(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    raw = v.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("product_id"),
        F.col("event_type").alias("source_system"),
        F.when(k < 5, "renamed").when(k < 25, "product_title_updated").when(k < 30, "attributes_updated")
        .otherwise("product_price_updated").alias("event_type"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when((k >= 5) & (k < 10), "").otherwise("Z")).alias("event_time"),
        F.when((k >= 10) & (k < 15), -1).otherwise(k).cast("bigint").alias("source_version"),
        F.when((k >= 15) & (k < 20), '{"name": "x"}').when((k >= 20) & (k < 25), '{"title": null}')
        .when((k >= 25) & (k < 30), '{"attributes": 3}').when(k < 30, '{"title": "x"}')
        .when(k < 35, '{"price": -1}').otherwise(F.to_json(F.struct(F.col("value").alias("price")))).alias("payload"))
    return validate.event_errors(raw).select("event_id", F.array_join("errors", ",").alias("errors"))


@query("""WITH raw AS (
  SELECT conv_id, turn, CASE WHEN role = 'system' THEN chr(9) || chr(10) ELSE ' ' || text || chr(160) || chr(9) END AS query,
    CASE role WHEN 'user' THEN 'boosted_bm25' WHEN 'assistant' THEN 'unknown' END AS strategy,
    CAST(turn * 20 AS INTEGER) AS size, CAST(conv_id % 7 AS DOUBLE) - 1 AS low, CAST(turn AS DOUBLE) AS high FROM conversations)
SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qid, trim(query, ' ' || chr(9) || chr(10) || chr(160)) AS query,
  coalesce(strategy, 'enriched_profile') AS strategy,
  array_to_string(list_filter([CASE WHEN trim(query, ' ' || chr(9) || chr(10) || chr(160)) = '' THEN 'query' END,
    CASE WHEN strategy = 'unknown' THEN 'strategy' END, CASE WHEN size < 1 OR size > 50 THEN 'size' END,
    CASE WHEN low < 0 THEN 'f_min_price' END, CASE WHEN low > high THEN 'price_range' END], lambda x: x IS NOT NULL), ',') AS errors
FROM raw""")
def request_validation(spark, d):
    role = F.col("role")
    raw = v.table(spark, d, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        F.when(role == "system", "\t\n").otherwise(F.concat(F.lit(" "), "text", F.lit("\xa0\t"))).alias("query"),
        F.when(role == "user", "boosted_bm25").when(role == "assistant", "unknown").alias("strategy"),
        (F.col("turn") * 20).cast("int").alias("size"),
        (F.col("conv_id") % 7 - 1).cast("double").alias("f_min_price"), F.col("turn").cast("double").alias("f_max_price"))
    return validate.request_errors(raw).select("qid", "query", "strategy", F.array_join("errors", ",").alias("errors"))


@query(f"""WITH {v.PRODUCTS.strip()},
incoming AS (SELECT CAST(l_partkey AS VARCHAR) AS product_id, l_extendedprice AS price,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS n
  FROM lineitem
  UNION ALL SELECT 'new-' || CAST(s_suppkey AS VARCHAR), s_acctbal, 1 FROM supplier)
SELECT coalesce(i.product_id, p.product_id) AS product_id, coalesce(i.price, p.price) AS price
FROM products p FULL OUTER JOIN (SELECT * FROM incoming WHERE n = 1) i ON p.product_id = i.product_id""")
def upsert(spark, d):
    current = v.products(spark, d).select("product_id", "price")
    lines = v.table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("product_id"), F.col("l_extendedprice").alias("price"),
        # Arrival order: order, line, and price for repeated lines.
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000
         + (F.col("l_extendedprice") * 100).cast("bigint")).alias("seq"))
    fresh = v.table(spark, d, "supplier").select(
        F.concat(F.lit("new-"), F.col("s_suppkey").cast("string")).alias("product_id"),
        F.col("s_acctbal").alias("price"), F.lit(1).cast("bigint").alias("seq"))
    return store.upsert(current, lines.unionByName(fresh))


@query("""SELECT outcome, CAST(count(*) AS BIGINT) AS rows FROM (
  SELECT CASE WHEN o.o_orderstatus = 'F' THEN 'ok' WHEN o.o_orderstatus = 'O' AND o.o_totalprice > 250000 THEN 'retryable'
    ELSE 'failed' END AS outcome
  FROM customer c LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus,
    arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey)
GROUP BY outcome""")
def write_outcomes(spark, d):
    sent = v.table(spark, d, "customer").select(F.col("c_custkey").alias("product_id"))
    status = (
        F.when(F.col("o_orderstatus") == "F", 201)
        .when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 250000), 429)
        .when(F.col("o_orderstatus") == "O", 400))
    # One response for each row that was sent: that of the customer's last order.
    responses = v.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("product_id")).agg(F.max_by(status, "o_orderkey").alias("status"))
    return store.outcome_counts(sent, responses)


# Every third vector is updated twice; the later update wins.
_EMB = """SELECT CAST(vec_id AS VARCHAR) AS product_id, CAST(label AS VARCHAR) || CASE WHEN vec_id % 3 = 0 THEN ' again' ELSE '' END AS embedding
  FROM embeddings"""


@query(f"""SELECT p.product_id, e.embedding, FALSE AS failed FROM (SELECT CAST(p_partkey AS VARCHAR) AS product_id FROM part) p
  LEFT JOIN ({_EMB}) e ON p.product_id = e.product_id
UNION ALL
SELECT product_id, embedding, TRUE FROM ({_EMB} UNION ALL
  SELECT CAST(vec_id AS VARCHAR), CAST(label AS VARCHAR) FROM embeddings WHERE vec_id % 3 = 0)
WHERE product_id NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)""")
def partial_update(spark, d):
    catalog = v.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("product_id"))
    updates = v.table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("product_id"), F.col("label").cast("string").alias("embedding"), F.lit(1).alias("seq"))
    second = updates.where("product_id % 3 = 0").withColumns({"embedding": F.concat("embedding", F.lit(" again")), "seq": F.lit(2)})
    done, failed = store.update_column(catalog, updates.unionByName(second))
    return done.withColumn("failed", F.lit(False)).unionByName(failed.drop("seq").withColumn("failed", F.lit(True)))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS list_id, CAST(pos AS BIGINT) AS pos, CAST(p_partkey AS VARCHAR) AS product_id, p_name AS title
FROM (SELECT l_orderkey AS o_orderkey, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM (
  SELECT l_orderkey, list(l_partkey * 2 ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY l_orderkey))
JOIN part ON p_partkey = id""")
def multi_get(spark, d):
    # An order has a handful of lines, so its list is short.
    ids = F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
        lambda x: (x["l_partkey"] * 2).cast("string"))
    lists = v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("list_id")).agg(ids.alias("ids"))
    catalog = v.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("title"))
    return store.multi_get(lists, catalog).select("list_id", F.col("pos").cast("bigint").alias("pos"), "product_id", "title")


RAW_DATASET = """
raw_products AS (
  SELECT doc_id AS seq, source || ':' || CAST(doc_id // 2 AS VARCHAR) AS product_id,
    CASE WHEN lang = 'de' THEN '' ELSE 'Title ' || CAST(doc_id AS VARCHAR) END AS product_title,
    text AS product_description, CASE lang WHEN 'en' THEN 'us' WHEN 'fr' THEN 'EN_US' WHEN 'es' THEN 'es' END AS product_locale
  FROM documents),
raw_examples AS (
  SELECT 'query ' || CAST(doc_id % 50 AS VARCHAR) AS query, source || ':' || CAST(doc_id // 2 AS VARCHAR) AS product_id,
    CASE lang WHEN 'en' THEN 'us' WHEN 'fr' THEN 'EN_US' WHEN 'es' THEN 'es' END AS product_locale,
    CASE quality * 2 + 1 - toxic WHEN 0 THEN 'i' WHEN 1 THEN ' C' WHEN 2 THEN 'Substitute' ELSE 'E' END AS esci_label
  FROM documents JOIN labels USING (doc_id)),
scoped AS (SELECT * FROM raw_examples WHERE product_locale IS NULL OR lower(product_locale) IN ('us', 'en_us', 'en-us')),
sampled AS (SELECT query FROM (SELECT DISTINCT query FROM scoped) ORDER BY md5('7:' || query), query LIMIT 20),
chosen AS (SELECT * FROM scoped WHERE query IN (SELECT query FROM sampled)),
kept AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq DESC) AS n FROM raw_products
    WHERE (product_locale IS NULL OR lower(product_locale) IN ('us', 'en_us', 'en-us'))
      AND product_id IN (SELECT product_id FROM chosen)) WHERE n = 1 ORDER BY product_id LIMIT 100)"""


def raw_dataset(spark, d):
    docs = v.table(spark, d, "documents")
    pid = F.concat(F.col("source"), F.lit(":"), F.floor(F.col("doc_id") / 2).cast("string"))
    locale = F.when(F.col("lang") == "en", "us").when(F.col("lang") == "fr", "EN_US").when(F.col("lang") == "es", "es")
    products = docs.select(
        F.col("doc_id").alias("seq"), pid.alias("product_id"),
        F.when(F.col("lang") == "de", "").otherwise(F.concat(F.lit("Title "), F.col("doc_id").cast("string"))).alias("product_title"),
        F.col("text").alias("product_description"), locale.alias("product_locale"))
    grade = F.col("quality") * 2 + 1 - F.col("toxic")
    examples = docs.join(v.table(spark, d, "labels"), "doc_id").select(
        F.concat(F.lit("query "), (F.col("doc_id") % 50).cast("string")).alias("query"), pid.alias("product_id"),
        locale.alias("product_locale"),
        F.when(grade == 0, "i").when(grade == 1, " C").when(grade == 2, "Substitute").otherwise("E").alias("esci_label"))
    return products, examples


@query(f"WITH {RAW_DATASET.strip()} SELECT query FROM sampled")
def sample_queries(spark, d):
    return datasets.sample_queries(datasets.english_only(raw_dataset(spark, d)[1]), 20)


@query(f"""WITH {RAW_DATASET.strip()}
SELECT product_id, CASE WHEN product_title = '' THEN 'Untitled product' ELSE product_title END AS title,
  md5(trim(product_description, ' ')) AS description_md5, 'unknown' AS brand, 'ESCI Imported Products' AS category,
  'product_color=;product_locale=' || coalesce(product_locale, 'us') AS attributes, updated_at
FROM kept, (SELECT '2026-01-01T00:00:00Z' AS updated_at)""")
def dataset_products(spark, d):
    products, _ = datasets.prepare(*raw_dataset(spark, d), 20, 100)
    return products.select(
        "product_id", "title", F.md5(F.col("description").cast("binary")).alias("description_md5"), "brand", "category",
        map_text("attributes").alias("attributes"), "updated_at")


@query(f"""WITH {RAW_DATASET.strip()}
SELECT query, product_id, esci_label AS label,
  CASE esci_label WHEN 'i' THEN 0 WHEN ' C' THEN 1 WHEN 'Substitute' THEN 2 ELSE 3 END AS grade
FROM chosen WHERE product_id IN (SELECT product_id FROM kept)""")
def dataset_judgments(spark, d):
    return datasets.prepare(*raw_dataset(spark, d), 20, 100)[1]


@query(f"""WITH {RAW_DATASET.strip()}
SELECT query, product_id, arg_max(CASE esci_label WHEN 'i' THEN 0 WHEN ' C' THEN 1 WHEN 'Substitute' THEN 2 ELSE 3 END,
  esci_label) AS grade FROM raw_examples GROUP BY query, product_id""")
def last_judgment(spark, d):
    rows = datasets.transform_judgments(raw_dataset(spark, d)[1])
    return datasets.last_judgment(rows.withColumn("seq", F.col("label")))
