"""Readers, writers and logs over files that Spark derives from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry import views as v
from registry.core import query
from shelfmark import scale
from shelfmark.operators import tune, validate
from shelfmark.sources import catalog as store
from shelfmark.sources import lines
from shelfmark.sources.experiments import ExperimentStore


def fresh(spark, name):
    return f"{scale.ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}/{name}"


def write_lines(rows, key, path):
    """Lines in the order of ``key``, over three files."""
    rows.repartitionByRange(3, key).sortWithinPartitions(key).select("value").write.text(path)


def case(kinds, number, other):
    """One of several texts by a number."""
    out = F.lit(other) if isinstance(other, str) else other
    for k, value in kinds.items():
        out = F.when(number == k, F.lit(value)).otherwise(out)
    return out


def quoted(name):
    return F.concat(F.lit('"'), F.col(name), F.lit('"'))


# Every twelfth size breaks another rule about the JSON type or value of a field.
@query("""SELECT CAST(p_partkey AS VARCHAR) AS product_id,
  CASE p_size % 12 WHEN 1 THEN 'wrong_types' WHEN 2 THEN 'wrong_types' WHEN 3 THEN 'price' WHEN 5 THEN 'wrong_types' WHEN 6 THEN 'wrong_types'
    WHEN 7 THEN 'wrong_types' WHEN 8 THEN 'extra_fields' WHEN 9 THEN 'seller_id' WHEN 10 THEN 'price' WHEN 11 THEN 'popularity_score,wrong_types' ELSE '' END AS errors,
  CASE WHEN p_size % 12 IN (0, 4) THEN CAST(p_size AS DOUBLE) + 0.5 END AS price,
  CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS arrival
FROM part""")
def product_lines(spark, d):
    n = F.col("p_size") % 12
    amount = F.concat(F.col("p_size").cast("string"), F.lit(".5"))
    value = F.concat(
        F.lit('{"product_id": "'), F.col("p_partkey").cast("string"), F.lit('", "title": '), case({1: "5"}, n, quoted("p_name")),
        F.lit(', "brand": '), case({2: '["x"]'}, n, quoted("p_brand")), F.lit(', "category": '), case({6: "true"}, n, quoted("p_type")),
        F.lit(', "description": '), case({7: "null"}, n, '"d"'), F.lit(', "attributes": '), case({5: '"oops"'}, n, '{"size": 1}'),
        F.lit(', "price": '), case({3: '"nan"', 10: "-1"}, n, F.when(n == 4, F.concat(F.lit('"'), amount, F.lit('"'))).otherwise(amount)),
        F.lit(', "popularity_score": '), case({11: '{"a": 1}'}, n, "2"), F.lit(', "currency": "usd", "availability": "in_stock", "updated_at": "2026-01-01T00:00:00Z"'),
        case({8: ', "colour": "red", "seller_id": "s"}', 9: "}"}, n, ', "seller_id": "s"}'))
    path = fresh(spark, "products.jsonl")
    write_lines(v.table(spark, d, "part").select("p_partkey", value.alias("value")), "p_partkey", path)
    read = lines.arrival(lines.read_products(spark, path, strict=False))
    return read.select(
        "product_id", F.array_join("errors", ",").alias("errors"), F.when(F.size("errors") == 0, F.col("price")).alias("price"), F.col("seq").alias("arrival"))


@query("""SELECT CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS seq,
  CASE event_id % 7 WHEN 1 THEN 'wrong_types' WHEN 2 THEN 'source_version' WHEN 3 THEN 'payload,wrong_types' WHEN 4 THEN 'event_time' ELSE '' END AS errors,
  CASE WHEN event_id % 7 <> 2 THEN event_id % 100 END AS source_version
FROM events""")
def event_lines(spark, d):
    n, version = F.col("event_id") % 7, (F.col("event_id") % 100).cast("string")
    value = F.concat(
        F.lit('{"product_id": "p", "source_system": "s", "event_type": "product_deleted_or_unavailable", "event_id": '),
        F.when(n == 1, F.col("event_id").cast("string")).otherwise(F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"'))),
        F.lit(', "source_version": '), F.when(n == 2, "4.5").when(n == 5, F.concat(F.lit('"'), version, F.lit('"'))).otherwise(version),
        F.lit(', "payload": '), case({3: '"x"'}, n, "{}"), F.lit(', "event_time": '), case({4: '"2026-05-01T00:00:00"', 6: "1700000000"}, n, '"2026-05-01T00:00:00Z"'), F.lit("}"))
    path = fresh(spark, "events.jsonl")
    write_lines(v.table(spark, d, "events").select("event_id", value.alias("value")), "event_id", path)
    return lines.read_events(spark, path, strict=False).select("seq", F.array_join("errors", ",").alias("errors"), "source_version")


JUDGED = "SELECT 'query ' || CAST(doc_id % 50 AS VARCHAR) AS query, CAST(doc_id // 100 AS VARCHAR) AS product_id, quality * 2 + 1 - toxic AS g, doc_id FROM labels"


def judgment_lines(spark, d, path):
    grade = F.col("quality") * 2 + 1 - F.col("toxic")
    label = F.element_at(F.array(*map(F.lit, ("I", "C", "S", "E"))), grade + 1)
    given = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(
        F.concat(F.lit("query "), (F.col("doc_id") % 50).cast("string")).alias("query"), F.floor(F.col("doc_id") / 100).cast("string").alias("product_id"), grade.alias("grade")))
    ).otherwise(F.to_json(F.struct(
        F.concat(F.lit("query "), (F.col("doc_id") % 50).cast("string")).alias("query"), F.floor(F.col("doc_id") / 100).cast("string").alias("product_id"), label.alias("label"))))
    write_lines(v.table(spark, d, "labels").select("doc_id", given.alias("value")), "doc_id", path)
    return path


@query(f"SELECT query, product_id, CAST(arg_max(g, doc_id) AS INTEGER) AS grade FROM ({JUDGED}) GROUP BY query, product_id")
def judgments_by_arrival(spark, d):
    """Of repeated judgments the later line wins, whatever its label."""
    return lines.read_judgments(spark, judgment_lines(spark, d, fresh(spark, "judgments.jsonl"))).select("query", "product_id", "grade")


@query(f"SELECT query, product_id, CAST(arg_max(CASE WHEN doc_id % 2 = 0 THEN g ELSE 0 END, doc_id) AS INTEGER) AS grade FROM ({JUDGED}) GROUP BY query, product_id")
def search_judgment_lines(spark, d):
    """The search form of judgments knows grades only."""
    return lines.read_search_judgments(spark, judgment_lines(spark, d, fresh(spark, "judgments.jsonl"))).select("query", "product_id", "grade")


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, o_orderkey, o_orderstatus, o_totalprice FROM orders" for kind in ("csv", "jsonl", "parquet")))
def record_round_trip(spark, d):
    orders = v.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    schema = T.StructType(sorted(orders.schema.fields, key=lambda f: f.name))
    out = None
    for kind in ("csv", "jsonl", "parquet"):
        path = fresh(spark, f"orders.{kind}")
        if kind == "jsonl":
            lines.write_jsonl(orders, path)
        elif kind == "csv":
            orders.write.option("header", True).csv(path)
        else:
            orders.write.parquet(path)
        read = lines.read_records(spark, path, orders.schema if kind != "jsonl" else schema).select(F.lit(kind).alias("kind"), *orders.columns)
        out = read if out is None else out.unionByName(read)
    return out


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'embedding' ELSE '' END AS errors FROM embeddings""")
def embedding_validation(spark, d):
    cut = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    rows = v.table(spark, d, "embeddings").withColumn("embedding", cut)
    return validate.embedding_errors(rows, dims=64).select("vec_id", F.array_join("errors", ",").alias("errors"))


EXPERIMENTS = r"""
tried AS (
  SELECT c_custkey AS k, 's' || CAST(c_nationkey AS VARCHAR) AS strategy, (c_custkey % 40) / 8.0 + 0.125 AS title, c_acctbal AS score, c_custkey % 3 > 0 AS passed,
    '2026-01-01T00:00:' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || 'Z' AS stamp FROM customer),
plain AS (SELECT *, regexp_replace(regexp_replace(format('{:.4f}', title), '0+$', ''), '\.$', '') AS boost FROM tried),
logged AS (SELECT *, regexp_replace(strategy || '-brand1.5_title' || boost || '-' || stamp, '[:.]', '', 'g') AS id FROM plain)"""


@query(f"""WITH {EXPERIMENTS.strip()}
SELECT id, stamp AS "timestamp", score, id = (SELECT id FROM logged WHERE passed ORDER BY score DESC, stamp LIMIT 1) AS best FROM logged""")
def experiment_log(spark, d):
    """The log written in two goes, read back in order, with its best record."""
    k, strategy = F.col("c_custkey"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string"))
    boosts = F.create_map(F.lit("title"), (k % 40) / F.lit(8.0) + 0.125, F.lit("brand"), F.lit(1.5))
    at = F.concat(F.lit("2026-01-01T00:00:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("."), F.lpad(k.cast("string"), 9, "0"), F.lit("Z"))
    records = v.table(spark, d, "customer").select(
        tune.experiment_id(strategy, boosts, at).alias("id"), at.alias("timestamp"), F.struct(strategy.alias("strategy"), boosts.alias("field_boosts")).alias("config"),
        F.create_map(F.lit("m"), F.col("c_acctbal").cast("double")).alias("metrics"), (k % 3 > 0).alias("gate_passed"), F.lit("").alias("note"),
        F.create_map(F.lit("a"), F.lit("b")).alias("extra"), (k % 2).alias("half"))
    log = ExperimentStore(spark, fresh(spark, "experiments.jsonl"))
    for half in (0, 1):
        log.append(records.where(F.col("half") == half).drop("half"))
    best = log.best("m").select("id", F.lit(True).alias("best"))
    return log.all().join(F.broadcast(best), "id", "left").select(  # one row
        "id", "timestamp", F.col("metrics")["m"].alias("score"), F.coalesce("best", F.lit(False)).alias("best"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS title FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part)")
def lookup(spark, d):
    part = v.table(spark, d, "part")
    last = part.agg(F.max("p_partkey")).head()[0]
    catalog = part.select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("title"))
    return store.lookup(catalog, str(last))
