import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import datasets, metrics, validate
from shelfmark.sources import catalog as store
from shelfmark.sources import lines
from shelfmark.sources.experiments import read_report, write_report

GOOD = {
    "product_id": "p1", "title": "T", "brand": "B", "category": "C", "attributes": {"b": "2", "a": "1"}, "price": 1.5,
    "currency": "usd", "availability": "in_stock", "popularity_score": 2, "seller_id": "s", "updated_at": "2026-01-01T02:00:00+02:00"}
EVENT = {"event_id": "e", "product_id": "p", "source_system": "s", "event_type": "product_title_updated",
         "event_time": "2026-05-01T09:00:00Z", "payload": {"title": "x"}, "source_version": 3}


def put(path, *items):
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in items), encoding="utf-8")
    return str(path)


def test_read_products(spark, tmp_path):
    got = lines.read_products(spark, put(tmp_path / "p.jsonl", GOOD, "", {**GOOD, "product_id": "p2"})).orderBy("line_no").collect()
    assert [(r["line_no"], r["product_id"]) for r in got] == [(1, "p1"), (3, "p2")]
    assert got[0]["currency"] == "USD" and got[0]["description"] == ""
    assert str(got[0]["updated_at"]) == "2026-01-01 00:00:00"


@pytest.mark.parametrize("change, error", [
    ({"product_id": ""}, "product_id"), ({"title": ""}, "title"), ({"price": -1}, "price"), ({"currency": "US"}, "currency"),
    ({"availability": "sold"}, "availability"), ({"updated_at": "2026-01-01T00:00:00"}, "updated_at"),
    ({"popularity_score": -0.1}, "popularity_score"), ({"seller_id": None}, "seller_id"), ({"color": "red"}, "extra_fields")])
def test_product_rules(spark, tmp_path, change, error):
    path = put(tmp_path / "p.jsonl", GOOD, {**GOOD, **change})
    checked = lines.read_products(spark, path, strict=False).orderBy("line_no").collect()
    assert [r["errors"] for r in checked] == [[], [error]]


def test_strict_reading_names_the_line(spark, tmp_path):
    path = put(tmp_path / "p.jsonl", GOOD, "", {**GOOD, "price": -1})
    with pytest.raises(Exception, match="Invalid product on line 3: price"):
        lines.read_products(spark, path).collect()
    with pytest.raises(Exception, match="line 2"):
        lines.read_products(spark, put(tmp_path / "q.jsonl", GOOD, "not json")).collect()


def test_line_numbers_across_splits(spark, tmp_path):
    path = put(tmp_path / "many.jsonl", *({"n": i} for i in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        got = lines.numbered_lines(spark, path).select("line_no", F.get_json_object("value", "$.n").cast("long").alias("n"))
        assert got.where("n <> line_no").count() == 0 and got.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("change, error", [
    ({"event_type": "other"}, "event_type"), ({"event_time": "2026-05-01T09:00:00"}, "event_time"), ({"source_version": -1}, "source_version"),
    ({"payload": {}}, "required_payload"), ({"payload": {"title": None}}, "null_payload"), ({"note": 1}, "extra_fields"),
    ({"event_type": "attributes_updated", "payload": {"attributes": [1]}}, "attributes_object"),
    ({"event_type": "product_price_updated", "payload": {"price": -1}}, "price"), ({"source_system": ""}, "source_system")])
def test_event_rules(spark, tmp_path, change, error):
    path = put(tmp_path / "e.jsonl", EVENT, {**EVENT, **change})
    checked = lines.read_events(spark, path, strict=False).orderBy("seq").collect()
    assert [r["errors"] for r in checked] == [[], [error]]


def test_event_order_over_files(spark, tmp_path):
    put(tmp_path / "a.jsonl", {**EVENT, "event_id": "1"}, {**EVENT, "event_id": "2"})
    put(tmp_path / "b.jsonl", {**EVENT, "event_id": "3"})
    got = lines.read_events(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["seq"], r["event_id"]) for r in got] == [(1, "1"), (2, "2"), (3, "3")]


def test_judgments(spark, tmp_path):
    path = put(tmp_path / "j.jsonl", {"query": "q", "product_id": "a", "label": "exact"}, {"query": "q", "product_id": "b", "label": "E", "grade": 2},
               {"query": "q", "product_id": "a", "label": "irrelevant"})
    assert {(r["product_id"], r["grade"]) for r in lines.read_judgments(spark, path).collect()} == {("a", 0), ("b", 2)}
    bad = put(tmp_path / "bad.jsonl", {"query": "q", "product_id": "a", "label": "huh"})
    with pytest.raises(Exception, match="No grade for the label in line 1"):
        lines.read_judgments(spark, bad).collect()
    loose = put(tmp_path / "l.jsonl", {"query": " q ", "product_id": "a", "relevance": 3}, {"query": "q", "product_id": "b"})
    assert {(r["query"], r["product_id"], r["grade"]) for r in lines.read_search_judgments(spark, loose).collect()} == {("q", "a", 3), ("q", "b", 0)}
    with pytest.raises(Exception, match="Line 1: a judgment needs a query"):
        lines.read_search_judgments(spark, put(tmp_path / "n.jsonl", {"query": "", "product_id": "b"})).collect()


def test_nested_judgments(spark, tmp_path):
    path = tmp_path / "j.json"
    path.write_text(json.dumps([{"query": "b", "judgments": {"x": 3, "y": 1}}, {"query": "a", "judgments": {"z": 2}}]))
    got = lines.read_search_judgments(spark, str(path)).orderBy("query_no", "product_id").collect()
    assert [tuple(r) for r in got] == [(1, "b", "x", 3), (1, "b", "y", 1), (2, "a", "z", 2)]
    path.write_text(json.dumps([{"query": "b", "judgments": {}}]))
    with pytest.raises(Exception, match="grades no product"):
        lines.read_search_judgments(spark, str(path)).collect()


def test_records_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([("1", "a,\"b\"")], "id string, t string")
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "x.csv"))
    df.write.parquet(str(tmp_path / "x.parquet"))
    lines.write_jsonl(df.withColumn("a", F.lit(None).cast("string")), str(tmp_path / "x.jsonl"))
    for suffix in ("csv", "parquet", "jsonl"):
        assert lines.read_records(spark, str(tmp_path / f"x.{suffix}")).select("id", "t").head() == ("1", 'a,"b"')
    text = spark.read.text(str(tmp_path / "x.jsonl")).head()[0]
    assert text.startswith('{"a":null,"id":"1"')
    with pytest.raises(ValueError, match="Unsupported input format"):
        lines.read_records(spark, "x.xml")


def test_upsert_is_idempotent(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "product_id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "product_id string, v int, seq long")
    once = store.upsert(now, new)
    assert {tuple(r) for r in once.collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert {tuple(r) for r in store.upsert(once, new).collect()} == {("a", 1), ("b", 4), ("c", 5)}


def test_write_outcomes_and_partial_update(spark):
    sent = spark.createDataFrame([(x,) for x in "abcde"], "product_id string")
    answers = spark.createDataFrame([("a", 201), ("b", 429), ("c", 503), ("d", 400)], "product_id string, status int")
    assert {tuple(r) for r in store.outcome_counts(sent, answers).collect()} == {("ok", 1), ("retryable", 2), ("failed", 2)}
    updates = spark.createDataFrame([("a", [1.0]), ("zz", [2.0])], "product_id string, embedding array<double>")
    done, failed = store.update_column(sent, updates)
    assert {r["product_id"]: r["embedding"] for r in done.collect()} == {"a": [1.0], "b": None, "c": None, "d": None, "e": None}
    assert [r["product_id"] for r in failed.collect()] == ["zz"]


def test_lookups(spark):
    catalog = spark.createDataFrame([("a", 1), ("b", 2)], "product_id string, v int")
    assert store.lookup(catalog, "b").head()["v"] == 2 and store.lookup(catalog, "x").isEmpty()
    lists = spark.createDataFrame([("q", ["b", "x", "a"])], "qid string, ids array<string>")
    assert [(r["pos"], r["product_id"]) for r in store.multi_get(lists, catalog).orderBy("pos").collect()] == [(0, "b"), (2, "a")]
    checked = spark.createDataFrame([(["x"],), ([],)], "errors array<string>")
    assert tuple(store.upsert_summary(checked).head()) == (1, 1)


def test_requests(spark):
    df = spark.createDataFrame([
        (" mug ", None, None, None, None), ("", "baseline_bm25", 10, None, None), ("a", "nope", 51, None, None),
        ("a", None, 0, -1.0, None), ("a", None, 50, 5.0, 4.0), ("a", None, 1, 4.0, 4.0)],
        "query string, strategy string, size int, f_min_price double, f_max_price double")
    got = validate.request_errors(df).collect()
    assert [r["errors"] for r in got] == [[], ["query"], ["strategy", "size"], ["size", "f_min_price"], ["price_range"], []]
    assert got[0]["query"] == "mug" and got[0]["strategy"] == "enriched_profile" and got[0]["size"] == 10
    assert validate.accepted(validate.request_errors(df)).count() == 2
    assert validate.rejected(validate.request_errors(df)).count() == 4
    vec = spark.createDataFrame([([0.0] * 384,), ([1.0],)], "embedding array<double>")
    assert [r["errors"] for r in validate.embedding_errors(vec).collect()] == [[], ["embedding"]]


PRODUCTS = "seq long, product_id string, product_title string, product_description string, product_bullet_point string, product_brand string, product_color string, product_locale string"
EXAMPLES = "query string, product_id string, product_locale string, esci_label string"


def dataset(spark):
    products = spark.createDataFrame([
        (1, "p1", "Old", "d", None, "", " red ", "us"), (2, "p1", "New", "d", "b", "", " red ", "us"),
        (3, "p2", None, None, "only", "Acme", None, None), (4, "p3", "Fr", "", "", "x", "", "fr"), (5, "p9", "Unjudged", "", "", "", "", "us")], PRODUCTS)
    examples = spark.createDataFrame([
        ("q1", "p1", "us", "E"), ("q1", "p2", "EN_US", "substitute"), ("q2", "p2", None, "C"), ("q3", "p3", "fr", "I"), ("q4", "gone", "us", "E")], EXAMPLES)
    return products, examples


def test_prepare_full(spark):
    products, judgments = datasets.prepare(*dataset(spark), 0, 0, full=True)
    got = {r["product_id"]: r for r in products.collect()}
    assert set(got) == {"p1", "p2"}
    assert (got["p1"]["title"], got["p1"]["description"], got["p1"]["brand"]) == ("New", "d b", "unknown")
    assert got["p1"]["attributes"] == {"product_color": "red", "product_locale": "us"}
    assert (got["p2"]["title"], got["p2"]["description"]) == ("Untitled product", "only")
    assert {(r["query"], r["product_id"], r["grade"]) for r in judgments.collect()} == {("q1", "p1", 3), ("q1", "p2", 2), ("q2", "p2", 1)}
    everyone, _ = datasets.prepare(*dataset(spark), 0, 0, full=True, all_locales=True)
    assert everyone.count() == 3


def test_prepare_sample(spark):
    products, judgments = datasets.prepare(*dataset(spark), 10, 1)
    assert [r["product_id"] for r in products.collect()] == ["p1"] and judgments.count() == 1
    _, examples = dataset(spark)
    first = [r[0] for r in datasets.sample_queries(examples, 2, 7).collect()]
    assert first == [r[0] for r in datasets.sample_queries(examples, 2, 7).collect()] and len(first) == 2
    assert datasets.sample_queries(examples, 99).count() == 4


def test_unknown_dataset_label(spark):
    df = spark.createDataFrame([("q", "p", "us", "zzz")], EXAMPLES)
    with pytest.raises(Exception, match="Unknown ESCI label: zzz"):
        datasets.transform_judgments(df).collect()


def test_report_files(spark, tmp_path):
    ranking = spark.createDataFrame([("s", "q", "a", 1)], "strategy string, query string, product_id string, rank int")
    judged = spark.createDataFrame([("q", "a", 3)], "query string, product_id string, grade int")
    rows = metrics.evaluation_rows(ranking, judged, ["s"])
    write_report(metrics.summary(rows, "s"), metrics.winners(rows), str(tmp_path / "r"))
    summary, per_query = read_report(spark, str(tmp_path / "r"))
    assert summary.head()["ndcg_at_10"] == 1.0 and per_query.head()["winners"] == ["s"]


def test_later_file_wins_and_line_numbers_restart(spark, tmp_path):
    from shelfmark.sources.lines import read_judgments

    (tmp_path / "a.jsonl").write_text("\n".join('{"query": "q", "product_id": "p%d", "label": "E"}' % i for i in range(3)))
    (tmp_path / "b.jsonl").write_text('{"query": "q", "product_id": "p2", "label": "i\\n"}')
    got = {r.product_id: r.grade for r in read_judgments(spark, str(tmp_path)).collect()}
    assert got == {"p0": 3, "p1": 3, "p2": 0}


def test_types_of_product_fields(spark, tmp_path):
    from shelfmark.sources.lines import read_products

    line = ('{"product_id": "%s", "title": "t", "brand": "b", "category": "c", "attributes": %s, "price": %s, "currency": "usd", '
            '"availability": "in_stock", "popularity_score": 1, "seller_id": "s", "updated_at": "2026-01-01T00:00:00Z"}')
    (tmp_path / "p.jsonl").write_text("\n".join([
        line % ("1", '{"a": 1}', '"1.5"'), line % ("2", '"oops"', "2"), line % ("3", "{}", '"cheap"'), line % ("4", "null", "4")]))
    got = {r.product_id: r for r in read_products(spark, str(tmp_path), strict=False).collect()}
    assert got["1"].errors == [] and got["1"].price == 1.5 and got["1"].attributes == {"a": "1"}
    assert "wrong_types" in got["2"].errors and "wrong_types" in got["3"].errors and got["4"].errors == []


def test_repeated_updates_last_wins(spark):
    from shelfmark.sources.catalog import update_column

    catalog = spark.createDataFrame([("a",), ("b",)], "product_id string")
    updates = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("z", "w", 3)], "product_id string, embedding string, seq int")
    done, failed = update_column(catalog, updates)
    assert sorted(map(tuple, done.collect())) == [("a", "y"), ("b", None)] and failed.count() == 1


def test_json_types_of_every_product_field(spark, tmp_path):
    """A number, list, truth value or null where a text belongs, and numbers that are none."""
    bad = {
        "title": 5, "brand": ["x"], "category": True, "description": None, "seller_id": {"a": 1}, "currency": 123, "attributes": "oops", "price": "nan",
        "popularity_score": "much", "updated_at": [1]}
    good = [{**GOOD, "product_id": "g1", "price": "1.5"}, {**GOOD, "product_id": "g2", "price": True}, {**GOOD, "product_id": "g3", "updated_at": 1_700_000_000}]
    path = put(tmp_path / "p.jsonl", *({**GOOD, "product_id": name, name: value} for name, value in bad.items()), *good, "[1]", '{"price": NaN}')
    got = {r.product_id: r for r in lines.read_products(spark, path, strict=False).collect()}
    for name in bad:
        assert got[name].errors, name
        assert ("wrong_types" in got[name].errors) == (name != "price") and got[name].product_id == name
    assert "price" in got["price"].errors
    assert [got[g["product_id"]].errors for g in good] == [[], [], []]
    assert (got["g1"].price, got["g2"].price) == (1.5, 1.0) and got["g3"].updated_at.year == 2023
    assert "extra_fields" in got[None].errors


def test_json_types_of_every_event_field(spark, tmp_path):
    event = {"event_id": "e", "product_id": "p", "source_system": "s", "event_type": "product_deleted_or_unavailable",
             "event_time": "2026-05-01T00:00:00Z", "payload": {}, "source_version": 3}
    cases = [({}, []), ({"event_id": 7}, ["wrong_types"]), ({"payload": "x"}, ["payload", "wrong_types"]), ({"source_version": "4"}, []), ({"source_version": 4.0}, []),
             ({"source_version": 4.5}, ["source_version"]), ({"source_version": [1]}, ["source_version", "wrong_types"]), ({"product_id": None}, ["product_id"])]
    path = put(tmp_path / "e.jsonl", *({**event, **change} for change, _ in cases))
    got = lines.read_events(spark, path, strict=False).orderBy("seq").collect()
    assert [r.errors for r in got] == [errors for _, errors in cases]
    assert [r.source_version for r in got[3:5]] == [4, 4]


def test_updates_without_order_must_agree(spark):
    from shelfmark.sources.catalog import update_column

    catalog = spark.createDataFrame([("a",), ("b",)], "product_id string")
    same = spark.createDataFrame([("a", [1.0]), ("a", [1.0])], "product_id string, embedding array<double>")
    assert {r.product_id: r.embedding for r in update_column(catalog, same)[0].collect()} == {"a": [1.0], "b": None}
    with pytest.raises(Exception, match="have no order"):
        update_column(catalog, same.unionByName(spark.createDataFrame([("a", [2.0])], same.schema)))[0].collect()
