import hashlib
import math

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import enrich, labels, text
from shelfmark.operators import vectors

PRODUCT = "product_id string, title string, description string, brand string, category string, attributes map<string,string>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_normalise_folds_case_and_accents(spark):
    assert one(spark, text.normalise(F.lit("Crème BRÛLÉE Straße Łódź"))) == "creme brulee strasse lodz"


def test_tokens_and_token_set(spark):
    assert one(spark, text.tokens(F.lit("USB-C Größe, usb 20W"))) == ["usb", "c", "größe", "usb", "20w"]
    assert one(spark, text.token_set(F.lit("Red red B-2"))) == ["red", "b", "2"]


def test_stringify(spark):
    assert one(spark, text.stringify(F.lit(None).cast("string"))) == ""
    assert one(spark, text.stringify(F.lit('[" a ", "", "b"]'))) == "a, b"
    assert one(spark, text.stringify(F.lit("  plain "))) == "plain"
    assert one(spark, text.stringify(F.lit("[not json"))) == "[not json"


def test_title_key_has_none_for_long_titles(spark):
    assert one(spark, text.title_key(F.lit("É" * 256))) == "e" * 256
    assert one(spark, text.title_key(F.lit("x" * 257))) is None


def test_versions_and_times(spark):
    assert one(spark, text.parse_version(F.lit("12"))) == 12
    assert one(spark, text.parse_version(F.lit("2026-01-01T00:00:00Z"))) is None
    assert one(spark, text.utc_text(F.lit("2026-01-01 10:00:00").cast("timestamp"))) == "2026-01-01T10:00:00Z"
    assert one(spark, text.utc_text(F.lit("2026-01-01 10:00:00.5").cast("timestamp"))) == "2026-01-01T10:00:00.500000Z"


def test_labels(spark):
    assert [one(spark, labels.label_grade(F.lit(x))) for x in ("exact", "substitute", "complement", "irrelevant", "E")] == [
        3, 2, 1, 0, None]
    assert [one(spark, labels.dataset_grade(F.lit(x))) for x in ("E", " s ", "Complement", "i", "z")] == [3, 2, 1, 0, None]


def test_minimal_profile(rows):
    df = rows("title string", [("Minimal Product",)])
    assert df.select(enrich.search_profile(df)).head()[0] == "Product: Minimal Product."


def test_full_profile_in_order(rows):
    df = rows(PRODUCT, [("p", "Travel Mug", "Keeps coffee hot", "Acme", "Kitchen", {
        "material": "steel", "color": "red", "product_locale": "us", "tags": '["gift", "new"]', "audience": "campers, gym"})])
    profile = df.select(enrich.search_profile(df)).head()[0]
    assert profile == (
        "Product: Travel Mug. Brand: Acme. Category: Kitchen. Description: Keeps coffee hot. Color: red. Material: steel. "
        "Useful for: coffee, kitchen, morning routine, coffee machine, hydration, gym, commuting, outdoors, campers. "
        "Tags: gift, new. Attributes: campers, gym, red, steel, gift, new.")


def test_name_stands_in_for_title(rows):
    df = rows("title string, name string, color string", [("", "Lamp", "blue")])
    assert df.select(enrich.search_profile(df)).head()[0] == "Product: Lamp. Color: blue."


def test_catalog_and_embedding_text(rows):
    df = rows("title string, description string, brand string, category string, a string", [
        ("Wireless Mouse", "Quiet mouse", "Contoso", "Accessories", '{"b": "2", "a": "us"}')])
    # Parsed maps keep the order of the input.
    df = df.withColumn("attributes", F.from_json("a", "map<string,string>"))
    cat = enrich.catalog_text(*(F.col(c) for c in ("title", "description", "brand", "category", "attributes")))
    emb = enrich.embedding_text(*(F.col(c) for c in ("title", "brand", "category", "description")))
    got = df.select(cat, emb).head()
    assert got[0] == "Wireless Mouse Quiet mouse Contoso Accessories 2 us"
    assert got[1] == "Wireless Mouse Contoso Accessories Quiet mouse"


def reference_vector(value, dims=384):
    """The hash vector worked out by a plain loop."""
    vector = [0.0] * dims
    words = [w for w in value.lower().replace("-", " ").split() if w] or [value.lower()]
    for word in words:
        digest = hashlib.sha256(word.encode()).digest()
        for at in range(0, 32, 2):
            vector[(digest[at] * 256 + digest[at + 1]) % dims] += 1 if digest[at] % 2 == 0 else -1
    norm = math.sqrt(sum(x * x for x in vector)) or 1.0
    return [x / norm for x in vector]


def test_hash_embedding_matches_plain_loop(rows):
    texts = ["Wireless noise-cancelling headphones", "a a a b", "", "größe  ß"]
    df = rows("id int, text string", list(enumerate(texts)))
    got = {r["id"]: r["embedding"] for r in vectors.hash_embedding(df, "id", "text").collect()}
    for i, value in enumerate(texts):
        assert got[i] == pytest.approx(reference_vector(value), abs=1e-12)


def test_embedder_choice(rows):
    assert vectors.get_embedder("hash") is vectors.hash_embedding
    assert vectors.get_embedder("auto") is vectors.hash_embedding
    with pytest.raises(ValueError):
        vectors.get_embedder("other")
    encode = vectors.get_embedder("model", lambda c: F.array(F.length(c).cast("double")))
    assert encode(rows("id int, t string", [(1, "abc")]), "id", "t").head()["embedding"] == [3.0]


def test_all_white_space_is_stripped(spark):
    from pyspark.sql import functions as F

    from shelfmark.functions.labels import dataset_grade
    from shelfmark.functions.text import parse_version, stringify

    df = spark.createDataFrame([("　desc\n\t",), ("E\n",), (" 7\r",)], "t string")
    got = df.select(stringify(F.col("t")).alias("s"), dataset_grade(F.col("t")).alias("g"), parse_version(F.col("t")).alias("v")).collect()
    assert got[0].s == "desc" and got[1].g == 3 and got[2].v == 7
