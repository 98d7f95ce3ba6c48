"""JSON-lines, CSV and Parquet readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.labels import dataset_grade
from shelfmark.functions.text import non_empty, strip
from shelfmark.operators import validate
from shelfmark.operators.datasets import last_judgment

# Numbers and attributes are read as their JSON text, so that a wrong type shows.
PRODUCT_SCHEMA = (
    "product_id string, title string, description string, brand string, category string, "
    "attributes string, price string, currency string, availability string, "
    "popularity_score string, seller_id string, updated_at string")
PRODUCT_TEXTS = ("product_id", "title", "description", "brand", "category", "currency", "availability", "seller_id")
EVENT_SCHEMA = (
    "event_id string, product_id string, source_system string, event_type string, event_time string, "
    "payload string, source_version string")
EVENT_TEXTS = ("event_id", "product_id", "source_system", "event_type")
JUDGMENT_SCHEMA = "query string, product_id string, label string, grade int, relevance int"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their 1-based number in their file: (path, line_no, value).

    A file may be read in several splits: lines are numbered inside each split
    and shifted by the line counts of the splits before it, so the numbering is
    exact and no task sees a whole file.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    splits = raw.groupBy("path", "block").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("path", "block", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return raw.where(strip("value") != "").join(offsets, ["path", "block"]).select(
        "path", (F.col("before") + F.col("at") - F.col("start") + 1).alias("line_no"),
        F.regexp_replace("value", "^﻿", "").alias("value"))


def _parse(lines: DataFrame, schema: str) -> DataFrame:
    """Fields of every line as text or as the schema says, with ``extra_fields`` and ``kinds``: the JSON type of each field.

    A line is also parsed as a VARIANT, which knows whether a value was a text, a number, a list or null;
    a field that is not there has no kind.
    """
    names = T.StructType.fromDDL(schema).fieldNames()
    whole = F.try_parse_json("value")
    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    found = F.when(is_object, F.json_object_keys("value")).otherwise(F.array(F.lit("not a JSON object")))
    return lines.select("*", whole.alias("whole")).select(
        "path", "line_no", F.from_json("value", schema).alias("row"), F.array_except(found, F.array(*map(F.lit, names))).alias("extra_fields"),
        F.struct(*(F.schema_of_variant(F.try_variant_get("whole", f"$.{name}", "variant")).alias(name) for name in names)).alias("kinds"),
    ).select("path", "line_no", "row.*", "extra_fields", "kinds")


NUMBER = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"


def _kind_errors(allowed: dict[str, str]) -> Column:
    """Names of the fields whose JSON type does not match its pattern; a missing field breaks no rule here."""
    wrong = [F.when(~F.col(f"kinds.{name}").rlike(pattern), F.lit(name)) for name, pattern in allowed.items()]
    return F.array_compact(F.array(*wrong))


def _moment(name: str) -> Column:
    """Text of a time; a number is seconds, or milliseconds beyond 2e10, since 1970."""
    n = F.col(name).try_cast("double")
    at = F.timestamp_micros((F.when(F.abs(n) > 2e10, n / 1000).otherwise(n) * 1_000_000).cast("bigint"))
    return F.when(F.col(f"kinds.{name}").rlike(NUMBER), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).otherwise(F.col(name))


def _amount(name: str) -> Column:
    """A number, or a text or truth value that stands for one."""
    return F.coalesce(strip(name).try_cast("double"), F.when(F.col(f"kinds.{name}") == "BOOLEAN", F.col(name).try_cast("boolean").cast("double")))


def _checked(df: DataFrame, strict: bool, what: str) -> DataFrame:
    done = validate.required(df, f"{what} on line") if strict else df
    return done.drop("extra_fields", "wrong_types")


def read_products(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Validated products of a JSONL file or folder.

    Strict fails on a bad line with its number; otherwise the ``errors`` column
    tells what is wrong with each line.
    """
    rows = _parse(numbered_lines(spark, path), PRODUCT_SCHEMA)
    numbers = ("price", "popularity_score")
    # A null where a value is required breaks the field's own rule.
    allowed = dict.fromkeys(PRODUCT_TEXTS, "^(STRING|VOID)") | dict.fromkeys(numbers, f"^STRING|^BOOLEAN|^VOID|{NUMBER}") | {
        "description": "^STRING", "attributes": "^(OBJECT|VOID)", "updated_at": f"^STRING|^VOID|{NUMBER}"}
    no_number = [F.when(F.col(c).isNotNull() & _amount(c).isNull() & F.col(f"kinds.{c}").rlike(allowed[c]), F.lit(c)) for c in numbers]
    typed = rows.withColumn("wrong_types", F.concat(_kind_errors(allowed), F.array_compact(F.array(*no_number))))
    typed = typed.withColumns(
        {c: _amount(c) for c in numbers} | {"updated_at": _moment("updated_at"), "attributes": F.from_json("attributes", "map<string,string>")})
    return _checked(validate.product_errors(typed.drop("kinds")), strict, "product")


def arrival(lines: DataFrame) -> DataFrame:
    """Lines with ``seq``, their number over all files in path order.

    One row per file goes through a single task to add up line counts.
    """
    files = lines.groupBy("path").agg(F.max("line_no").alias("n"))
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    shifts = files.select("path", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    return lines.join(shifts, "path").withColumn("seq", F.col("shift") + F.col("line_no")).drop("shift")


def read_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Validated change events; ``seq`` is the arrival order.

    Files are taken in path order, lines in file order.
    """
    lines = numbered_lines(spark, path)
    order = arrival(lines).select("path", "line_no", "seq")
    allowed = dict.fromkeys(EVENT_TEXTS, "^(STRING|VOID)") | {
        "payload": "^OBJECT", "event_time": f"^STRING|^VOID|{NUMBER}", "source_version": f"^STRING|^BOOLEAN|^VOID|{NUMBER}"}
    version = _amount("source_version")  # whole numbers only
    rows = _parse(lines, EVENT_SCHEMA).withColumns({
        "wrong_types": _kind_errors(allowed), "event_time": _moment("event_time"),
        "source_version": F.when(version == F.floor(version), version.try_cast("bigint"))})
    parsed = validate.event_errors(rows.drop("kinds")).join(order, ["path", "line_no"])
    return _checked(parsed, strict, "product event")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judgments from JSONL lines with ``grade`` or ``label`` (S3)."""
    rows = arrival(numbered_lines(spark, path)).select(
        "seq", "path", "line_no", F.from_json("value", JUDGMENT_SCHEMA).alias("r")).select("seq", "path", "line_no", "r.*")
    problem = F.raise_error(F.format_string("No grade for the label in line %d of %s", F.col("line_no"), F.col("path"))).cast("int")
    grade = F.coalesce("grade", dataset_grade(F.col("label")), problem)
    return last_judgment(rows.withColumn("grade", grade))


def read_search_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judgments from JSONL, or from a JSON array of {query, judgments}.

    Blank queries or ids and empty judgment maps are errors.  ``query_no`` keeps
    the file's query order (text order for JSONL).
    """
    if path.lower().endswith(".jsonl"):
        rows = arrival(numbered_lines(spark, path)).select(
            "seq", "line_no", F.from_json("value", JUDGMENT_SCHEMA).alias("r")).select(
            "seq", "line_no", strip("r.query").alias("query"), strip("r.product_id").alias("product_id"),
            F.coalesce("r.grade", "r.relevance", F.lit(0)).alias("grade"))
        bad = non_empty(F.col("query")).isNull() | non_empty(F.col("product_id")).isNull()
        message = F.format_string("Line %d: a judgment needs a query and a product id", F.col("line_no"))
        return last_judgment(rows.where(_demand(~bad, message)))
    rows = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.from_json("value", "array<struct<query:string,judgments:map<string,int>>>")).alias("at", "r")
    ).select((F.col("at") + 1).alias("query_no"), strip("r.query").alias("query"), F.col("r.judgments").alias("judgments"))
    named = _demand(non_empty(F.col("query")).isNotNull(), F.format_string("Entry %d of the judgments has no query", "query_no"))
    full = _demand(F.coalesce(F.size("judgments"), F.lit(0)) > 0,
                   F.format_string("Entry %d of the judgments grades no product", "query_no"))
    return rows.where(named & full).select("query_no", "query", F.explode("judgments").alias("product_id", "grade"))


def _demand(condition: Column, message: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def read_records(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Dataset file by suffix: .jsonl, .csv (with header) or .parquet."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == "jsonl":
        return reader.json(path)
    if suffix == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if suffix == "parquet":
        return reader.parquet(path)
    raise ValueError(f"Unsupported input format: {path}")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, keys in name order."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)
