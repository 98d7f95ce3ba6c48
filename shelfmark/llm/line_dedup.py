"""Line dedup by a log-template tree of fixed depth.

A line's leaf is its token count and its leading tokens, fields with digits
generalised first.  In a leaf a template is the line itself, or the line with one
of three segments of its remaining tokens generalised: lines of a leaf that differ
inside one segment only share that template.  A template that recurs in
``min_docs`` documents stays in the first of them (smallest id) and is dropped from
every other one; a long one (``long_line`` tokens or more) does so from its second
document on, as it hardly recurs by chance.

Templates are two hashes of 95 bits in all, counted with map-side partial sums, so
a line found in a third of all documents is a few rows per task.  What may recur
(several occurrences, several ids) is joined back and its documents are counted
exactly.  No group of lines is ever gathered.

Defined cases: a null text stays null, an empty one empty; blank lines stay;
repeats inside one document stay; rows that share an id are one document (those
without an id too), and each is cut by its own lines; a very long line is hashed as
it stands, whatever its length, and a very long text is a row per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import discard, let, rows_of, stored, with_text

#: A whole token that holds a digit (Java); the look-behind keeps it linear in the token's length.
NUMERIC = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: Characters that make a line uneven wherever they stand.
UNEVEN = r"[0-9\x09-\x0D]"
FIELD = "<*>"
SEGMENTS = 3
#: Tokens from which a line is long.
LONG_LINE = 20


def even(line: Column) -> Column:
    """The line's tokens with single spaces between, tokens with digits generalised."""
    spaced = F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))
    uneven = line.startswith(" ") | line.endswith(" ") | line.contains("  ") | line.rlike(UNEVEN)
    return F.when(uneven, F.regexp_replace(spaced, NUMERIC, FIELD)).otherwise(line)


def templates(line: Column, n: Column, depth: int) -> list[Column]:
    """Template hashes of an even line of ``n`` tokens: the line itself, and with each segment generalised."""
    part = lambda k: F.call_function("substring_index", line, F.lit(" "), k)
    cut = [F.lit(depth) + F.floor((n - depth) * j / SEGMENTS).cast("int") for j in range(1, SEGMENTS)]
    before = [F.substring_index(line, " ", depth), *(part(k) for k in cut)]
    after = [*(part(k - n) for k in cut), F.lit("")]
    return [F.xxhash64(F.lit(0), line), *(F.xxhash64(F.lit(j + 1), b, a) for j, (b, a) in enumerate(zip(before, after, strict=True)))]


def occurrences(docs: DataFrame, id_col: str, text_col: str, depth: int, long_line: int) -> DataFrame:
    """One row per document and line: ``id``, ``body`` (a hash of the text), ``line``, ``leaf`` and ``keys``, one for each template."""
    lines = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.posexplode(F.split(text_col, "\n", -1)).alias("line", "t"))
    tokens = lines.select("id", "body", "line", even(F.col("t")).alias("t")).where("t != ''")
    counted = tokens.select("*", (F.octet_length("t") - F.octet_length(F.replace("t", F.lit(" "), F.lit(""))) + 1).alias("n"))
    exact, *general = templates(F.col("t"), F.col("n"), depth)
    keys = F.when(F.col("n") - depth < SEGMENTS, F.array(exact)).otherwise(F.array(exact, *general))
    leaf = F.shiftleft(F.hash("n", F.substring_index("t", " ", depth)), 1).bitwiseOR((F.col("n") >= long_line).cast("int"))
    return counted.select("id", "body", "line", leaf.alias("leaf"), keys.alias("keys"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 2, min_docs: int = 3, long_line: int = LONG_LINE) -> DataFrame:
    """``id``, ``body`` and the numbers of the lines to drop, for the documents that have any."""
    # Hashed once: both the count and the join read the hashes, not the texts.
    hashed = stored(occurrences(docs, id_col, text_col, depth, long_line), "hashed-lines")
    lines = hashed.select("id", "body", "line", "leaf", F.explode("keys").alias("key"))
    counts = lines.groupBy("leaf", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.count("id").alias("named"))
    several = (F.col("first") != F.col("last")) | ((F.col("named") > 0) & (F.col("named") < F.col("n")))
    needed = F.when(F.col("leaf").bitwiseAND(1) == 1, min(2, min_docs)).otherwise(min_docs)
    likely = stored(counts.where((F.col("n") >= needed) & several).select("leaf", "key", "first"), "likely-templates")
    hits = stored(lines.join(likely, ["leaf", "key"]), "template-lines")
    discard(hashed, likely)
    known = hits.select("leaf", "key", "id").distinct().groupBy("leaf", "key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= needed)
    later = ~F.col("id").eqNullSafe(F.col("first"))
    return hits.join(known, ["leaf", "key"], "left_semi").where(later).groupBy("id", "body").agg(F.collect_set("line").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 2, min_docs: int = 3, long_line: int = LONG_LINE) -> DataFrame:
    """One row per document: ``row`` (its columns), ``id``, ``n_lines``, ``n_removed`` and ``clean_text``."""
    all_rows = rows_of(docs, id_col, text_col).withColumn("body", F.xxhash64("text"))
    drop = dropped_lines(docs, id_col, text_col, depth, min_docs, long_line).select(F.col("id").alias("d_id"), F.col("body").alias("d_body"), "drop")
    joined = all_rows.join(drop, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("body") == F.col("d_body")), "left")
    lines = F.split("text", "\n", -1)
    clean = F.when(F.col("drop").isNull(), F.col("text")).otherwise(let(F.struct(lines.alias("l"), F.col("drop").alias("d")), lambda x: F.array_join(
        F.filter(x["l"], lambda line, i: ~F.array_contains(x["d"], i)), "\n")))
    return joined.select(
        "row", "id", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"), clean.alias("clean_text"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 2, min_docs: int = 3, long_line: int = LONG_LINE) -> DataFrame:
    """All documents without the dropped lines, in the columns of the input; none is removed."""
    return with_text(docs, text_col, dedup_lines(docs, id_col, text_col, depth, min_docs, long_line), F.col("clean_text"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 2, min_docs: int = 3, long_line: int = LONG_LINE) -> DataFrame:
    """As ``drop_lines``, but a document that loses all its words is dropped; those blank on input stay."""
    found = dedup_lines(docs, id_col, text_col, depth, min_docs, long_line)
    left = found.where((F.col("n_removed") == 0) | F.col("clean_text").rlike(r"[^\x20\x09-\x0D]"))
    return with_text(docs, text_col, left, F.col("clean_text"))
