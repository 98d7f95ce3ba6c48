"""Edit-distance expansion of query terms over a vocabulary.

Blocking is by shared segments: a word cut into d+1 pieces keeps at least one
piece intact under d edits, shifted by at most d.  The vocabulary emits its
pieces (five keys a word, whatever its length), the query terms emit the
substrings where such a piece could sit, and an equi-join brings the candidates
together.  The distance check afterwards is exact, so nothing is lost or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import scale


def allowed_edits(term: Column) -> Column:
    """0, 1 or 2 edits for up to 2, 3-5, 6 or more characters."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


def _piece(length: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """0-based start and length of piece ``i`` of a word cut into edits+1."""
    start = F.floor(length * i / (edits + 1)).cast("int")
    end = F.floor(length * (i + 1) / (edits + 1)).cast("int")
    return start, end - start


KEY = ["field", "edits", "length", "piece", "text"]


def _vocabulary_keys(vocabulary: DataFrame) -> DataFrame:
    """Every word's pieces, cut for one and for two edits."""
    cut = vocabulary.withColumn("length", F.length("term")).select(
        "*", F.explode(F.array(F.lit(1), F.lit(2))).alias("edits")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("piece"))
    start, size = _piece(F.col("length"), F.col("edits"), F.col("piece"))
    return cut.withColumn("text", F.substring("term", start + 1, size))


def _query_keys(wanted: DataFrame) -> DataFrame:
    """Substrings of the query terms that may equal a vocabulary word's piece:
    for every possible word length, piece and shift."""
    edits = F.col("edits")
    spread = (
        wanted.withColumn("edits", allowed_edits(F.col("clause"))).where("edits > 0")
        .select("*", F.explode(F.sequence(-edits, edits)).alias("longer"))
        .withColumn("length", F.length("clause") + F.col("longer")).where("length > 0")
        .select("*", F.explode(F.sequence(F.lit(0), edits)).alias("piece"))
        .select("*", F.explode(F.sequence(-edits, edits)).alias("shift"))
    )
    start, size = _piece(F.col("length"), edits, F.col("piece"))
    placed = spread.withColumns({"at": start + F.col("shift"), "size": size})
    inside = (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.length("clause"))
    return placed.where(inside).select(
        "clause", *KEY[:-1], F.substring("clause", F.col("at") + 1, F.col("size")).alias("text")).distinct()


def expand(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(field, clause) × vocabulary (field, term, df, ...) within the allowed edits.

    Adds ``distance`` and ``weight`` = 1 - distance / length of the shorter one.
    """
    facts = [c for c in vocabulary.columns if c not in ("field", "term")]
    exact = wanted.join(
        vocabulary.withColumnRenamed("term", "clause"), ["field", "clause"]
    ).select("field", "clause", F.col("clause").alias("term"), *facts, F.lit(0).alias("distance"))
    asked = scale.settle(_query_keys(wanted))
    near = (
        scale.join_settled(_vocabulary_keys(vocabulary), asked, KEY, salt_by="term")
        .where(F.col("clause") != F.col("term"))
        .withColumn("distance", F.levenshtein("clause", "term", 2))
        .where((F.col("distance") >= 0) & (F.col("distance") <= F.col("edits")))
        .select("field", "clause", "term", *facts, "distance")
        .distinct()
    )
    shorter = F.least(F.length("clause"), F.length("term"))
    return exact.unionByName(near).withColumn("weight", 1 - F.col("distance") / shorter)
