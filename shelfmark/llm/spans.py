"""Spans of regular expressions in DataFrame functions, and their digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.llm.common import let

SPAN = "array<struct<start:int,end:int,match:string>>"


def regex_spans(text: Column, pattern: str, possible: Column) -> Column:
    """Leftmost non-overlapping matches as (start, end, match) in code points; none where not ``possible``.

    The gaps between matches and the matches alternate; their lengths add up to the
    positions.  Patterns must not match the empty string.
    """
    def placed(x: Column) -> Column:
        step = lambda acc, y: F.struct(
            (acc["at"] + F.length(y["gap"]) + F.length(y["match"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(y["gap"])).alias("start"), (acc["at"] + F.length(y["gap"]) + F.length(y["match"])).alias("end"), y["match"].alias("match")))).alias("out"))
        pairs = F.arrays_zip(F.slice(x["gap"], 1, F.size(x["match"])).alias("gap"), x["match"].alias("match"))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    return F.when(possible, let(F.struct(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")),
        lambda x: F.when(F.size(x["match"]) == 0, F.array().cast(SPAN)).otherwise(placed(x)))).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
