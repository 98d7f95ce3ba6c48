"""Quality rules, line first: clean the lines, then judge what is left.

Every line passes the punctuation, navigation and boilerplate rules or is
removed.  A document is rejected when its base figures fail or when too much of
its text was removed.  All of it is one row-local projection: no exchange, no
Python, and a plan that reads each text once.

Defined cases: a null text has no lines and no words, so it fails the base rule
(fewer than ``min_words``); so does an empty one.  Repeated rows are judged one by
one.  Other columns, whatever their names, are carried through untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import let, rows_of, with_text, words

WORD = r"[^\x20\x09-\x0D]"
#: Line patterns (Java).  A line that ends openly and has no sentence mark inside is a heading or fragment.
SENTENCE_MARK = r"[.!?:;…。！？؟।][\"'”’»)\]]*(?:[\x20\x09-\x0D]|$)"
SYMBOL = r"[#*$%&|<>]"
SEPARATOR = r"(?:^|[\x20\x09])[|»«>•·]+(?=[\x20\x09]|$)"
SHOUT = r"!!+"
#: Phrases of licence, cookie and sign-in lines, compared in lower case.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "copyright (c)", "copyright ©", "javascript is", "licensed under",
    "powered by", "privacy policy", "sign in", "sign up", "subscribe to our", "terms and conditions", "terms of service", "terms of use",
)


def base_figures(text: Column) -> dict[str, Column]:
    """Figures of whole texts that need no word array."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def window_hashes(words_col: str) -> Column:
    """A 64-bit hash of every three-word window, in order."""
    return F.expr(f"""
        CASE WHEN size({words_col}) < 4 THEN CAST(array() AS ARRAY<BIGINT>) ELSE slice(transform(
            arrays_zip({words_col}, slice({words_col}, 2, size({words_col})), slice({words_col}, 3, size({words_col}))),
            x -> xxhash64(x)), 1, size({words_col}) - 2) END""")


def repeat_words(hashes: str) -> Column:
    """Words inside three-word windows that occur twice or more, the first one included.

    Texts without any repeated window, most of them, end at the first line.  In the
    others windows are sorted with their positions, so equal ones are neighbours.
    """
    return F.expr(f"""
        CASE WHEN size(array_distinct({hashes})) = size({hashes}) THEN 0L ELSE element_at(transform(array(
            sort_array(transform({hashes}, (h, i) -> struct(h, i)))),
            s -> element_at(transform(array(
                transform(filter(s, (x, k) -> (k > 0 AND s[k - 1].h = x.h) OR (k + 1 < size(s) AND s[k + 1].h = x.h)), x -> x.i)),
                p -> CAST(size(array_distinct(flatten(array(p, transform(p, i -> i + 1), transform(p, i -> i + 2))))) AS BIGINT)), 1)), 1)
        END""")


def boilerplate(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in BOILERPLATE]))


def line_passes(line: Column, text: Column) -> Column:
    """Whether a line stays.  Blank lines stay: they carry no text to lose.

    Punctuation: a sentence mark inside or at the end, few bare symbols, no shouting.
    Navigation: fewer than one separator for three words.  Boilerplate: none of its
    phrases.  ``text`` says of the whole text which rules can fail at all, so that most
    lines meet one pattern only.
    """
    odd = let(F.size(words(line)), lambda n: (
        (F.regexp_count(line, F.lit(SYMBOL)) * 4 < n) & (F.regexp_count(line, F.lit(SEPARATOR)) * 3 < n)
        & (F.regexp_count(line, F.lit(SHOUT)) * 3 < n)))
    return ~line.rlike(WORD) | (
        line.rlike(SENTENCE_MARK) & (~text["marked"] | odd) & (~text["stock"] | ~boilerplate(line)))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50, min_kept_pct: int = 50,
) -> DataFrame:
    """One row per document: ``row`` (its columns), ``id``, figures, ``clean_text`` and the verdict ``kept``.

    ``kept`` is false for failed base figures, and where the lines that stay hold
    less than ``min_kept_pct`` per cent of the characters.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = rows_of(docs, id_col, text_col).select(
        "row", "id", text.alias("text"), words(F.col("text")).alias("w"), *(c.alias(n) for n, c in base_figures(text).items()))
    read = read.select("*", window_hashes("w").alias("h"))
    measured = read.select(
        "row", "id", "text", "n_symbols", "n_dup_lines",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        repeat_words("h").alias("n_repeat_words"),
        let(F.struct(
            ((F.col("n_symbols") > 0) | F.rlike("text", F.lit(r"[»«•·]|!!"))).alias("marked"),
            boilerplate(F.col("text")).alias("stock"), F.split("text", "\n", -1).alias("lines"),
        ), lambda x: F.array_join(F.filter(x["lines"], lambda line: line_passes(line, x)), "\n")).alias("clean_text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    left = F.length("clean_text") * 100 >= min_kept_pct * F.length("text")
    return measured.select(
        "row", "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text",
        failed.alias("base_failed"), (~failed & left).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept documents with their cleaned texts, in the columns of the input."""
    return with_text(docs, text_col, quality_rules(docs, id_col, text_col).where("kept"), F.col("clean_text"))
