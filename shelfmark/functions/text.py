"""Text functions built from Spark's own expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
ASCII_WORD = r"[a-z0-9]+"


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and the plain letter each decomposes to."""
    source, target = [], []
    for start, end in ((0x00C0, 0x024F), (0x1E00, 0x1EFF)):
        for code in range(start, end + 1):
            base = unicodedata.normalize("NFD", chr(code))[0]
            if base.isascii() and base.isalpha():
                source.append(chr(code))
                target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()
# Letters without a decomposition (fixed values).
_LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i"}


def normalise(value: Column) -> Column:
    """Keyword form: lower case with accents folded."""
    folded = F.translate(F.lower(value), _ACCENTED, _PLAIN)
    for letter, plain in _LIGATURES.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return folded


def title_key(title: Column, longest: int = 256) -> Column:
    """Exact-match form of a title; longer titles have none."""
    return F.when(F.length(title) <= longest, normalise(title))


def tokens(text: Column) -> Column:
    """Word tokens in order, lower-cased (P10)."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def token_set(text: Column) -> Column:
    """Distinct ASCII tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(ASCII_WORD), F.lit(0)))


def space_split(text: Column) -> Column:
    """Lower-cased pieces between white space, hyphens counting as space."""
    spaced = F.replace(F.lower(text), F.lit("-"), F.lit(" "))
    return F.array_remove(F.split(spaced, r"(?U)[\s\x1c-\x1f]+"), "")


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two token sets; 0 when either is empty."""
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / union
    )


def non_empty(value: Column) -> Column:
    """Null for an empty string, so that ``concat_ws`` and ``coalesce`` skip it."""
    return F.nullif(value, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once however often it is used.

    Plain composition would copy the whole expression for every use.
    """
    return F.transform(F.array(value), use)[0]


# White space that is stripped: every Unicode space and line break.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(value: Column | str) -> Column:
    """Text without white space at its ends."""
    return F.btrim(value, F.lit(SPACES))


def plain(value: Column) -> Column:
    """Stripped text, '' for null."""
    return F.coalesce(strip(value), F.lit(""))


def stringify(value: Column) -> Column:
    """Trimmed text; null is '' and a JSON array is joined with ', ' (P3)."""
    def one(text: Column) -> Column:
        items = F.filter(
            F.transform(F.from_json(text, "array<string>"), lambda x: strip(F.coalesce(x, F.lit("None")))),
            lambda x: x != "",
        )
        return F.when(text.startswith("["), F.coalesce(F.array_join(items, ", "), text)).otherwise(text)

    return let(plain(value), one)


def utc_text(ts: Column) -> Column:
    """UTC ISO-8601 text ending in Z (P16); sub-seconds only where present."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(seconds, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


def parse_version(value: Column) -> Column:
    """Integer version, null when the text is not one."""
    return F.when(strip(value).rlike(r"^[+-]?\d+$"), strip(value).try_cast("bigint"))
