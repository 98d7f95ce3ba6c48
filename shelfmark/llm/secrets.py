"""Secret scans through a trigram index.

From every rule's pattern a Boolean query over trigrams is derived: alternatives
(or) of trigrams that a match must contain (and).  The index holds the postings of
all trigrams asked for; they are intersected per document, which names the rules
that can match it.  Candidates are verified by the rules' patterns.  A rule with an
alternative that has no mandatory trigram, such as a run of hexadecimal digits,
scans every text.

Postings and queries are in lower case, so a rule that ignores case asks the same
index.  A document has at most one posting per trigram asked for.

Defined cases: a null text is empty and has no secrets; equal rows get equal spans.
Positions are code points, the end exclusive.
"""

from __future__ import annotations

from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import let
from shelfmark.llm.spans import regex_spans

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "slack", "jwt", "private_key")
#: What follows a key's first line: all up to its END line, or else the header lines and base64 that are there.
GAP = r"(?:[\x20\x09-\x0D]|\\[nr])"
KEY_BODY = (
    r"(?:(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END \1-----"
    rf"|(?:{GAP}++(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):[^\r\n\\]*+|[A-Za-z0-9+/=]{{16,}}+))++"
    r"(?:[\x20\x09]*+(?:\r?\n|\\n)[A-Za-z0-9+/=]++(?![\x20\x09]*+[^\x20\x09\r\n\\]))?+)?+")
#: Java patterns of the rules; possessive repeats and the look-behind change no match.
PATTERNS = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}+",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+",
    "private_key": r"-----BEGIN ([A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?)-----" + KEY_BODY,
}
#: Alternatives that a query may have; beyond, the rule scans fully.
ALTERNATIVES = 64


def literals(pattern: str) -> list[list[str]] | None:
    """Alternatives, each a list of strings that every match holds; None if there are too many."""

    def joined(a: list[str], b: list[str]) -> list[str]:
        return [*a[:-1], a[-1] + b[0], *b[1:]]

    def walk(items) -> list[list[str]]:
        found = [[""]]
        for op, arg in items:
            if op is kinds.LITERAL:
                choice = [[chr(arg)]]
            elif op is kinds.SUBPATTERN:
                choice = walk(arg[-1])
            elif op is kinds.BRANCH:
                choice = [x for branch in arg[1] for x in walk(branch)]
            elif op in (kinds.MAX_REPEAT, kinds.POSSESSIVE_REPEAT) and arg[0] == 0 and arg[1] == 1 and arg[2][0][0] is kinds.LITERAL:
                choice = [[""], *walk(arg[2])]
            elif op in (kinds.MAX_REPEAT, kinds.POSSESSIVE_REPEAT) and arg[0] > 0:
                choice = [[*x, ""] for x in walk(arg[2])]
            elif op in (kinds.ASSERT, kinds.ASSERT_NOT, kinds.AT):
                choice = [[""]]
            else:
                choice = [["", ""]]
            found = [joined(a, b) for a in found for b in choice]
            if len(found) > ALTERNATIVES:
                raise OverflowError
        return found

    try:
        return walk(parser.parse(pattern))
    except OverflowError:
        return None


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives of mandatory trigrams, in lower case; empty if the rule has to scan fully."""
    options = [sorted({run.lower()[i : i + 3] for run in runs for i in range(len(run) - 2)}) for runs in literals(pattern) or [[]]]
    return options if all(options) else []


QUERIES = {kind: trigram_query(p) for kind, p in PATTERNS.items()}


def postings(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """The index: ``id``, ``body`` and each asked trigram that the text holds."""
    held = let(F.lower(text_col), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """``c_id``, ``c_body`` and the rules whose query the document's postings satisfy."""
    per_doc = index.groupBy(F.col("id").alias("c_id"), F.col("body").alias("c_body")).agg(F.collect_set("trigram").alias("held"))
    met = [F.when(F.arrays_overlap(F.array(*(
        F.when(F.size(F.array_except(F.array(*map(F.lit, option)), "held")) == 0, F.lit(1)) for option in options)), F.array(F.lit(1))), F.lit(kind))
        for kind, options in queries.items() if options]
    return per_doc.select("c_id", "c_body", F.array_compact(F.array(*met)).alias("rules")).where(F.size("rules") > 0)


def strong(kind: str, match: Column) -> Column:
    """What a match must have besides its form."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, PATTERNS["assign"], 1)) >= 12
    return F.length(match) >= 18 if kind == "access" else F.lit(True)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``row``, ``id``, ``spans`` (kind, start, end; by start, then kind as listed)."""
    trigrams = sorted({t for options in QUERIES.values() for option in options for t in option})
    found = candidates(postings(docs, id_col, text_col, trigrams), QUERIES)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    read = rows.join(found, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("body") == F.col("c_body")), "left")
    asked = F.coalesce("rules", F.array().cast("array<string>"))
    text = F.col("text")

    def spans(order: int, kind: str) -> Column:
        possible = F.array_contains(asked, kind) if QUERIES[kind] else text.rlike(PATTERNS[kind])
        verified = F.filter(regex_spans(text, PATTERNS[kind], possible), lambda s: strong(kind, s["match"]))
        return F.transform(verified, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.sort_array(F.concat(*(spans(i, k) for i, k in enumerate(KINDS))))
    return read.select("row", "id", every.alias("spans"))
