"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

One row-local projection in DataFrame functions.  Each pattern looks only at texts
that can hold it, and is written so that a long run of its characters is read once.
A proposal's score is its kind's own, raised by a checksum that holds and by a
context word nearby; it stays from ``threshold`` on.  E-mail addresses, IP
addresses, cards and phone numbers stay whatever the context; account numbers need
their checksum; social security numbers need a context word.

Defined cases: a null text is empty and has no spans; equal rows get equal spans.
Positions are code points, the end exclusive.  Spans of different kinds may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import rows_of
from shelfmark.llm.spans import regex_spans

#: Kinds in the order of the results; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Characters of an account number by country: the registry's, and those in use without an entry there.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
#: Java patterns.  Look-behinds and possessive repeats change no match; they keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a kind to be possible at all.
POSSIBLE = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Score of a format alone, and what a checksum and a context word add.
SCORE = {"email": 0.7, "ip": 0.6, "card": 0.5, "phone": 0.5, "iban": 0.2, "ssn": 0.35}
CHECKSUM, CONTEXT, WINDOW = 0.4, 0.2, 40
WORDS = {
    "email": "mail|contact|write", "ip": r"\bip\b|address|host|server", "card": "card|visa|credit|pay", "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta", "ssn": "ssn|social security",
}


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(match: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97, letters counting 10 to 35."""
    compact = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.array_remove(F.split(turned, ""), ""), F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    return {
        "email": F.lit(True), "ip": match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": n.between(16, 19) & F.call_function("luhn_check", digits(match)), "phone": n.between(8, 15),
        "iban": F.lit(True), "ssn": ~match.rlike(r"^(?:000|666|9)|-00-|-0000$"),
    }[kind]


def scored(kind: str, text: Column, span: Column) -> Column:
    """A span's score: its format, its checksum, and a context word within ``WINDOW`` characters."""
    start = F.greatest(span["start"] - WINDOW, F.lit(0))
    around = F.lower(F.substr(text, start + 1, span["end"] - start + WINDOW))
    near = F.when(around.rlike(WORDS[kind]), F.lit(CONTEXT)).otherwise(F.lit(0.0))
    check = {"card": F.lit(CHECKSUM), "iban": F.when(mod97(span["match"]), F.lit(CHECKSUM)).otherwise(F.lit(0.0))}.get(kind, F.lit(0.0))
    return F.lit(SCORE[kind]) + check + near


def kind_spans(kind: str, text: Column, threshold: float) -> Column:
    found = F.filter(regex_spans(text, PATTERNS[kind], text.rlike(POSSIBLE[kind])), lambda s: valid(kind, s["match"]))
    with_score = F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), scored(kind, text, s).alias("score")))
    return F.filter(with_score, lambda s: s["score"] >= threshold - 1e-9)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: ``row``, ``id``, ``spans`` (kind, start, end, score; by kind as listed, then start)."""
    texts = rows_of(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    each = texts.select("row", "id", *(kind_spans(k, F.col("text"), threshold).alias(k) for k in KINDS))
    return each.select("row", "id", F.concat(*KINDS).alias("spans"))
