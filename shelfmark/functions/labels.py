"""Relevance labels and their grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import strip

# Relevance grades of the labels, and the dataset's letter codes.
GRADES = {"exact": 3, "substitute": 2, "complement": 1, "irrelevant": 0}
CODES = {"e": 3, "s": 2, "c": 1, "i": 0}


def _lookup(table: dict[str, int], key: Column) -> Column:
    cells = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*cells), key)


def label_grade(label: Column) -> Column:
    """Grade of a full label name; null marks an unknown one."""
    return _lookup(GRADES, label)


def dataset_grade(label: Column) -> Column:
    """Grade of a letter code or a name in any case."""
    return _lookup({**CODES, **GRADES}, F.lower(strip(label)))
