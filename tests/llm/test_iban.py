"""Where account numbers end."""

import pytest

from shelfmark.llm import pii


@pytest.mark.parametrize("number, after", [
    ("DE89 3704 0044 0532 0130 00", " Please"), ("GB82 WEST 1234 5698 7654 32", " Call"), ("DE89 3704 0044 0532 0130 00", " BIC COBADEFF"),
    ("DE89 3704 0044 0532 0130 00", " 2024-01-01"), ("NO9386011117947", " X1"), ("MT84MALT011000012345MTLCAST001S", ", then"),
])
def test_iban_ends_where_its_country_says(spark, number, after):
    got = pii.find_pii(spark.createDataFrame([(1, f"iban {number}{after}")], "doc_id bigint, text string")).collect()
    assert [(s.kind, s.start, s.end) for s in got[0].spans if s.kind == "iban"] == [("iban", 5, 5 + len(number))]
