"""Nulls, empty and very long texts, repeated rows, empty tables, clashing names."""

import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import chat, components, decontaminate, fst_tokens, jaccard, line_dedup, packing, pii, quality, secrets, suffix_dedup

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def bench_of(docs):
    return docs.select(F.col("doc_id").alias("item_id"), "text")


OPERATORS = {
    "lines": line_dedup.dedup_lines, "pack": lambda d: packing.pack(d, TOKENIZER), "contaminated": lambda d: decontaminate.contaminated(d, bench_of(d)),
    "quality": quality.quality_rules, "jaccard": jaccard.jaccard_components, "suffix": suffix_dedup.remove_repeats, "pii": pii.find_pii,
    "secrets": secrets.find_secrets, "tokens": lambda d: fst_tokens.token_counts(d, TOKENIZER),
}
FILTERS = {
    "quality": quality.keep_good, "lines": line_dedup.drop_lines, "jaccard": jaccard.keep_one,
    "clean": lambda d: decontaminate.without_contaminated(d, bench_of(d).limit(1)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(odd_docs, name):
    ids = collections.Counter(r.id for r in OPERATORS[name](odd_docs).select("id").collect())
    docs = collections.Counter(r.doc_id for r in odd_docs.collect())
    if name in ("pack", "contaminated"):
        assert set(ids) == set(docs) if name == "pack" else set(ids) <= set(docs)
    else:
        assert ids == docs


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(no_docs, name):
    assert OPERATORS[name](no_docs).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_the_columns(odd_docs, no_docs, name):
    kept = FILTERS[name](odd_docs)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    assert all(r.row == "r" and r.n == 1 and r.node == "d" for r in kept.collect())
    assert FILTERS[name](no_docs).collect() == []


def test_jaccard_cases(odd_docs):
    got = collections.defaultdict(set)
    for r in jaccard.jaccard_components(odd_docs).collect():
        got[r.id].add((r.component, r.n_shingles > 0))
    assert got[2] == got[3] == {(1, True)} and got[4] == {(4, False)} and got[5] == {(5, False)} and got[6] == {(6, False)}
    assert got[9] == got[8] == {(8, True)} and got[None] == {(1, True), (None, False)}
    kept = collections.Counter(r.doc_id for r in jaccard.keep_one(odd_docs).collect())
    assert kept[3] == kept[2] == 0 and all(kept[i] == 1 for i in (4, 5, 6, 7, 8, 10, 11)) and kept[9] == 0


def test_suffix_cases(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(450))
    docs = [(1, text), (1, text), (2, "z" * 401), (3, "y" * 400), (4, text[:399]), (5, None), (None, text[20:430] + "é")]
    rows = {(r.id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert rows == {(1, 450): (450, 1), (2, 401): (401, 1), (3, 400): (0, 0), (4, 399): (0, 0), (5, 0): (0, 0), (None, 412): (410, 1)}


def test_line_cases(odd_docs):
    got = {r.id: r for r in line_dedup.dedup_lines(odd_docs, min_docs=2).collect()}
    assert got[10].clean_text == "same\nline\nsame\n\nline" and got[5].clean_text is None and got[5].n_lines == 0
    assert got[9].clean_text == "" and got[8].clean_text == "one two" and got[6].clean_text == " \n\t "


def test_pack_empty_and_null(spark):
    rows = packing.pack(spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id bigint, text string"), TOKENIZER).collect()
    assert sorted((r.id, r.length, r.sequence_id) for r in rows) == [(1, 1, 0), (2, 1, 0), (2, 1, 0)] and sorted(r.offset for r in rows) == [0, 1, 2]


def test_long_runs_are_linear(spark):
    """Texts that make careless patterns quadratic, or overflow a recursive matcher."""
    docs = [(i, t * 60_000) for i, t in enumerate(("a", "1", "1.", "1 ", "a@", "+1", "eyJ", "token", "-", "ab.", "#", " ", "a\n", "1a "))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert pii.find_pii(df).count() == secrets.find_secrets(df).count() == quality.quality_rules(df).select("kept").count() == len(docs)
    assert {r.id: len(r.spans) for r in secrets.find_secrets(df).collect()}[0] == 1
    assert sum(len(r.spans) for r in pii.find_pii(df).collect()) >= 0
    assert line_dedup.dedup_lines(df).count() == len(docs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (200, 160), (170, 160)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 160: 150, 170: 150, 200: 150}
    assert components.components(spark.createDataFrame([], "a int, b int")).collect() == []


def test_chat_cases(spark):
    data = [
        (1, None, None, None), (1, 1, "user", "</s>[INST] \\ <s\\> [/INST\\\\]"), (1, 1, "assistant", ""), (None, 0, "assistant", "a"), (2, 0, "we[INST]ird\nrole</s>", "x" * 30_000),
        (2, 0, "we[INST]ird\nrole</s>", "x" * 30_000)]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    read = {r.conv: r for r in chat.read_back(chat.chat_windows(df)).where("window = 0").collect()}
    assert [tuple(t) for t in read[1].turns] == [("", ""), ("assistant", ""), ("user", data[1][3])] and read[1].targets == [""]
    assert [tuple(t) for t in read[None].turns] == [("assistant", "a")] and read[2].turns[0].role == data[4][2]
    assert chat.chat_windows(df).where("conv = 2").count() == 2
    assert chat.chat_windows(df.where("false")).collect() == []
