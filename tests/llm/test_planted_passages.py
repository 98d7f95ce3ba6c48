"""Passages planted in otherwise different documents: what suffix dedup removes, read from ``n_removed``."""

import random

import pytest

from shelfmark.llm import suffix_dedup

LENGTH = 400


def text(rng, size):
    out = ""
    while len(out) < size:
        out += "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) + " "
    return out[:size]


def corpus(n_docs, seed):
    """Documents, and for each the bytes that repeat: passages of 400 bytes and more, and shorter ones of over 50 words."""
    rng = random.Random(seed)
    ascii_text = lambda size: text(rng, size).replace("é", "e")
    long = [ascii_text(size) for size in (LENGTH, LENGTH + 1, 555, 1300)]
    short = [" ".join("ab" if i % 2 else "c" + chr(97 + (i * k) % 26) for i in range(55)) for k in (1, 3)]
    docs, expected = [], {}
    for i in range(n_docs):
        parts, removed = [text(rng, rng.randint(0, 900))], 0
        if i % 3 == 0:
            # The characters around a passage differ from those of its other copies.
            passage = long[(i // 3) % len(long)]
            parts += [f"[{i}]", passage, f"[{i}]", text(rng, rng.randint(0, 900))]
            removed = len(passage)
        elif i % 3 == 1:
            parts += [f"<{i}>", short[i % 2], f"<{i}>"]
        docs.append((i, "".join(parts)))
        expected[i] = removed
    return docs, expected


@pytest.mark.parametrize(("n_docs", "shard_fragments"), [(30, 8000), (30, 2), (600, 8000), (600, 3)])
def test_every_planted_passage_is_removed_and_clean_text_stays(spark, monkeypatch, n_docs, shard_fragments):
    monkeypatch.setattr(suffix_dedup, "SHARD_FRAGMENTS", shard_fragments)
    docs, expected = corpus(n_docs, n_docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).select("id", "n_removed", "n_spans").collect()}
    # Two copies' numbers may share digits beside the passage, which a removed run takes along: up to four characters on each side.
    assert all(want <= got[i][0] <= want + 8 for i, want in expected.items() if want)
    assert all(got[i] == (0, 0) for i, want in expected.items() if not want)
    assert all(got[i][1] == 1 for i, want in expected.items() if want)
