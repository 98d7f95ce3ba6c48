"""What keeps index lists short and their words cheap: frequent shingles are told in a full sketch, words hashed at once."""

import random

import numpy as np

from shelfmark.llm import jaccard, shingles


def test_a_shingle_stands_out_of_full_counters():
    counts = np.random.default_rng(3).poisson(100, jaccard.COUNTERS)
    counts[:50] += 80
    counts[50:60] += 100_000
    found = jaccard.levels(counts)
    assert (found[:50] > 0).all() and (found[50:60] > found[:50].max()).all() and (found[60:] > 0).mean() < 0.001
    assert not jaccard.levels(np.zeros(jaccard.COUNTERS, np.int64)).any()


def test_blocks_out_of_reach_by_place(spark):
    rows = [(10, 90, 10, 90, 100, 100, True), (0, 100, 19, 81, 100, 100, False), (0, 100, 10, 90, 100, 100, True), (0, 90, 15, 75, 90, 90, False)]
    frame = spark.createDataFrame(rows, "pos_x int, rest_x int, pos_y int, rest_y int, least_x int, least_y int, want boolean")
    assert [r.got for r in frame.select(jaccard.reach(80).alias("got")).collect()] == [r[-1] for r in rows]


def test_words_are_told_apart_as_written(monkeypatch):
    random.seed(8)
    letters = "abcXYZ09é☃😀_-"
    word = lambda: "".join(random.choice(letters) for _ in range(random.choice([1, 1, 2, 3, 9, 511, 512, 513, 700])))
    texts = ["".join(word() + random.choice([" ", "\n", "\t\x0b ", "\r\n", "\x0c", "\u00a0"]) for _ in range(300)) for _ in range(6)]
    texts += [None, "", " \n", "a", " a", "a A", "\ud800 x", "x" * 3000, " ".join(["same"] * 400)]
    seen, back = {}, {}
    for piece in (1 << 20, 700):
        monkeypatch.setattr(shingles, "PIECE", piece)
        for text in texts:
            found, want = shingles.word_hashes(text).tolist(), shingles.text_words(text)
            assert len(found) == len(want)
            for h, w in zip(found, want, strict=True):
                assert seen.setdefault(w, h) == h and back.setdefault(h, w) == w
    assert len(seen) > 500
