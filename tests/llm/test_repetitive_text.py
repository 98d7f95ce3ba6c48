"""Windows of long and repetitive texts, against counting each window anew."""

import collections
import random
import time

import numpy as np
import pytest

from shelfmark.llm import decontaminate
from shelfmark.llm.shingles import WordHashes


def brute(text, item, size=5, percent=80):
    sequence = lambda t: [tuple(t.split()[i : i + size]) for i in range(max(1, len(t.split()) - size + 1))]
    a, b = sequence(text), sequence(item)
    w, found = min(len(a), len(b)), []
    for s in range(len(a) - w + 1):
        low = sum((collections.Counter(a[s : s + w]) & collections.Counter(b)).values())
        if 100 * low >= percent * (w + len(b) - low):
            found.append((low, -s))
    return (-max(found)[1], max(found)[0]) if found else None


@pytest.mark.parametrize("stretch", [7, 1 << 14])
def test_best_window_of_repetitive_texts(monkeypatch, stretch):
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)
    rng, hits = random.Random(stretch), 0
    for _ in range(300):
        vocabulary = rng.choice(["ab", "abc", "abcdefghij"])
        item = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        at = rng.randint(0, len(words))
        words[at:at] = [w for w in item.split() if rng.random() > 0.02]
        got = decontaminate.Items([(0, item)], 5).matches(" ".join(words), WordHashes(), 80)
        expected = brute(" ".join(words), item)
        assert [(g[1], g[3]) for g in got] == ([expected] if expected else [])
        hits += bool(expected)
    assert hits > 100


def test_starts_are_the_windows_around_the_places():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        width = int(rng.integers(1, n + 1))
        places = np.unique(rng.integers(0, n, int(rng.integers(1, 10))))
        expected = [s for s in range(n - width + 1) if any(s <= p < s + width for p in places)]
        assert decontaminate.starts_around(places, width, n).tolist() == expected
        assert np.concatenate(decontaminate.stretches(np.array(expected), width)).tolist() == expected


def test_one_word_a_hundred_thousand_times():
    items = decontaminate.Items([(0, "word " * 2000)], 5)
    began = time.monotonic()
    assert items.matches("word " * 100_000, WordHashes(), 80) == [(0, 0, 2000, 1996, 1996)]
    assert time.monotonic() - began < 60


def test_equal_items_are_one_entry_and_a_row_each(spark):
    text = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing of it"), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, text)] * 3 + [(8, text), (9, None), (None, text)], "item_id bigint, text string")
    assert sorted((r.id, r.item or 0) for r in decontaminate.contaminated(docs, bench).collect()) == [(1, 0), (1, 7), (1, 7), (1, 7), (1, 8)]
    assert sum(len(b) for b in decontaminate.blocks_of(bench, "item_id", "text")) == 4


def test_an_item_that_holds_a_shingle_more_often_than_the_text():
    assert decontaminate.Items([(0, "again " * 30)], 5).matches("again " * 28, WordHashes(), 80) == [(0, 0, 28, 24, 26)]
    assert decontaminate.Items([(0, "again " * 300)], 5).matches("again " * 28, WordHashes(), 80) == []
