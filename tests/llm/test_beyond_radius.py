"""Windows whose fingerprint lies outside the radius."""

import random

import numpy as np

from shelfmark.llm import decontaminate
from shelfmark.llm.shingles import WordHashes


def test_windows_beyond_the_radius_are_found():
    """Three of 27 shingles changed: similarity 0.8 exactly, and now and then more than 17 bits differ."""
    random.seed(2)
    beyond = 0
    for k in range(3000):
        words = [f"w{random.randrange(10**9)}" for _ in range(31)]
        other = [*words[:28], f"x{k}", *words[29:]]
        known = WordHashes()
        a, b = (decontaminate.shingle_sequence(decontaminate.hashes(" ".join(t), known), 5) for t in (words, other))
        apart = int(np.bitwise_count(decontaminate.simhashes(a, np.array([0]), 27) ^ decontaminate.simhashes(b, np.array([0]), 27))[0])
        if apart > decontaminate.RADIUS:
            beyond += 1
            items = decontaminate.Items([(0, " ".join(words))], 5)
            assert items.matches(" ".join(other), known, 80) == [(0, 0, 31, 24, 30)]
    assert beyond
