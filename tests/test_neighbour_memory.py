"""Ranking a block of neighbours takes memory by its tile, not by the query table."""

import tracemalloc

import numpy as np

from shelfmark.operators import vectors


def test_many_queries_against_a_full_batch():
    rng = np.random.default_rng(2)
    base = vectors._unit_rows(rng.normal(size=(50, 16)))
    corpus, queries = base[rng.integers(0, 50, 10_000)], base[rng.integers(0, 50, 900)]
    ids = np.array([f"{i:05d}" for i in range(10_000)], object)
    tracemalloc.start()
    rows, names, values = vectors._nearest(queries, corpus, ids, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * 1024 * 1024
    for q in (0, 449, 899):
        scores = np.round(queries[q : q + 1] @ corpus.T, 6)[0]
        best = np.lexsort((ids, -scores))[:50]
        assert list(names[rows == q]) == list(ids[best]) and list(values[rows == q]) == list(scores[best])
