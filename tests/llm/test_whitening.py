"""Whitening against exact integers and a library's eigenvectors; the solver on hard matrices."""

import math
from fractions import Fraction

import numpy as np
import pytest

from shelfmark.llm import bidiagonal, queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def matrices():
    draw = np.random.default_rng(0)
    square = lambda: draw.standard_normal((48, 48))
    p, q = (np.linalg.qr(square())[0] for _ in range(2))
    zeros = square()
    zeros[:, 5], zeros[:, 9] = 0, zeros[:, 8]
    return {
        "random": square(), "tall": draw.standard_normal((900, 48)), "wide": draw.standard_normal((5, 48)), "graded": square() * np.logspace(0, -8, 48), "identity": np.eye(48) * 3,
        "orthogonal": q, "near": p @ np.diag(1 + 1e-10 * np.arange(48)) @ q, "nearer": p @ np.diag(1 + 1e-14 * np.arange(48)) @ q,
        "two groups": p @ np.diag([2.0] * 20 + [1.0] * 28) @ q, "low rank": draw.standard_normal((200, 10)) @ draw.standard_normal((10, 48)), "zero and equal columns": zeros,
        "zeros": np.zeros((48, 48)), "one": draw.standard_normal((3, 1)), "zero inside": np.diag([3.0, 0, 2, 0, 1]) + np.diag([1.0] * 4, 1), "huge": square() * 1e150, "tiny": square() * 1e-150,
    }


@pytest.mark.parametrize("name", matrices())
def test_solver(name):
    m = matrices()[name]
    values, v = bidiagonal.singular(m)
    want = np.zeros(m.shape[1])
    found = np.linalg.svd(m, compute_uv=False)
    want[: len(found)] = found
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top and np.abs(v.T @ v - np.eye(len(v))).max() < 1e-10
    assert np.abs((m / top).T @ ((m / top) @ v) - v * (values / top) ** 2).max() < 1e-13


def test_dqds_is_relatively_accurate():
    """The small values of a strongly graded bidiagonal keep all their digits; their exact product is that of the diagonal."""
    a, b = [10.0 ** -(3 * i) for i in range(9)], [10.0 ** -(3 * i + 1) for i in range(8)]
    squares = bidiagonal.dqds([x * x for x in a], [x * x for x in b])
    exact = math.prod(Fraction(x) ** 2 for x in a)
    assert abs(float(math.prod(map(Fraction, squares)) / exact) - 1) < 1e-13
    big, small = bidiagonal.dqds([1.0, 1e-40], [1.0, ])
    assert abs(big / 2 - 1) < 1e-15 and abs(small / 5e-41 - 1) < 1e-14


def brute(rows, components=32):
    kept = [(i, v) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    centred = np.array([[a / n for a in r] for r in d])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, len(e))
    return [i for i, _ in kept], [sum(a * a for a in r) for r in d], centred @ v[:, :k] / np.sqrt(e[:k]), e / e.sum()


def vectors(count=700, d=40):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((count, d)) @ (draw.standard_normal((d, d)) * np.linspace(1, 3, d))
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(base.astype(np.float32))]
    return [*rows, (900, rows[5][1], 1), (900, rows[5][1], 1), (901, None, 1), (902, [None, *rows[1][1][1:]], 1), (903, [float("nan"), *rows[1][1][1:]], 1),
            (904, [*rows[1][1][1:], float("-inf")], 1), (None, rows[9][1], None)]


def test_query(spark, tmp_path):
    rows = vectors()
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_embedding_whitening(spark, str(tmp_path)).collect()
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    ids, deviation, whitened, explained = brute(rows)
    assert len(got) == 32 * len(ids) and {r.n for r in got} == {len(ids)}
    want = {i: (d, w) for i, d, w in zip(ids, deviation, whitened, strict=True)}
    signs = {r.component: np.sign(r.whitened * want[0][1][r.component - 1]) for r in got if r.vec_id == 0}
    for r in got:
        d, w = want[r.vec_id]
        assert r.deviation == d and abs(r.whitened * signs[r.component] - w[r.component - 1]) < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10 and r.identity_error < 1e-9


def test_many_partitions_and_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = [r for r in vectors(300, 6) if r[1] and None not in r[1] and all(map(math.isfinite, r[1]))]
    frame = spark.createDataFrame(rows, SCHEMA)
    one, many = (sorted(((r.id or -1, r.deviation, [abs(w) for w in r.whitened]) for r in whitening.whiten(frame.repartition(k)).collect())) for k in (1, 9))
    assert [x[:2] for x in one] == [x[:2] for x in many] and np.allclose([x[2] for x in one], [x[2] for x in many], atol=1e-10)


def test_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n int, whitened string")
    ids = lambda rows: sorted({r.id for r in whitening.whiten(frame(rows)).collect()})
    assert ids([]) == ids([(1, None, 1, "a"), (2, [], 1, "a"), (3, [None], 1, "a")]) == ids([(1, [1.0, 2.0], 1, "a")] * 3) == []
    assert ids([(1, [1.0, 2.0], 1, "a"), (2, [3.0, 1.0], 1, None), (3, [1.0], 1, None), (4, [], 1, None), (5, [1e300, 1.0], 1, None)]) == [1, 2]
    flat = whitening.whiten(frame([(i, [float(i), 5.0, float(i), 2.0], 1, "a") for i in range(9)])).collect()
    assert {len(r.whitened) for r in flat} == {1} and flat[0].identity_error < 1e-9 and flat[0].explained == [1.0]


def test_large_integers_stay_exact(spark):
    rows = [(1, [1e16, 0.0]), (2, [-3e16, 1.0]), (3, [2e15, 2.0]), (4, [5.0, 7.0])]
    got = {r.id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    for (i, _), own in zip(rows, x, strict=True):
        assert got[i].deviation == sum((4 * a - sum(r[j] for r in x)) ** 2 for j, a in enumerate(own))
    assert got[1].identity_error < 1e-4
