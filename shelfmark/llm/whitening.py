"""Whitening of embeddings by a bidiagonal qd solver.

Four passes over the table, none of which shuffles a row:

1. exact sums of every dimension;
2. blockwise QR of the centred rows: a task folds its rows into one triangle, triangles are
   folded by a tree of bounded fan-in, and R'R / n is the covariance;
3. R goes through the solver of ``bidiagonal`` (dimensions x dimensions, whatever the table's size), and the
   covariance of the whitened rows is measured, again by a tree;
4. every row is whitened.

Entries become integers first, x = floor(scale * c) + offset, so that sums and deviations are exact: plain
64-bit arithmetic where it cannot overflow, Python integers otherwise.

Defined cases: a vector is left out if it is null or empty or holds a null, a NaN, an infinity or an
entry whose integer is no long, or if its length is not the commonest (of equally common ones the larger);
repeated rows, null ids and ids that repeat are rows like others; components whose
singular value is zero to working precision have no whitened form and are not returned, so a table
with one distinct vector, like an empty one, gives no rows; a deviation beyond 38 digits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.bidiagonal import EPS, singular
from shelfmark.llm.common import stored

#: Rows folded into a triangle at once, and triangles folded by one task of the tree.
BLOCK, FAN = 4096, 16
LIMIT = 1 << 62


def integers(vectors: pa.Array, scale: int, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length in a batch: the positions of its usable vectors, and these as rows of integers."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    valid = np.flatnonzero(~np.asarray(vectors.is_null()))
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]  # nulls become NaN
    for length in np.unique(sizes[valid]):
        if not length:
            continue
        rows = valid[sizes[valid] == length]
        values = np.floor(flat[starts[rows][:, None] + np.arange(length)].astype(np.float64) * scale)
        usable = (np.abs(values) < LIMIT).all(axis=1)  # false for NaN and infinities
        yield rows[usable], values[usable].astype(np.int64) + offset


def total(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    safe = not len(x) or int(np.abs(x).max()) < LIMIT // len(x)
    return [int(s) for s in (x if safe else x.astype(object)).sum(axis=0)]


def centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - S, exactly."""
    if n * largest < LIMIT // 2:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(d: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    if d.dtype != object and len(d) and int(np.abs(d).max()) ** 2 * d.shape[1] < LIMIT:
        return (d * d).sum(axis=1).tolist()
    d = d.astype(object)
    return (d * d).sum(axis=1).tolist()


def tree(partials: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str) -> np.ndarray | None:
    """The product of all ``value`` arrays, folded ``FAN`` at a time in order of ``part``."""
    partials = stored(partials, name)
    last = partials.agg(F.max("part")).head()[0]
    if last is None:
        return None

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        held = None
        for value in group.sort_values("part")["value"]:
            held = np.asarray(value) if held is None else combine(held, np.asarray(value))
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN], "value": [held]})

    while last > 0:
        last //= FAN
        partials = partials.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(fold, "part bigint, value array<double>")
    return np.array(partials.select("value").head()[0])


def triangles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The triangle of two triangles laid one over the other."""
    d = int(np.sqrt(len(a)))
    return np.linalg.qr(np.vstack([a.reshape(d, d), b.reshape(d, d)]), mode="r").ravel()


def moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count, means and centred products of the rows of both."""
    k = int(np.sqrt(len(a)))  # 1 + k + k * k values
    (m, mean_a, sum_a), (n, mean_b, sum_b) = ((x[0], x[1 : k + 1], x[k + 1 :].reshape(k, k)) for x in (a, b))
    gap = mean_b - mean_a
    return np.concatenate([[m + n], mean_a + gap * (n / (m + n)), (sum_a + sum_b + np.outer(gap, gap) * (m * n / (m + n))).ravel()])


def moments_of(w: np.ndarray) -> np.ndarray:
    mean = w.mean(axis=0)
    return np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])


class Fit:
    """What the passes over a table need to know of it; sent to the tasks."""

    def __init__(self, length: int, n: int, sums: list[int], largest: int, scale: int, offset: int):
        self.length, self.n, self.sums, self.largest, self.scale, self.offset = length, n, sums, largest, scale, offset
        self.projection = np.zeros((length, 0))

    def rows(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Positions and centred integers of the batch's vectors of the fitted length."""
        for at, x in integers(vectors, self.scale, self.offset):
            if x.shape[1] == self.length:
                return at, centred(x, self.n, self.sums, self.largest)
        return np.zeros(0, np.int64), np.zeros((0, self.length), np.int64)

    def real(self, d: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (d / self.n).astype(np.float64)


def sums_of(frame: DataFrame, scale: int, offset: int) -> tuple[int, int, list[int], int] | None:
    """Length, count, exact sums and largest magnitude of the vectors of the commonest length."""

    def run(parts):
        held: dict[int, list] = {}
        for part in parts:
            for _, x in integers(part.column(1), scale, offset):
                if len(x):
                    own = held.setdefault(x.shape[1], [0, [0] * x.shape[1], 0])
                    own[0] += len(x)
                    own[1] = [a + b for a, b in zip(own[1], total(x), strict=True)]
                    own[2] = max(own[2], int(np.abs(x).max()))
        for length, (n, sums, largest) in held.items():
            k = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()),
                 pa.array(map(Decimal, sums), pa.decimal128(38, 0)), pa.array([largest] * k, pa.int64())], ["length", "at", "n", "total", "largest"])

    partials = frame.mapInArrow(run, "length int, at int, n bigint, total decimal(38,0), largest bigint")
    merged = stored(partials.groupBy("length", "at").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.max("largest").alias("largest")), "sums")
    top = merged.where("at = 0").orderBy(F.col("n").desc(), F.col("length").desc()).head()
    if top is None:
        return None
    rows = sorted(merged.where(F.col("length") == top["length"]).collect(), key=lambda r: r["at"])  # one row per dimension
    return top["length"], top["n"], [int(r["total"]) for r in rows], max(r["largest"] for r in rows)


def per_task(fit: Fit, element: Callable[[np.ndarray], np.ndarray], combine: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """A task's rows, folded block by block into one element."""

    def run(parts):
        held = None
        for part in parts:
            _, d = fit.rows(part.column(1))
            for first in range(0, len(d), BLOCK):
                own = element(fit.real(d[first : first + BLOCK]))
                held = own if held is None else combine(held, own)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held.tolist()], pa.list_(pa.float64()))], ["part", "value"])

    return run


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000,
) -> DataFrame:
    """``id``, ``n``, ``deviation`` (decimal), ``whitened`` and ``explained`` (arrays by component) and ``identity_error`` for every usable row."""
    frame = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    id_type = frame.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n bigint, deviation decimal(38,0), whitened array<double>"
    nothing = frame.limit(0).selectExpr(
        "id", "0L AS n", "CAST(0 AS decimal(38,0)) AS deviation", "array(0D) AS whitened", "array(0D) AS explained", "0D AS identity_error")
    found = sums_of(frame, scale, offset)
    if found is None:
        return nothing
    fit = Fit(*found, scale, offset)
    partial = "part bigint, value array<double>"

    def triangle(rows: np.ndarray) -> np.ndarray:
        r = np.zeros((fit.length, fit.length))
        small = np.linalg.qr(rows, mode="r")
        r[: len(small)] = small
        return r.ravel()

    r = tree(frame.mapInArrow(per_task(fit, triangle, triangles), partial), triangles, "triangles").reshape(fit.length, fit.length)
    values, vectors = singular(r / np.sqrt(fit.n))
    kept = int((values > fit.length * 4 * EPS * values[0]).sum()) if values[0] else 0
    kept = min(kept, components)
    if not kept:
        return nothing
    fit.projection = vectors[:, :kept] / values[:kept]
    explained = (values[:kept] ** 2 / (values**2).sum()).tolist()
    spread = tree(frame.mapInArrow(per_task(fit, lambda x: moments_of(x @ fit.projection), moments), partial), moments, "moments")
    error = float(np.abs(spread[kept + 1 :].reshape(kept, kept) / fit.n - np.eye(kept)).max())

    def run(parts):
        for part in parts:
            at, d = fit.rows(part.column(1))
            w = fit.real(d) @ fit.projection
            exact = [Decimal(x) if x < 10**38 else None for x in deviations(d)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), pa.array([fit.n] * len(at), pa.int64()), pa.array(exact, pa.decimal128(38, 0)),
                 pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), kept).cast(pa.list_(pa.float64()))], ["id", "n", "deviation", "whitened"])

    return frame.mapInArrow(run, schema).withColumns({"explained": F.array(*map(F.lit, explained)), "identity_error": F.lit(error)})
