"""Prefix products along sorted keys, for keys of any size.

Rows are range-sorted by key and order, every task folds its own stretch, and only the
keys that span several partitions (at most two at each boundary) are stitched: their
stretch totals, a few numbers for each partition, are composed in order, and every row of
such a stretch is multiplied by what lies before it.  No key's rows have to be in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import partitions, stored

Element = tuple[int, ...]


def scan(rows: DataFrame, key: str, order: list[Column], element: list[str], product: Callable[[Element, Element], Element], name: str) -> DataFrame:
    """All columns of ``rows``, with those in ``element`` replaced by the product of the key's rows up to here.

    ``key`` is a bigint column without nulls, the elements are bigints, ``order`` has to end in
    something that tells a key's rows apart as far as the result depends on it.  ``product`` is associative.
    """
    kept = [c for c in rows.columns if c not in element and c != key]
    frame = rows.repartitionByRange(partitions(rows.sparkSession), F.col(key), *order).sortWithinPartitions(F.col(key), *order).select(key, *element, *kept)
    width = len(element)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)

    def fold(parts):
        number, at, held, nth = TaskContext.get().partitionId(), None, None, 0
        for part in parts:
            out = []
            for k, *x in zip(*(part.column(i).to_pylist() for i in range(width + 1)), strict=True):
                held, nth = (product(held, tuple(x)), nth + 1) if k == at else (tuple(x), 1)
                at = k
                out.append((*held, nth))
            if out:
                *values, nths = (pa.array(c, pa.int64()) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *values, *part.columns[width + 1 :], pa.array([number] * len(out), pa.int32()), nths],
                    [key, *element, *kept, "stretch", "nth"])

    local = stored(frame.mapInArrow(fold, schema + ", stretch int, nth bigint"), name)
    before = offsets(local, key, element, product)
    if not before:
        return local.drop("stretch", "nth")

    def stitch(parts):
        for part in parts:
            columns = [part.column(i).to_pylist() for i in range(width + 1)]
            out = [
                product(before[s, k], tuple(x)) if (s, k) in before else x
                for s, k, *x in zip(part.column(part.num_columns - 1).to_pylist(), *columns, strict=True)]
            values = zip(*out, strict=True) if out else [[]] * width
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in values), *part.columns[width + 1 : -1]], [key, *element, *kept])

    return local.drop("nth").mapInArrow(stitch, schema)


def offsets(local: DataFrame, key: str, element: list[str], product: Callable[[Element, Element], Element]) -> dict[tuple[int, int], Element]:
    """For each stretch whose key began in an earlier one, the product of all that precedes; at most one entry a stretch."""
    edges = local.groupBy("stretch").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()
    held = defaultdict(set)
    for r in edges:
        held[r["first"]].add(r["stretch"])
        held[r["last"]].add(r["stretch"])
    spanning = [k for k, s in held.items() if len(s) > 1]
    if not spanning:
        return {}
    spark = local.sparkSession
    keys = spark.createDataFrame([(k,) for k in spanning], f"{key} bigint")
    totals = local.join(F.broadcast(keys), key).groupBy(key, "stretch").agg(F.max(F.struct("nth", *element)).alias("t"))  # the last row
    before, at, so_far = {}, None, None
    for r in sorted(totals.collect(), key=lambda r: (r[key], r["stretch"])):
        own = tuple(r["t"][c] for c in element)
        if r[key] == at:
            before[r["stretch"], r[key]] = so_far
            so_far = product(so_far, own)
        else:
            at, so_far = r[key], own
    return before
