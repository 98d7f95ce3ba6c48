"""Packing along a space-filling curve.

A document's token counts are hashed into a vector, projected to three dimensions
and placed on a Hilbert curve; documents are range-sorted by their place and laid
end to end, and the row of tokens is cut every ``length`` tokens.  Sequences hold
neighbours on the curve, and only the very last one has padding.

Token ids are written once, under the shared checkpoint folder.  The sort moves
(place, id, number) only, and the sum over partitions one row per partition; then
ids meet their position by an ordinary join.  Equal places are told apart by id, so
any number of copies spreads over the range partitions.

Defined cases: a null text is empty, and an empty document is its end token; equal
rows are documents of their own, each placed once; a null id sorts first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.llm.common import partitions, stored
from shelfmark.llm.fst_tokens import Lexicon, encode, lexicon_of, slices

HASHED, DIMENSIONS, BITS = 1024, 3, 10


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of cells (rows of unsigned coordinates) on the Hilbert curve, by Skilling's transpose method."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """``number`` (unique), ``id``, ``place`` on the curve, ``n`` tokens and the ``ids`` as 16-bit bytes."""
    frame = docs.select(F.monotonically_increasing_id().alias("number"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"number bigint, id {frame.schema['id'].dataType.simpleString()}, place bigint, n bigint, ids binary"

    def run(parts):
        lexicon, end = lexicon_of(Lexicon, tokenizer), np.uint16(end_id).tobytes()
        draw = np.random.default_rng(7)
        bucket, projection = draw.integers(0, HASHED, 1 << 16), draw.standard_normal((HASHED, DIMENSIONS))
        for part in parts:
            for first, texts in slices(part.column(2).to_pylist()):
                ids = [x + end for x in encode(texts, lexicon)]
                points = np.empty((len(ids), DIMENSIONS))
                for i, x in enumerate(ids):
                    counts = np.bincount(bucket[np.frombuffer(x, np.uint16)], minlength=HASHED)
                    points[i] = counts @ projection / np.sqrt((counts * counts).sum())
                cells = np.clip((np.tanh(points) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).slice(first, len(ids)), part.column(1).slice(first, len(ids)), pa.array(hilbert(cells)),
                    pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["number", "id", "place", "n", "ids"])

    return frame.mapInArrow(run, schema)


def positions(tokens: DataFrame) -> DataFrame:
    """The position of every document's first token in the row of all tokens, along the curve."""
    spark = tokens.sparkSession
    order = tokens.select("place", "id", "number", "n").repartitionByRange(partitions(spark), "place", "id", "number").sortWithinPartitions("place", "id", "number")

    def run(parts):
        part_id, at = TaskContext.get().partitionId(), 0
        for part in parts:
            n = np.asarray(part.column(3), np.int64)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([
                part.column(2), pa.array(ends - n), part.column(3), pa.array(np.full(len(n), part_id, np.int32))], ["number", "local", "n", "part"])
            at = int(ends[-1]) if len(n) else at

    local = stored(order.mapInArrow(run, "number bigint, local bigint, n bigint, part int"), "order")
    sums = local.groupBy("part").agg(F.sum("n").alias("all"))  # one row per partition
    base = sums.select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("base"))
    return local.join(F.broadcast(base), "part").select("number", (F.col("base") + F.col("local")).alias("position"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: ``id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids`` (16-bit) and ``ids_crc32``."""
    tokens = stored(encoded(docs, tokenizer, id_col, text_col, end_id), "tokens")
    placed = tokens.select("number", "id", "n", "ids").join(positions(tokens), "number").select("id", "n", "position", "ids")
    names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"]
    schema = (f"id {placed.schema['id'].dataType.simpleString()}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
              "ids_crc32 bigint, ids binary")

    def run(parts):
        for part in parts:
            rows, of = [], []
            for i, (n, position, ids) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                values, start = np.frombuffer(ids, np.uint16), 0
                while start < n:
                    sequence, offset = divmod(position + start, length)
                    stop = min(n, start + length - offset)
                    cut = values[start:stop]
                    rows.append((start, stop - start, n, sequence, offset, zlib.crc32(cut.astype("<u4").tobytes()), cut.tobytes()))
                    of.append(i)
                    start = stop
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names)

    return placed.mapInArrow(run, schema)
