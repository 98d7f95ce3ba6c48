"""Hash embeddings, nearest neighbours and rank fusion."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import scale
from shelfmark.functions.text import space_split

DIMS = 384
# A block of query vectors that every task may hold.
QUERY_BLOCK_BYTES = 128 * 1024 * 1024
# A block of corpus vectors in the grid that replaces the broadcast.
CORPUS_BLOCK_BYTES = 256 * 1024 * 1024

# Scores that a task holds at once (8 MB); ranking them takes some copies.
TILE_SCORES = 1024 * 1024

# (id, text) table -> (id, embedding) table.
Embedder = Callable[[DataFrame, str, str], DataFrame]


class _Steps:
    """Dimensions and signs of tokens: sixteen two-byte numbers of the SHA-256, the parity of the first byte as sign.

    A worker keeps what it has hashed, up to a bound.
    """

    BOUND = 500_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.numbers = np.empty((1024, 16), np.uint16)

    def of(self, tokens: list[str]) -> np.ndarray:
        """One row of sixteen numbers per token."""
        if len(self.known) + len(tokens) > self.BOUND:
            self.known.clear()
        places = np.empty(len(tokens), np.int64)
        for i, token in enumerate(tokens):
            at = self.known.get(token)
            if at is None:
                at = self.known[token] = len(self.known)
                if at >= len(self.numbers):
                    self.numbers = np.concatenate([self.numbers, np.empty_like(self.numbers)])
                self.numbers[at] = np.frombuffer(hashlib.sha256(token.encode()).digest(), ">u2")
            places[i] = at
        return self.numbers[places]


_STEPS = _Steps()
# Tokens and cells of the dense matrix that are worked on at once.
STEP_TOKENS, STEP_CELLS = 200_000, 4_000_000


def _hashed(pieces: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, touched cells and normalised values (rows x dims) of one run of rows after another."""
    coded = pieces.values.dictionary_encode()
    numbers = _STEPS.of(coded.dictionary.to_pylist())
    at, sign = (numbers % dims).astype(np.int64), np.where((numbers >> 8) % 2 == 0, 1.0, -1.0)
    tokens, ends = coded.indices.to_numpy(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    tokens, first, n = tokens[pieces.offsets[0].as_py():], 0, len(pieces)
    while first < n:
        last = max(first + 1, min(int(np.searchsorted(ends, ends[first] + STEP_TOKENS, "right")) - 1, first + STEP_CELLS // dims, n))
        count, raw = np.zeros((last - first) * dims, np.int64), np.zeros((last - first) * dims)
        row = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1])) * dims
        for start in range(0, len(row), STEP_TOKENS):  # a long text by itself goes in several steps
            some = tokens[ends[first] + start : min(ends[first] + start + STEP_TOKENS, ends[last])]
            cells = (row[start : start + STEP_TOKENS, None] + at[some]).ravel()
            count += np.bincount(cells, minlength=len(count))
            raw += np.bincount(cells, sign[some].ravel(), len(raw))
        raw = raw.reshape(-1, dims)
        length = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        yield first, count.reshape(-1, dims) > 0, np.divide(raw, length, out=raw, where=length > 0)
        first = last


def _pieces(text: Column) -> Column:
    found = space_split(text)
    return F.when(F.size(found) == 0, F.array(F.lower(text))).otherwise(found)


def _to_pieces(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pieces) of the rows that have a text; a table in one small file is spread over the cores first."""
    return scale.spread(texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select(
        "id", _pieces(F.col("text")).alias("pieces"))


def hash_components(texts: DataFrame, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """Touched components (id, dim, value) of the normalised hash vector (V1)."""
    frame = _to_pieces(texts, id_col, text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, touched, values in _hashed(part.column(1), dims):
                ends = pa.array(np.append(0, np.cumsum(touched.sum(axis=1))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (np.nonzero(touched)[1].astype(np.int32), values[touched])]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(touched)), *lists], ["id", "dim", "value"])

    schema = f"id {frame.schema['id'].dataType.simpleString()}, dim array<int>, value array<double>"
    return frame.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.inline(F.arrays_zip("dim", "value")))


def hash_embedding(texts: DataFrame, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """Dense hash vectors: (id, embedding array<double>)."""
    frame = _to_pieces(texts, id_col, text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, touched, values in _hashed(part.column(1), dims):
                ends = pa.array(np.arange(len(touched) + 1, dtype=np.int32) * dims)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(first, len(touched)), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], ["id", "embedding"])

    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, embedding array<double>").withColumnRenamed("id", id_col)


def column_embedder(encode: Callable[[Column], Column]) -> Embedder:
    """Use a column function (for example a pandas UDF around a model) as embedder."""
    def run(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return texts.where(F.col(text_col).isNotNull()).select(id_col, encode(F.col(text_col)).alias("embedding"))
    return run


def get_embedder(provider: str = "auto", encode: Callable[[Column], Column] | None = None) -> Embedder:
    """"hash", "model" (needs ``encode``), or "auto": the model when given, else the hash."""
    if provider not in ("auto", "hash", "model"):
        raise ValueError("provider must be one of: auto, model, hash")
    if provider == "model" and encode is None:
        raise ValueError("the model provider needs an encode function")
    return hash_embedding if provider == "hash" or encode is None else column_embedder(encode)


def _unit_rows(vectors: Sequence) -> np.ndarray:
    matrix = np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of the k best per query row, ties by id."""
    scores = np.round(scores, 6)
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        rows, cols = np.nonzero(scores >= floor[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
    values, names = scores[rows, cols], ids[cols]
    order = np.lexsort((names, -values, rows))
    rows, names, values = rows[order], names[order], values[order]
    starts = np.searchsorted(rows, np.arange(scores.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], names[keep], values[keep]


def _nearest(queries: np.ndarray, corpus: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a corpus block for every query, in tiles of at most TILE_SCORES scores."""
    step, parts = max(1, TILE_SCORES // max(1, len(ids))), []
    for start in range(0, len(queries), step):
        rows, names, values = _best(queries[start : start + step] @ corpus.T, ids, k)
        parts.append((rows + start, names, values))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def knn(
    corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "product_id", qid_col: str = "qid",
    vector: str = "embedding", block_bytes: int | None = None,
) -> DataFrame:
    """Exact cosine top-k of every query: (qid, id, rank, score) (V3).

    The corpus is not moved: each task multiplies its batches with the query
    matrix and hands on only its own k best per query.  When the measured query
    side is too large for a task, queries and corpus are cut into blocks and
    every pair of blocks becomes one group of bounded size.
    """
    bound = QUERY_BLOCK_BYTES if block_bytes is None else block_bytes
    corpus = corpus.where(F.col(vector).isNotNull()).select(id_col, vector)
    queries = scale.settle(queries.where(F.col(vector).isNotNull()).select(qid_col, vector)).df
    id_type, qid_type = corpus.schema[id_col].dataType, queries.schema[qid_col].dataType
    out = T.StructType([
        T.StructField(qid_col, qid_type), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])
    sized = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(vector)), F.lit(0)).alias("cells")).head()
    blocks = -(-int(sized["cells"]) * 8 // bound) if sized["cells"] else 1
    if blocks <= 1:
        rows = queries.toPandas()
        shared = corpus.sparkSession.sparkContext.broadcast(
            (rows[qid_col].to_numpy(), _unit_rows(rows[vector]) if len(rows) else None))
        part = corpus.mapInPandas(_scan(shared, k, id_col, qid_col, vector), out)
    else:
        part = _grid(corpus, queries, k, id_col, qid_col, vector, blocks, out)
    order = Window.partitionBy(qid_col).orderBy(F.desc("score"), F.asc(id_col))
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan(shared, k: int, id_col: str, qid_col: str, vector: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, matrix = shared.value
        if matrix is None:
            return
        kept: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            ids = batch[id_col].to_numpy()
            rows, names, values = _nearest(matrix, _unit_rows(batch[vector]), ids, k)
            found = pd.DataFrame({"q": rows, id_col: names, "score": values})
            kept = found if kept is None else pd.concat([kept, found])
            kept = kept.sort_values(["q", "score", id_col], ascending=[True, False, True])
            kept = kept[kept.groupby("q").cumcount() < k]
        if kept is not None:
            yield pd.DataFrame({qid_col: qids[kept["q"].to_numpy()], id_col: kept[id_col], "score": kept["score"]})
    return run


def _grid(corpus, queries, k, id_col, qid_col, vector, blocks, out) -> DataFrame:
    total = corpus.agg(F.coalesce(F.sum(F.size(vector)), F.lit(0)).alias("cells")).head()["cells"]
    cells = max(1, -(-int(total) * 8 // CORPUS_BLOCK_BYTES))
    left = corpus.withColumn("_cell", F.pmod(F.xxhash64(id_col), F.lit(cells)).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("_block", F.pmod(F.xxhash64(qid_col), F.lit(blocks)).cast("int")).withColumn(
        "_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))

    def pair(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({f.name: [] for f in out.fields})
        rows, names, values = _nearest(_unit_rows(q[vector]), _unit_rows(c[vector]), c[id_col].to_numpy(), k)
        return pd.DataFrame({qid_col: q[qid_col].to_numpy()[rows], id_col: names, "score": values})

    return left.groupBy("_cell", "_block").cogroup(right.groupBy("_cell", "_block")).applyInPandas(pair, out)


def has_embeddings(catalog: DataFrame, column: str = "embedding") -> bool:
    """Whether any row carries a vector."""
    return column in catalog.columns and not catalog.where(F.col(column).isNotNull()).isEmpty()


def rrf(
    rankings: Sequence[DataFrame], size: int = 10, rank_constant: int = 60,
    keys: Sequence[str] = ("qid",), id_col: str = "product_id", window: int | None = None,
) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; ties keep first appearance (V4).

    With ``window`` only that many leading rows of each list are fused (V6).
    """
    lists = None
    for number, ranking in enumerate(rankings):
        part = ranking.select(*keys, id_col, "rank", F.lit(number).alias("list_no"))
        if window is not None:
            part = part.where(F.col("rank") <= window)
        lists = part if lists is None else lists.unionByName(part)
    seen = F.array_sort(F.collect_list(F.struct("list_no", "rank")))
    score = F.aggregate("seen", F.lit(0.0), lambda acc, s: acc + 1.0 / (F.lit(rank_constant) + s["rank"]))
    fused = lists.groupBy(*keys, id_col).agg(seen.alias("seen")).withColumn("score", score)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("seen")[0])
    return (
        fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
        .select(*keys, id_col, "rank", "score")
    )
