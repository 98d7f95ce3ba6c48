"""A stored vector index that limits a neighbour search to candidates (V3).

Unit vectors lie in one folder per nearest centroid.  Centroids come from spherical k-means over
a bounded sample (``SAMPLE`` rows, whatever the corpus's size); every row of the corpus is then assigned and stored.
A search opens, for each query, the nearest folders until they hold ``num_candidates`` rows, and scores all their
rows exactly.  With as many candidates as rows it is the exact search; ``vectors.knn`` stays the default elsewhere.

Rows do not move in a search: each task scores the folders' rows that it reads against the queries
that opened them.  A folder with a large share of the rows is many files, hence many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import scale
from shelfmark.operators import vectors

#: Rows that centroids are fitted on at most, and folders at most.
SAMPLE, MOST_LISTS = 20_000, 4096
#: Rows per folder aimed at in small corpora.
ROWS_PER_LIST = 64


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` (list, id, vector) by folder, and the driver's copy of centroids and folder sizes (at most ``MOST_LISTS``)."""

    rows: DataFrame
    id_col: str
    centroids: np.ndarray
    sizes: np.ndarray


def centroids_of(sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit means of the rows nearest to each; an empty one starts anew at the worst placed row."""
    draw = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    centres = sample[draw.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        scores = sample @ centres.T
        nearest, best = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.bincount(nearest, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.divide(sums, norms, out=centres.copy(), where=norms > 0)
    return centres


def write_vector_index(
    corpus: DataFrame, path: str, id_col: str = "product_id", vector: str = "embedding", lists: int | None = None, seed: int = 7,
) -> VectorIndex:
    """Assign every row with a vector to its nearest centroid and store it; ids must not repeat across versions of a row."""
    spark = corpus.sparkSession
    rows = corpus.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).cast("array<double>").alias("vector"))
    total = rows.count()
    # The rows of least hash: as good as a random sample, and the same in every run.
    sample = rows.orderBy(F.xxhash64(F.lit(seed), id_col)).limit(SAMPLE).toPandas()["vector"] if total else []
    fitted = vectors._unit_rows(sample) if total else np.zeros((0, 0))
    wanted = lists or max(1, min(MOST_LISTS, total // ROWS_PER_LIST, int(4 * total**0.5)))
    centres = centroids_of(fitted, wanted, seed) if total else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centres)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                unit = vectors._unit_rows(part["vector"])
                yield pd.DataFrame({"list": (unit @ shared.value.T).argmax(axis=1).astype("int32"), id_col: part[id_col], "vector": list(unit)})

    schema = T.StructType([T.StructField("list", T.IntegerType()), rows.schema[id_col], T.StructField("vector", T.ArrayType(T.DoubleType()))])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.mapInPandas(assign, schema).repartitionByRange(parts, "list", id_col).write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(id_col, schema.json())], "id_col string, schema string").write.mode("overwrite").parquet(f"{path}/facts")
    return open_vector_index(spark, path)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    import json

    facts = spark.read.parquet(f"{path}/facts").head()
    rows = spark.read.schema(T.StructType.fromJson(json.loads(facts["schema"]))).parquet(f"{path}/rows")
    centres = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    sizes = np.zeros(len(centres), np.int64)
    for r in rows.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    return VectorIndex(rows, facts["id_col"], np.array([r["centre"] for r in centres]), sizes)


def opened(index: VectorIndex, queries: np.ndarray, num_candidates: int) -> np.ndarray:
    """Which folders each query opens (queries x folders): the nearest, until they hold ``num_candidates`` rows."""
    scores = queries @ index.centroids.T
    order = np.argsort(-scores, axis=1, kind="stable")
    held = np.cumsum(index.sizes[order], axis=1)
    before = held - index.sizes[order]
    out = np.zeros(scores.shape, bool)
    np.put_along_axis(out, order, before < num_candidates, axis=1)
    return out


def calibrate(index: VectorIndex, k: int, recall: float = 0.95, queries: int = 200) -> int:
    """Candidates with which a search finds about this share of the true ``k`` nearest.

    Measured on at most ``queries`` of the stored rows against the exact search over all rows: for each
    true neighbour, how many candidates must be allowed until its folder is opened.
    """
    rows = index.rows.select(F.col(index.id_col).alias("id"), "vector", "list")
    asked = scale.settle(rows.orderBy(F.xxhash64(F.lit(11), "id")).limit(queries).select(F.col("id").alias("qid"), "vector")).df
    near = vectors.knn(rows, asked, k, "id", "qid", "vector").select("qid", "id")
    where = near.join(rows.select("id", "list"), "id").select("qid", "list").toPandas()  # queries * k rows
    if not len(where):
        return k
    sample = asked.toPandas()
    scores = vectors._unit_rows(sample["vector"]) @ index.centroids.T
    order = np.argsort(-scores, axis=1, kind="stable")
    before = np.zeros(scores.shape, np.int64)
    np.put_along_axis(before, order, np.cumsum(index.sizes[order], axis=1) - index.sizes[order], axis=1)
    place = {q: i for i, q in enumerate(sample["qid"])}
    needed = np.sort([before[place[q], f] + 1 for q, f in zip(where["qid"], where["list"], strict=True)])
    return max(k, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]))


def search(
    index: VectorIndex, queries: DataFrame, k: int, num_candidates: int = 100, qid_col: str = "qid", vector: str = "embedding", block_bytes: int | None = None,
) -> DataFrame:
    """Cosine top-k among at least ``max(num_candidates, k)`` candidates of every query: (qid, id, rank, score).

    Queries beyond ``block_bytes`` are taken in blocks, each with a scan of the folders that it opens.
    """
    asked = scale.settle(queries.where(F.col(vector).isNotNull()).select(qid_col, F.col(vector).cast("array<double>").alias("vector"))).df
    out = T.StructType([asked.schema[qid_col], index.rows.schema[index.id_col], T.StructField("score", T.DoubleType())])
    spark, bound = asked.sparkSession, vectors.QUERY_BLOCK_BYTES if block_bytes is None else block_bytes
    cells = asked.agg(F.coalesce(F.sum(F.size("vector") + F.lit(len(index.sizes) / 8)), F.lit(0))).head()[0]
    blocks, found = max(1, -(-int(cells) * 8 // bound)), None
    for number in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(qid_col), F.lit(blocks)) == number).toPandas()
        if not len(rows) or not len(index.sizes):
            continue
        matrix = vectors._unit_rows(rows["vector"])
        wanted = opened(index, matrix, max(num_candidates, k))
        shared = spark.sparkContext.broadcast((rows[qid_col].to_numpy(), matrix, wanted))
        read = index.rows.where(F.col("list").isin([int(x) for x in np.flatnonzero(wanted.any(axis=0))]))
        part = read.mapInPandas(_scan(shared, k, index.id_col, qid_col), out)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], out)
    order = Window.partitionBy(qid_col).orderBy(F.desc("score"), F.asc(index.id_col))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan(shared, k: int, id_col: str, qid_col: str):
    """A task's own k best per query, over the folders that the query opened."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, matrix, wanted = shared.value
        kept = None
        for batch in batches:
            for number, rows in batch.groupby("list"):
                asking = np.flatnonzero(wanted[:, number])
                if not len(asking):
                    continue
                at, names, values = vectors._nearest(matrix[asking], np.array(rows["vector"].tolist()), rows[id_col].to_numpy(), k)
                found = pd.DataFrame({"q": asking[at], id_col: names, "score": values})
                kept = found if kept is None else pd.concat([kept, found])
            if kept is not None:
                kept = kept.sort_values(["q", "score", id_col], ascending=[True, False, True])
                kept = kept[kept.groupby("q").cumcount() < k]
        if kept is not None:
            yield pd.DataFrame({qid_col: qids[kept["q"].to_numpy()], id_col: kept[id_col], "score": kept["score"]})
    return run
