"""Lexical and vector retrieval combined (V2, V5, V6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import scale
from shelfmark.functions.enrich import embedding_text
from shelfmark.operators import lexical, vectors
from shelfmark.operators.vectors import DIMS, Embedder, hash_embedding
from shelfmark.plans.strategies import strategy
from shelfmark.sources.catalog import update_column


def catalog_vectors(catalog: DataFrame, embed: Embedder = hash_embedding, dims: int = DIMS) -> DataFrame:
    """(product_id, embedding) of every product; a wrong length fails."""
    texts = catalog.select(
        "product_id",
        embedding_text(F.col("title"), F.col("brand"), F.col("category"), F.col("description")).alias("text"))
    made = embed(texts, "product_id", "text")
    if embed is hash_embedding:
        # Has its length by construction.
        return made
    wrong = F.raise_error(F.format_string(f"Expected {dims} dimensions, got %d", F.size("embedding"))).cast("boolean")
    return made.where(F.when(F.size("embedding") == dims, F.lit(True)).otherwise(wrong))


def embed_catalog(catalog: DataFrame, embed: Embedder = hash_embedding, dims: int = DIMS) -> DataFrame:
    """The catalog with its ``embedding`` column filled."""
    return update_column(catalog, catalog_vectors(catalog, embed, dims))[0]


def hybrid(
    catalog: DataFrame, queries: DataFrame, as_of: Column, size: int = 10, embed: Embedder = hash_embedding,
    boosted: bool = True, window: int | None = None,
) -> DataFrame:
    """Boosted lexical ranking fused with nearest neighbours (V5).

    Uses the catalog's ``embedding`` column, or embeds on the fly.  Where no
    vectors exist the lexical list stands alone.  ``window`` fuses the leading
    ``max(size, window)`` rows of the unboosted list instead (V6).
    """
    depth = size if window is None else max(size, window)
    chosen = strategy("boosted_lexical" if boosted and window is None else "baseline_lexical")
    words = lexical.rank(catalog, queries, [chosen], depth, as_of).drop("strategy")
    stored = vectors.has_embeddings(catalog)
    corpus = scale.spread(catalog.select("product_id", "embedding")) if stored else catalog_vectors(catalog, embed)
    asked = embed(queries.select("qid", "query"), "qid", "query")
    near = vectors.knn(corpus, asked, depth)
    return vectors.rrf([words, near], size, window=None if window is None else depth)
