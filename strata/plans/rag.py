"""Retrieval over stored chunks: search, list, delete, status."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.vectors import recall
from ..sources import connectors
from ..sources.store import cascade, delete


def query_vectors(query: str, embed: Callable[[str], Sequence[float]], variants: Callable[[str], list[str]] | None = None, passage: Callable[[str, str], str] | None = None) -> dict[int, Sequence[float]]:
    """Vectors of the query (0), then of its variants by one model, then of a hypothetical passage by another; the input of search."""
    texts = [query]
    if variants:
        texts = connectors.expand_queries(query, variants(query))
        if len(texts) == 1:
            raise ValueError("the model gave no variant")
    if passage:
        texts.append(connectors.hypothetical(query, passage))
    return {i: embed(t) for i, t in enumerate(texts)}


def search(points: DataFrame, chunks: DataFrame, documents: DataFrame, queries: dict[int, Sequence[float]], limit: int = 5, column: str = "embedding", min_score: float = 0.3) -> DataFrame:
    """chunk_id, doc_id, doc_name, content, score, rank of the fused hits; hits without a chunk are left out, a missing document leaves its name empty."""
    hits = recall(points.withColumnRenamed("id", "chunk_id") if "id" in points.columns else points, queries, limit, min_score, column, "chunk_id")
    out = hits.join(chunks.select(F.col("id").alias("chunk_id"), "doc_id", "chunk_index", "content"), "chunk_id").join(documents.select(F.col("id").alias("doc_id"), F.col("name").alias("doc_name")), "doc_id", "left")
    return out.select("chunk_id", "doc_id", F.coalesce("doc_name", F.lit("")).alias("doc_name"), "content", "score", "chunk_index", "rrf").orderBy(F.desc(F.round("rrf", 12)), "chunk_id")


def list_documents(documents: DataFrame, limit: int = 20) -> DataFrame:
    return documents.orderBy(F.desc("created_at"), "id").limit(limit)


def delete_documents(documents: DataFrame, chunks: DataFrame, points: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, points) without the documents in ids(id) and what belongs to them."""
    gone = chunks.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("id")
    documents, chunks = cascade(documents, chunks, ids, "id", "doc_id")
    return documents, chunks, delete(points, gone, "id")


def status(documents: DataFrame, doc_id: str) -> DataFrame:
    return documents.filter(F.col("id") == doc_id).select("id", "name", "status", "chunk_count")
