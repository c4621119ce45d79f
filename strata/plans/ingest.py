"""Ingestion: parse, drop what is stored already, chunk, embed, store with a status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators import chunking, parsing
from ..sources.connectors import hashed_embedding

CHUNK_SIZE, OVERLAP = 1024, 50


def dedup(parsed: DataFrame, stored: DataFrame | None = None, key: str = "id") -> DataFrame:
    """parsed(id, content) with sha256, existing_id, is_duplicate: against stored documents that are ready, then against lesser ids of the batch."""
    out = parsed.withColumn("sha256", F.sha2("content", 256))
    first = F.min(key).over(W.partitionBy("sha256"))
    if stored is not None:
        old = stored.filter(F.col("status") == "ready").groupBy("sha256").agg(F.min(key).alias("_old"))
        out = out.join(old, "sha256", "left")
    else:
        out = out.withColumn("_old", F.lit(None).cast(dict(parsed.dtypes)[key]))
    return out.withColumn("existing_id", F.coalesce("_old", first)).withColumn("is_duplicate", F.col("existing_id") != F.col(key)).drop("_old")


def ingest(files: DataFrame, stored: DataFrame | None = None, size: int = CHUNK_SIZE, overlap: int = OVERLAP, chunker: Callable[[Column], Column] | None = None, embed: Callable[[Column], Column] = hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks with vectors) of files(name, ext, content). Ids follow from the content, so a rerun stores the same rows."""
    docs = parsing.parse_documents(files).withColumn("id", F.sha2(F.concat_ws("\x01", "name", F.coalesce("content", "parse_error")), 256))
    docs = dedup(docs, stored)
    fresh = docs.filter(F.col("parse_error").isNull() & ~F.col("is_duplicate"))
    chunk = chunker or (lambda c: chunking.chunk_recursive(c, size, overlap))
    chunks = fresh.select(F.col("id").alias("doc_id"), F.explode(chunk(F.col("content"))).alias("c")).select(F.sha2(F.concat_ws("#", "doc_id", "c.index"), 256).alias("id"), "doc_id", F.col("c.index").alias("chunk_index"), "c.content", "c.token_est", "c.start_pos", "c.end_pos")
    count = chunks.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    status = F.when(F.col("parse_error").isNotNull(), "failed").when(F.col("is_duplicate"), "duplicate").otherwise("ready")
    out = docs.join(count, "id", "left").select("id", "name", F.col("ext").alias("format"), F.octet_length("content").cast("long").alias("size"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), status.alias("status"), "sha256", "existing_id", "parse_error")
    return out, chunks.withColumn("vector", embed(F.col("content")))
