"""Notes: notes(id, title, type, tags, created_at, updated_at, content)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def create(notes: DataFrame, new: DataFrame) -> DataFrame:
    """new(title, content, type, tags, created_at) with an id by content; those without title or content are left out."""
    ok = new.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("content", F.lit("")) != ""))
    key = F.concat(F.lit("note_"), F.substring(F.sha2(F.concat_ws("\x01", "title", "content", F.col("created_at").cast("string")), 256), 1, 16))
    return notes.unionByName(ok.select(key.alias("id"), "title", F.coalesce("type", F.lit("general")).alias("type"), "tags", "created_at", F.col("created_at").alias("updated_at"), "content"))


def update(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(id, title, type, content, tags, updated_at): only what is not empty overwrites."""
    c = changes.select(F.col("id"), *[F.col(x).alias("_" + x) for x in ("title", "type", "content", "tags", "updated_at")])
    some = lambda x: F.coalesce(F.nullif(F.col("_" + x), F.lit("")), F.col(x))
    out = notes.join(c, "id", "left")
    return out.select("id", some("title").alias("title"), some("type").alias("type"), F.when(F.size("_tags") > 0, F.col("_tags")).otherwise(F.col("tags")).alias("tags"), "created_at", F.coalesce("_updated_at", "updated_at").alias("updated_at"), some("content").alias("content"))


def list_notes(notes: DataFrame, kind: str | None = None, tags: Sequence[str] = (), limit: int = 20):
    if kind:
        notes = notes.filter(F.col("type") == kind)
    if tags:
        notes = notes.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return notes.orderBy(F.desc("updated_at"), "id").limit(limit)


def search(notes: DataFrame, query: str, kind: str | None = None, tags: Sequence[str] = (), limit: int = 20) -> DataFrame:
    """Notes whose title or content holds the query, whatever its case."""
    low = F.lit(query.lower())
    return list_notes(notes.filter(F.contains(F.lower("title"), low) | F.contains(F.lower("content"), low)), kind, tags, limit)


def summary(notes: DataFrame, recent: int = 5) -> DataFrame:
    """type, count, and in each row the total and the notes changed last (id, title, type, tags, created_at, updated_at), the latest first."""
    last = W.orderBy(F.desc("updated_at"), "id")
    top = list_notes(notes, limit=recent).withColumn("_at", F.row_number().over(last))  # `recent` rows
    top = top.agg(F.array_sort(F.collect_list(F.struct("_at", "id", "title", "type", "tags", "created_at", "updated_at"))).alias("recent"))
    top = top.select(F.transform("recent", lambda x: x.dropFields("_at")).alias("recent"))
    return notes.groupBy("type").agg(F.count(F.lit(1)).alias("count")).withColumn("total", F.sum("count").over(W.partitionBy())).join(F.broadcast(top))


def body(markdown):
    """What follows the front matter of a note file."""
    return F.regexp_replace(markdown, r"(?s)\A---\n.*?\n---\n+", "")
