"""Nodes and edges as tables: nodes(id, tags, properties), edges(source_id, target_id, relation_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import safe_token


def merge_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by id; new properties win, tags are united."""
    both = nodes.select("id", "tags", "properties", F.lit(0).alias("v")).unionByName(new.select("id", "tags", "properties", F.lit(1).alias("v")))
    got = F.array_sort(F.collect_list(F.struct("v", F.map_entries("properties").alias("p"))))
    return both.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), got.alias("g")).select("id", "tags", F.aggregate("g", F.expr("map_from_entries(cast(array() as array<struct<key:string,value:string>>))"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: ~F.exists(x["p"], lambda e: e["key"] == k)), F.map_from_entries(F.coalesce(x["p"], F.expr("cast(array() as array<struct<key:string,value:string>>)"))))).alias("properties"))


def merge_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed typed edges, each once; a new one without both ends, or with an unsafe type, is left out."""
    ids = nodes.select("id")
    ok = new.filter(safe_token(F.col("relation_type"))).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    cols = ["source_id", "target_id", "relation_type"]
    return edges.select(cols).union(ok.select(cols)).distinct()


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes in gone(id) and the edges at either end of them."""
    ids = gone.select(key).distinct()
    edges = edges.join(ids.withColumnRenamed(key, "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed(key, "target_id"), "target_id", "left_anti")
    return nodes.join(ids, key, "left_anti"), edges


def undirected(edges: DataFrame) -> DataFrame:
    """id, neighbour, relation_type in both directions."""
    a = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbour"), "relation_type")
    return a.union(edges.select(F.col("target_id"), F.col("source_id"), "relation_type"))


def neighbours(edges: DataFrame) -> DataFrame:
    """id, neighbour: distinct, in both directions."""
    return undirected(edges).select("id", "neighbour").distinct()


def overlap(edges: DataFrame, candidates: DataFrame, full_neighbourhood: bool = False) -> DataFrame:
    """id, score for each candidate(id): the share of its neighbours that are candidates. Unless full_neighbourhood, only neighbours
    among the candidates are looked at, so the score is 1 with any and 0 without."""
    ids = candidates.select("id").distinct()
    near = neighbours(edges).join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("neighbour"), F.lit(1).alias("c")), "neighbour", "left")
    if not full_neighbourhood:
        near = near.filter(F.col("c").isNotNull())
    share = near.groupBy("id").agg((F.count("c") / F.count(F.lit(1))).alias("s"))
    return ids.join(share, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("score"))


def expand(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits with relations: sorted (neighbour, relation_type), in both directions."""
    r = undirected(edges).distinct().groupBy("id").agg(F.array_sort(F.collect_list(F.struct("neighbour", "relation_type"))).alias("relations"))
    return hits.join(r, "id", "left")


def node_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("count"))


def neighbour_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """of, and the node: each distinct neighbour, in both directions, of the nodes in ids(id). An end that is no node is left out."""
    near = neighbours(edges).join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("of"), F.col("neighbour").alias("id"))
    return near.join(nodes, "id").select("of", *nodes.columns)
