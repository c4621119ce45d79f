"""Exact vector search with payload filters, several queries at once, rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scores import cosine

RRF_K = 60


def payload_filter(field: str, op: str, value) -> Column:
    """One condition on a payload column; IN on an array column asks for any common element."""
    c = F.col(field)
    ops = {"=": lambda: c == value, "==": lambda: c == value, "!=": lambda: ~(c == value) | c.isNull(), ">": lambda: c > value, ">=": lambda: c >= value, "<": lambda: c < value, "<=": lambda: c <= value}
    if op.upper() == "IN":
        return c.isin(*value) if value else F.lit(False)
    if op.upper() == "ANY":
        return F.arrays_overlap(c, F.array(*map(F.lit, value))) if value else F.lit(False)
    if op not in ops:
        raise ValueError(f"unsupported operator {op!r}")
    return ops[op]()


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def vector_search(points: DataFrame, vector: Sequence[float], limit: int, min_score: float | None = None, filters: Sequence[tuple] = (), column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The best points by cosine, then key. Filters on the payload reach the scan."""
    for f in filters:
        points = points.filter(payload_filter(*f))
    out = points.withColumn("score", cosine(F.col(column), literal(vector)))
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    return out.orderBy(F.desc("score"), key).limit(limit)


def multi_search(points: DataFrame, queries: dict[int, Sequence[float]], limit: int, min_score: float = 0.3, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """qid, key, score, rank (from 0): the best for each of a few literal queries, in one pass over the points."""
    qs = F.array(*[F.struct(F.lit(q).alias("qid"), literal(v).alias("v")) for q, v in queries.items()])
    out = points.select(key, column, F.explode(qs).alias("q")).select(F.col("q.qid").alias("qid"), key, cosine(F.col(column), F.col("q.v")).alias("score")).filter(F.col("score") >= min_score)
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).filter(F.col("rank") <= limit).withColumn("rank", F.col("rank") - 1)


def fuse(hits: DataFrame, limit: int, k: int = RRF_K, key: str = "vec_id") -> DataFrame:
    """key, rrf, score: reciprocal-rank fusion of hits(qid, key, score, rank); the score is the best one."""
    out = hits.groupBy(key).agg(F.sum(1 / (F.lit(float(k)) + F.col("rank") + 1)).alias("rrf"), F.max("score").alias("score"))
    return out.orderBy(F.desc(F.round("rrf", 12)), key).limit(limit)


def recall(points: DataFrame, queries: dict[int, Sequence[float]], limit: int, min_score: float = 0.3, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Searches twice the limit for each query, then fuses."""
    if not queries:
        raise ValueError("no query")
    return fuse(multi_search(points, queries, 2 * limit, min_score, column, key), limit, key=key)


def breakpoints(vectors: DataFrame, group: str, order: str, column: str, factor: float = 1.0) -> DataFrame:
    """group, order, similarity to the next, is_break: where similarity falls below mean - factor * population deviation.
    Groups of two or fewer vectors, or with a deviation under 0.01, have none."""
    w, all_ = W.partitionBy(group).orderBy(order), W.partitionBy(group)
    out = vectors.withColumn("similarity", cosine(F.col(column), F.lead(column).over(w))).withColumn("n", F.count(F.lit(1)).over(all_))
    out = out.withColumn("last", F.lead(order).over(w).isNull()).filter("not last")
    mean, dev = F.avg("similarity").over(all_), F.stddev_pop("similarity").over(all_)
    return out.select(group, order, "similarity", ((F.col("n") > 2) & (dev >= 0.01) & (F.col("similarity") < mean - factor * dev)).alias("is_break"))

