"""Memory tiers: a bounded working buffer by session, episodes, semantic items."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scores as S
from ..functions.text import loose_double, loose_timestamp
from ..sources.store import delete
from . import graph, lexical, vectors

CAPACITY, TTL_MINUTES = 1024, 360
SNAPSHOT = 30
#: Fewest candidates, and how many times the limit, that a search fetches before it scores again.
FETCH_LEAST, FETCH_TIMES = 20, 3
SIMILAR = 0.3
NEAR_DUPLICATE = 0.9


def fifo(items: DataFrame, capacity: int = CAPACITY, session: str = "session_id", ts: str = "created_at", key: str = "id") -> DataFrame:
    """The newest `capacity` items of each session."""
    rank = F.row_number().over(W.partitionBy(session).orderBy(F.desc(ts), F.desc(key)))
    return items.withColumn("_r", rank).filter(F.col("_r") <= capacity).drop("_r")


def alive(ts: Column, now: str, minutes: int = TTL_MINUTES) -> Column:
    return S.hours_since(ts, now) * 60 <= minutes


def recent(items: DataFrame, now: str, limit: int, minutes: int = TTL_MINUTES, ts: str = "created_at", key: str = "id") -> DataFrame:
    return items.filter(alive(F.col(ts), now, minutes)).orderBy(F.desc(ts), F.desc(key)).limit(limit)


def working_search(items: DataFrame, query: str, now: str, limit: int, minutes: int = TTL_MINUTES) -> DataFrame:
    """items(id, content, created_at): the best by BM25, three times the limit, then those still alive, then the limit. Without terms, the newest."""
    if not lexical.query_terms(query):
        return recent(items, now, limit, minutes).withColumn("score", F.lit(None).cast("double"))
    best = lexical.bm25_topk(items.select(F.col("id").alias("doc_id"), F.col("content").alias("text")), query, FETCH_TIMES * limit)
    hits = items.join(F.broadcast(best.withColumnRenamed("doc_id", "id")), "id")  # 3 * limit rows
    return hits.filter(alive(F.col("created_at"), now, minutes)).orderBy(F.desc("score"), "id").limit(limit)


def status(items: DataFrame, ts: str = "created_at") -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("count"), F.min(ts).alias("oldest"), F.max(ts).alias("newest"))


def due(items: DataFrame, capacity: int = CAPACITY, session: str = "session_id") -> DataFrame:
    """session, n of the sessions whose buffer is nine tenths full."""
    return items.groupBy(session).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= capacity * 9 // 10)


def snapshot(items: DataFrame, n: int = SNAPSHOT, session: str = "session_id", ts: str = "created_at", key: str = "id") -> DataFrame:
    """The oldest n items of each session."""
    rank = F.row_number().over(W.partitionBy(session).orderBy(ts, key))
    return items.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def compress(items: DataFrame, summary: Column | None = None, session: str = "session_id", key: str = "id") -> DataFrame:
    """One episode for each session's items: a summary (an aggregate; by default the contents, most important first), 0.9 of the greatest
    importance, and the ids of the sources in order."""
    by_weight = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("w"), F.col(key).alias("k"), F.col("content").alias("c"))))
    text = F.array_join(F.transform(by_weight, lambda x: x["c"]), "\n") if summary is None else summary
    return items.groupBy(session).agg(text.alias("summary"), (0.9 * F.max("importance")).alias("importance"), F.array_sort(F.collect_list(key)).alias("source_ids"), F.count(F.lit(1)).alias("n"))


def episodic_search(episodes: DataFrame, vector: Sequence[float], now: str, limit: int, min_score: float = 0.0, filters: Sequence[tuple] = (), column: str = "embedding", key: str = "id") -> DataFrame:
    """Fetches by cosine (0.3 at least), scores with recency and importance, keeps min_score, sorts, limits."""
    fetched = vectors.vector_search(episodes, vector, max(FETCH_TIMES * limit, FETCH_LEAST), SIMILAR, filters, column, key).withColumnRenamed("score", "cosine")
    out = fetched.withColumn("recency", S.memory_recency(F.col("created_at"), now))
    out = out.withColumn("score", S.episodic_score(F.col("cosine"), F.col("recency"), F.col("importance"))).filter(F.col("score") >= min_score)
    return out.orderBy(F.desc("score"), key).limit(limit)


def semantic_search(items: DataFrame, edges: DataFrame, vector: Sequence[float], limit: int, min_score: float = 0.0, filters: Sequence[tuple] = (), full_neighbourhood: bool = False, column: str = "embedding") -> DataFrame:
    """As episodic_search, with the overlap of graph neighbours instead of recency. items(id, importance, embedding, ...)."""
    fetched = vectors.vector_search(items, vector, max(FETCH_TIMES * limit, FETCH_LEAST), SIMILAR, filters, column, "id").withColumnRenamed("score", "cosine")
    near = graph.overlap(edges, fetched, full_neighbourhood).withColumnRenamed("score", "graph")
    out = fetched.join(near, "id").withColumn("score", S.semantic_score(F.col("cosine"), F.col("graph"), F.col("importance"))).filter(F.col("score") >= min_score)
    return out.orderBy(F.desc("score"), "id").limit(limit)


def tool_search(episodes: DataFrame, items: DataFrame, edges: DataFrame, vector: Sequence[float], session, now: str, limit: int, min_score: float = 0.1, min_importance: float = 0.1) -> DataFrame:
    """tier, id, content, importance: a session's episodes and semantic items of some importance and score, the most important first."""
    own = [("session_id", "=", session), ("importance", ">=", min_importance)]
    found = {"episodic": episodic_search(episodes, vector, now, limit, min_score, own), "semantic": semantic_search(items, edges, vector, limit, min_score, own)}
    return cross_tier(found, limit)


def episodic_add(episodes: DataFrame, new: DataFrame, embed: Callable[[Column], Column], key: str = "id") -> DataFrame:
    """episodes(id, session_id, content, summary, importance, event_type, created_at, embedding) with new ones, whose vector is that of the summary
    and whose importance is 0.5 where none is given. Of episodes with the same id the new one stays."""
    weight = F.when(F.coalesce("importance", F.lit(0.0)) == 0, 0.5).otherwise(F.col("importance")).cast("double")
    new = new.withColumn("importance", weight).withColumn("embedding", embed(F.col("summary")))
    return episodes.join(new.select(key), key, "left_anti").unionByName(new.select(*episodes.columns))


def move_relations(relations: DataFrame, added: DataFrame) -> DataFrame:
    """relations(source_id, target_id, relation_type) of the kept items, by added(id, kept_id): those of an item that went to another move there."""
    to = lambda c: added.select(F.col("id").alias(c), F.col("kept_id").alias("_" + c))
    out = relations.join(to("source_id"), "source_id", "left").join(to("target_id"), "target_id", "left")
    out = out.select(*[F.coalesce("_" + c, c).alias(c) for c in ("source_id", "target_id")], "relation_type")
    return out.filter("source_id <> target_id").distinct()


def with_relations(hits: DataFrame, relations: DataFrame, key: str = "id") -> DataFrame:
    r = relations.groupBy(F.col("source_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("target_id", "relation_type"))).alias("relations"))
    return hits.join(r, key, "left")


#: Items added at a time, and kept items that one matrix product compares them with.
ADDED, COMPARED = 512, 8192


def semantic_add(items: DataFrame, block: str | None = None, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """items(id, embedding, importance) added in the order of id: one whose cosine with a kept item of the collection exceeds the threshold goes
    to the most similar one, which takes the greater importance. Returns id, kept_id, importance (of the kept item, at the end). The order is
    sequential, so a collection is one group of a Python worker; `block` names a column that tells collections apart."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        unit = np.stack(pdf["embedding"].to_numpy()).astype(float)
        size = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = unit / np.where(size == 0, 1, size)
        target, weight = np.arange(len(pdf)), pdf["importance"].to_numpy(float).copy()
        kept, n = np.zeros(len(pdf), np.int64), 0
        held = np.zeros_like(unit)
        for i in range(0, len(pdf), ADDED):
            new = unit[i : i + ADDED]
            best, near = np.full(len(new), -2.0), np.zeros(len(new), np.int64)
            for k in range(0, n, COMPARED):
                sim = new @ held[k : min(n, k + COMPARED)].T
                at = sim.argmax(axis=1)
                top = sim[np.arange(len(new)), at]
                near, best = np.where(top > best, k + at, near), np.maximum(top, best)
            among, before = new @ new.T, n
            for r in range(len(new)):
                fresh = kept[before:n] - i
                if len(fresh):
                    at = int(among[r, fresh].argmax())
                    if among[r, fresh[at]] > best[r]:
                        best[r], near[r] = among[r, fresh[at]], before + at
                if best[r] > threshold:
                    target[i + r] = kept[near[r]]
                    weight[target[i + r]] = max(weight[target[i + r]], weight[i + r])
                else:
                    held[n], kept[n] = new[r], i + r
                    n += 1
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"id": ids, "kept_id": ids[target], "importance": weight[target]})

    kind = dict(items.dtypes)["id"]
    return items.select("id", "embedding", "importance", *[block] * bool(block)).groupBy(*[block] * bool(block)).applyInPandas(run, f"id {kind}, kept_id {kind}, importance double")


def cross_tier(tiers: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """tiers(id, content, importance) in one list, by importance, then tier and id."""
    out = None
    for name, t in tiers.items():
        one = t.select(F.lit(name).alias("tier"), F.col("id").cast("string").alias("id"), "content", F.col("importance").cast("double").alias("importance"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("importance"), "tier", "id").limit(limit)


def semantic_delete(nodes: DataFrame, edges: DataFrame, points: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, points) without the items in ids(id), the edges at either end of them and their vectors."""
    left, edges = graph.detach_delete(nodes, edges, ids)
    return left, edges, delete(points, ids, "id")


def with_entries(metadata: Column, entries: dict[str, Column]) -> Column:
    """A map with further entries, which win; a null entry is left out."""
    new = F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    old = F.coalesce(metadata, F.expr("cast(map() as map<string,string>)"))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def as_items(df: DataFrame, kind: str, entries: dict[str, Column]) -> DataFrame:
    """Items of a tier, the tier's own columns as entries of metadata; relations as JSON, where there are any."""
    if "relations" in df.columns:
        entries = entries | {"relations": F.when(F.size("relations") > 0, F.to_json("relations"))}
    meta = F.col("metadata") if "metadata" in df.columns else F.expr("cast(null as map<string,string>)")
    at = F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("timestamp")
    return df.select("id", "session_id", F.lit(kind).alias("type"), "content", at.alias("created_at"), "importance", with_entries(meta, entries).alias("metadata"))


def episodes_as_items(episodes: DataFrame) -> DataFrame:
    return as_items(episodes, "episodic", {"summary": F.coalesce("summary", F.lit("")), "event_type": F.coalesce("event_type", F.lit(""))})


def semantics_as_items(items: DataFrame) -> DataFrame:
    return as_items(items, "semantic", {"summary": F.coalesce("summary", F.lit("")), "tags": F.when(F.size("tags") > 0, F.array_join("tags", ","))})


def rows_as_episodes(rows: DataFrame) -> DataFrame:
    """Stored rows of text as episodes: null text is empty, an importance that is no number 0, a time that is no time null."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("id", "session_id", "content", "summary", "event_type")]
    return rows.select(*text, loose_double(F.col("importance").cast("string")).alias("importance"), loose_timestamp(F.col("created_at").cast("string")).alias("created_at"))


def nodes_as_semantics(nodes: DataFrame) -> DataFrame:
    """Nodes(id, tags, properties) as semantic items: what a property lacks is empty, an importance that is no number 0."""
    text = [F.coalesce(F.col("properties")[c], F.lit("")).alias(c) for c in ("content", "session_id", "summary")]
    return nodes.select("id", *text, "tags", loose_double(F.col("properties")["importance"]).alias("importance"))


class Sessions:
    """Known sessions, and the one that is meant where none is named: the first, until another is chosen or it is removed."""

    def __init__(self):
        self._known: set[str] = set()
        self.default = ""

    def _must(self, session: str) -> str:
        if session not in self._known:
            raise KeyError(f"session {session!r} not found")
        return session

    def add(self, session: str) -> None:
        if not session:
            raise ValueError("a session needs an id")
        if session in self._known:
            raise ValueError(f"session {session!r} exists")
        self._known.add(session)
        self.default = self.default or session

    def remove(self, session: str) -> None:
        self._known.remove(self._must(session))
        self.default = "" if self.default == session else self.default

    def use(self, session: str) -> None:
        self.default = self._must(session)

    def resolve(self, session: str = "") -> str:
        if not (session or self.default):
            raise KeyError("no session is named and there is no default")
        return self._must(session or self.default)

    def of(self, items: DataFrame, session: str = "") -> DataFrame:
        """The session's rows; a filter that reaches the scan, and its partitions where the table has them."""
        return items.filter(F.col("session_id") == self.resolve(session))
