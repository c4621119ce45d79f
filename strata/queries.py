"""Registered queries over the test tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import scores as S, text as T
from .operators import chunking, context, graph, lexical, memory, notes, parsing, vectors
from .plans import chain, ingest, rag, tools
from .sources import connectors, store

NOW = "2024-02-01 00:00:00"
QUERY = "with that this nderer"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_of(points: DataFrame, key: int) -> list[float]:
    return list(points.filter(F.col("vec_id") == key).select("embedding").first()[0])


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as memory items."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.concat_ws(" ", "event_type", "props").alias("content"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") % 11 / 10.0).alias("importance"), "event_type")


ITEMS = "i AS (SELECT event_id AS id, user_id AS session_id, concat_ws(' ', event_type, props) AS content, ts AS created_at, (event_id % 11) / 10.0::DOUBLE AS importance, event_type FROM events)"


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as episodes."""
    e = read(spark, sf_dir, "embeddings")
    at = F.timestamp_micros((F.lit(1706745600) - F.col("vec_id") * 3600) * 1000000)
    return e.select(F.col("vec_id").alias("id"), "embedding", "label", (F.col("vec_id") % 11 / 10.0).alias("importance"), at.alias("created_at"))


POINTS = "p AS (SELECT vec_id AS id, embedding, label, (vec_id % 11) / 10.0::DOUBLE AS importance, TIMESTAMP '2024-02-01' - vec_id * INTERVAL 1 HOUR AS created_at FROM embeddings)"
COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {}))"


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    pick = lambda m, k, t: e.select(F.col("vec_id").alias("source_id"), ((F.col("vec_id") * m + k) % 500).alias("target_id"), F.lit(t).alias("relation_type")).filter("source_id <> target_id")
    return pick(7, 3, "related_to").union(pick(13, 5, "caused_by"))


EDGES = "e AS (SELECT vec_id AS source_id, (vec_id * 7 + 3) % 500 AS target_id, 'related_to' AS relation_type FROM embeddings WHERE vec_id <> (vec_id * 7 + 3) % 500 UNION ALL SELECT vec_id, (vec_id * 13 + 5) % 500, 'caused_by' FROM embeddings WHERE vec_id <> (vec_id * 13 + 5) % 500)"
BOTH = EDGES + ", u AS (SELECT source_id AS id, target_id AS neighbour, relation_type FROM e UNION ALL SELECT target_id, source_id, relation_type FROM e)"


def notes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("general", "blocker", "action", "conclusion"))), (F.col("doc_id") % 4 + 1).cast("int"))
    at = F.timestamp_micros((F.lit(1704067200) + F.col("doc_id") * 60) * 1000000)
    return d.select(F.col("doc_id").cast("string").alias("id"), F.left("text", F.lit(20)).alias("title"), kind.alias("type"), F.array("lang", "source").alias("tags"), at.alias("created_at"), at.alias("updated_at"), F.col("text").alias("content"))


NOTES = "n AS (SELECT doc_id::VARCHAR AS id, left(text, 20) AS title, ['general', 'blocker', 'action', 'conclusion'][doc_id % 4 + 1] AS type, [lang, source] AS tags, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS updated_at, text AS content FROM documents)"
TERMS = r"t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)"
BM25 = (
    "WITH " + TERMS + ", w AS (SELECT doc_id, len(t) AS l, t FROM t), st AS (SELECT count(*) AS n, avg(l) AS a FROM w), q AS (SELECT unnest(['with', 'that', 'this', 'nderer']) AS x), "
    "tf AS (SELECT doc_id, l, x, len(list_filter(t, lambda v: v = x)) AS tf FROM w, q), df AS (SELECT x, count(*) AS df FROM tf WHERE tf > 0 GROUP BY x), "
    "s AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN df USING (x), st WHERE tf > 0 GROUP BY doc_id) "
)


@query(BM25 + "SELECT doc_id, round(score, 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    return lexical.bm25_topk(read(spark, d, "documents"), QUERY, 10).select("doc_id", F.round("score", 6).alias("score"))


@query(BM25 + "SELECT documents.doc_id, round(coalesce(score, 0), 6) AS score FROM documents LEFT JOIN s ON s.doc_id = documents.doc_id")
def bm25_doc_score(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id").join(lexical.bm25(docs, QUERY), "doc_id", "left").select("doc_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


@query("WITH " + TERMS + ", p AS (SELECT doc_id, unnest(t) AS term FROM t) SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS tf FROM p GROUP BY term")
def postings_stats(spark, d):
    return lexical.postings(read(spark, d, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("SELECT doc_id, greatest(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 1)::BIGINT AS tokens FROM documents")
def token_estimate_chunk(spark, d):
    return read(spark, d, "documents").select("doc_id", T.chunk_tokens(F.col("text")).cast("long").alias("tokens"))


@query("SELECT doc_id, floor(0.25 * length(text))::BIGINT AS tokens FROM documents")
def token_estimate_context(spark, d):
    return read(spark, d, "documents").select("doc_id", T.context_tokens(F.col("text")).alias("tokens"))


TFIDF = "WITH " + TERMS + ", p AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, unnest(t) AS term, len(t) AS l FROM t) GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n FROM documents), v AS (SELECT doc_id, p.term, tf / l * ln((n - df + 0.5) / (df + 0.5) + 1) AS weight FROM p JOIN df USING (term), n), q AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS qw FROM df, n WHERE term IN ('with', 'that', 'this', 'nderer')) "


@query(TFIDF + "SELECT doc_id, term, round(weight, 6) AS weight FROM v")
def tfidf_doc_vector(spark, d):
    return lexical.tfidf_vectors(read(spark, d, "documents")).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(TFIDF + "SELECT doc_id, round(dot, 6) AS dot, round(dot / (norm * qn), 6) AS cosine FROM (SELECT doc_id, sum(weight * qw) AS dot FROM v JOIN q USING (term) GROUP BY doc_id) JOIN (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM v GROUP BY doc_id) USING (doc_id), (SELECT sqrt(sum(qw * qw)) AS qn FROM q)")
def tfidf_query_cosine(spark, d):
    return lexical.tfidf_match(read(spark, d, "documents"), QUERY).select("doc_id", F.round("dot", 6).alias("dot"), F.round("cosine", 6).alias("cosine"))


@query("WITH " + TERMS + ", s AS (SELECT doc_id, list_distinct(t) AS t, ['with', 'that', 'this', 'nderer'] AS q FROM t) SELECT doc_id, round(len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))), 6) AS relevance FROM s")
def jaccard_relevance(spark, d):
    wanted = F.array(*map(F.lit, QUERY.split()))
    return read(spark, d, "documents").select("doc_id", F.round(S.jaccard(F.array_distinct(T.terms(F.col("text"))), wanted), 6).alias("relevance"))


@query(f"SELECT vec_id, round({COS.format(0)}, 5) AS score FROM embeddings ORDER BY {COS.format(0)} DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    p = read(spark, d, "embeddings")
    return vectors.vector_search(p, vector_of(p, 0), 10).select("vec_id", F.round("score", 5).alias("score"))


@query(f"SELECT vec_id, label, round({COS.format(1)}, 5) AS score FROM embeddings WHERE label IN (1, 2, 3) AND vec_id > 5 AND {COS.format(1)} >= 0.1 ORDER BY {COS.format(1)} DESC, vec_id LIMIT 10")
def vector_filtered_topk(spark, d):
    p = read(spark, d, "embeddings")
    return vectors.vector_search(p, vector_of(p, 1), 10, 0.1, [("label", "IN", [1, 2, 3]), ("vec_id", ">", 5)]).select("vec_id", "label", F.round("score", 5).alias("score"))


MULTI = "WITH h AS (SELECT q.vec_id AS qid, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id < 4), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) - 1 AS rank FROM h WHERE score >= 0.2 QUALIFY rank < 20) "


def hits_of(spark, d, limit=20):
    p = read(spark, d, "embeddings")
    return vectors.multi_search(p, {q: vector_of(p, q) for q in range(4)}, limit, 0.2)


@query(MULTI + "SELECT qid, vec_id, round(score, 5) AS score, rank FROM r")
def multi_query_topk(spark, d):
    return hits_of(spark, d).select(F.col("qid").cast("long").alias("qid"), "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(MULTI + "SELECT vec_id, round(sum(1 / (60.0 + rank + 1)), 8) AS rrf, round(max(score), 5) AS score FROM r GROUP BY vec_id ORDER BY round(sum(1 / (60.0 + rank + 1)), 12) DESC, vec_id LIMIT 10")
def rrf_fusion(spark, d):
    return vectors.fuse(hits_of(spark, d), 10).select("vec_id", F.round("rrf", 8).alias("rrf"), F.round("score", 5).alias("score"))


@query("WITH s AS (SELECT vec_id, vec_id // 25 AS g, list_cosine_similarity(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 25 ORDER BY vec_id)) AS sim FROM embeddings) SELECT g AS grp, vec_id, round(sim, 5) AS similarity, stddev_pop(sim) OVER w >= 0.01 AND sim < avg(sim) OVER w - stddev_pop(sim) OVER w AS is_break FROM s WHERE sim IS NOT NULL WINDOW w AS (PARTITION BY g)")
def adjacent_breakpoints(spark, d):
    p = read(spark, d, "embeddings").withColumn("grp", F.floor(F.col("vec_id") / 25))
    return vectors.breakpoints(p, "grp", "vec_id", "embedding").select("grp", "vec_id", F.round("similarity", 5).alias("similarity"), "is_break")


@query("WITH " + ITEMS + " SELECT id, session_id FROM i QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) <= 20")
def working_fifo(spark, d):
    return memory.fifo(items_of(spark, d), 20).select("id", "session_id")


@query(
    "WITH " + ITEMS + r", w AS (SELECT id, created_at, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS t FROM i), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM w), q AS (SELECT unnest(['click', '42']) AS x), tf AS (SELECT id, len(t) AS l, x, len(list_filter(t, lambda v: v = x)) AS tf FROM w, q), df AS (SELECT x, count(*) AS df FROM tf WHERE tf > 0 GROUP BY x), s AS (SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN df USING (x), st WHERE tf > 0 GROUP BY id ORDER BY score DESC, id LIMIT 60) SELECT id, round(score, 4) AS score FROM s JOIN w USING (id) WHERE epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at) <= 20000 * 60000000::BIGINT ORDER BY s.score DESC, id LIMIT 20"
)
def working_search_ttl(spark, d):
    return memory.working_search(items_of(spark, d), "click 42", NOW, 20, 20_000).select("id", F.round("score", 4).alias("score"))


@query("WITH " + ITEMS + " SELECT id, created_at FROM i WHERE epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at) <= 20000 * 60000000::BIGINT ORDER BY created_at DESC, id DESC LIMIT 15")
def working_recent(spark, d):
    return memory.recent(items_of(spark, d), NOW, 15, 20_000).select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("WITH " + ITEMS + ", s AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) <= 10) SELECT session_id, round(0.9 * max(importance), 6) AS importance, string_agg(id::VARCHAR, ',' ORDER BY id) AS source_ids, string_agg(content, chr(10) ORDER BY -importance, id) AS summary, count(*)::BIGINT AS n FROM s GROUP BY session_id")
def compress_snapshot(spark, d):
    out = memory.compress(memory.snapshot(items_of(spark, d), 10))
    return out.select("session_id", F.round("importance", 6).alias("importance"), F.array_join("source_ids", ",").alias("source_ids"), "summary", "n")


@query("WITH " + ITEMS + " SELECT session_id, count(*)::BIGINT AS n FROM i GROUP BY session_id HAVING count(*) >= 54")
def compression_due(spark, d):
    return memory.due(items_of(spark, d), 60)


@query("WITH " + ITEMS + " SELECT count(*)::BIGINT AS count, min(created_at) AS oldest, max(created_at) AS newest FROM i")
def memory_status(spark, d):
    return memory.status(items_of(spark, d)).select("count", F.col("oldest").cast("timestamp_ntz").alias("oldest"), F.col("newest").cast("timestamp_ntz").alias("newest"))


RECENCY = "greatest(0.1, exp(-0.05 * (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 3.6e9))"


@query("WITH " + ITEMS + f" SELECT id, round((0.8 * importance + 0.2 * {RECENCY}) * (0.8 + 0.4 * importance), 6) AS score FROM i")
def episodic_score(spark, d):
    i = items_of(spark, d)
    return i.select("id", F.round(S.episodic_score(F.col("importance"), S.memory_recency(F.col("created_at"), NOW), F.col("importance")), 6).alias("score"))


@query("WITH " + POINTS + f", f AS (SELECT *, {COS.format(0)} AS c FROM p WHERE importance >= 0.1 AND {COS.format(0)} >= 0.3 ORDER BY c DESC, id LIMIT 30) SELECT id, round((0.8 * c + 0.2 * {RECENCY}) * (0.8 + 0.4 * importance), 6) AS score FROM f ORDER BY (0.8 * c + 0.2 * {RECENCY}) * (0.8 + 0.4 * importance) DESC, id LIMIT 10")
def episodic_search(spark, d):
    p = points_of(spark, d)
    v = vector_of(read(spark, d, "embeddings"), 0)
    return memory.episodic_search(p, v, NOW, 10, filters=[("importance", ">=", 0.1)]).select("id", F.round("score", 6).alias("score"))


@query("WITH " + POINTS + ", " + BOTH + f", f AS (SELECT *, {COS.format(2)} AS c FROM p WHERE {COS.format(2)} >= 0.3 ORDER BY c DESC, id LIMIT 30), g AS (SELECT DISTINCT id FROM u WHERE id IN (SELECT id FROM f) AND neighbour IN (SELECT id FROM f)) SELECT f.id, CASE WHEN g.id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS graph, round((0.7 * c + 0.3 * CASE WHEN g.id IS NULL THEN 0 ELSE 1 END) * (0.8 + 0.4 * importance), 6) AS score FROM f LEFT JOIN g ON g.id = f.id ORDER BY score DESC, f.id LIMIT 10")
def semantic_search(spark, d):
    v = vector_of(read(spark, d, "embeddings"), 2)
    return memory.semantic_search(points_of(spark, d), edges_of(spark, d), v, 10).select("id", "graph", F.round("score", 6).alias("score"))


@query("WITH " + ITEMS + ", a AS (SELECT * FROM i ORDER BY created_at DESC, id DESC LIMIT 20), t AS (SELECT 'working' AS tier, id::VARCHAR AS id, importance FROM a UNION ALL SELECT 'semantic', vec_id::VARCHAR, (vec_id % 7) / 10.0::DOUBLE FROM embeddings WHERE label = 1) SELECT tier, id, importance FROM t ORDER BY importance DESC, tier, id LIMIT 10")
def cross_tier_search(spark, d):
    a = memory.recent(items_of(spark, d), NOW, 20, 10**9)
    b = read(spark, d, "embeddings").filter("label = 1").select(F.col("vec_id").alias("id"), F.lit("").alias("content"), (F.col("vec_id") % 7 / 10.0).alias("importance"))
    return memory.cross_tier({"working": a, "semantic": b}).select("tier", "id", "importance")


@query("WITH " + POINTS + ", " + BOTH + f", f AS (SELECT *, {COS.format(3)} AS c FROM p WHERE importance >= 0.1 AND id % 3 = 1 AND {COS.format(3)} >= 0.3 ORDER BY c DESC, id LIMIT 30), x AS (SELECT id, importance, (0.8 * c + 0.2 * {RECENCY}) * (0.8 + 0.4 * importance) AS score FROM f WHERE (0.8 * c + 0.2 * {RECENCY}) * (0.8 + 0.4 * importance) >= 0.1 ORDER BY score DESC, id LIMIT 10), g AS (SELECT DISTINCT id FROM u WHERE id IN (SELECT id FROM f) AND neighbour IN (SELECT id FROM f)), y AS (SELECT f.id, importance, (0.7 * c + 0.3 * CASE WHEN g.id IS NULL THEN 0 ELSE 1 END) * (0.8 + 0.4 * importance) AS score FROM f LEFT JOIN g ON g.id = f.id ORDER BY score DESC, f.id LIMIT 10) SELECT tier, id::VARCHAR AS id, importance FROM (SELECT 'episodic' AS tier, id, importance FROM x UNION ALL SELECT 'semantic', id, importance FROM y) ORDER BY importance DESC, tier, id::VARCHAR LIMIT 10")
def memory_tool_search(spark, d):
    p = points_of(spark, d).withColumn("session_id", F.col("id") % 3).withColumn("content", F.lit(""))
    v = vector_of(read(spark, d, "embeddings"), 3)
    return memory.tool_search(p, p, edges_of(spark, d), v, 1, NOW, 10).select("tier", "id", "importance")


@query("WITH " + ITEMS + " SELECT id, CASE WHEN importance = 0 THEN 0.5 ELSE importance END AS importance, 16::BIGINT AS dimensions, count(*) OVER ()::BIGINT AS episodes FROM i")
def episodic_add(spark, d):
    new = items_of(spark, d).withColumn("summary", F.col("content")).select("id", "session_id", "content", "summary", "importance", "event_type", "created_at")
    held = new.filter("id % 3 = 0").withColumn("embedding", F.array().cast("array<double>"))
    out = memory.episodic_add(held, new, lambda c: connectors.hashed_embedding(c, 16).cast("array<double>"))
    n = out.agg(F.count(F.lit(1)).alias("episodes"))
    return out.select("id", "importance", F.size("embedding").cast("long").alias("dimensions")).join(F.broadcast(n))


@query("WITH " + EDGES + " SELECT DISTINCT source_id // 10 * 10 AS source_id, target_id // 10 * 10 AS target_id, relation_type FROM e WHERE source_id // 10 <> target_id // 10")
def semantic_move_relations(spark, d):
    e = edges_of(spark, d)
    nodes = e.select(F.col("source_id").alias("id")).union(e.select("target_id")).distinct()
    return memory.move_relations(e, nodes.withColumn("kept_id", F.floor(F.col("id") / 10) * 10))


@query("WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), c AS (SELECT vec_id AS id, vec_id AS kept_id FROM embeddings UNION ALL SELECT vec_id + n, vec_id FROM embeddings, n) SELECT id, kept_id, max(id % 11) OVER (PARTITION BY kept_id) / 10.0::DOUBLE AS importance FROM c")
def semantic_near_duplicate(spark, d):
    # each vector and a noisy copy of it, in one collection
    p = read(spark, d, "embeddings")
    n = p.agg((F.max("vec_id") + 1).alias("n"))  # one row
    copy = p.crossJoin(F.broadcast(n)).select((F.col("vec_id") + F.col("n")).alias("id"), F.transform("embedding", lambda x: x + 0.01).alias("embedding"))
    both = p.select(F.col("vec_id").alias("id"), "embedding").union(copy)
    return memory.semantic_add(both.withColumn("importance", F.col("id") % 11 / 10.0))


@query("WITH " + BOTH + " SELECT DISTINCT id, neighbour FROM u")
def graph_neighbors(spark, d):
    return graph.neighbours(edges_of(spark, d))


@query("WITH " + BOTH + ", c AS (SELECT vec_id AS id FROM embeddings WHERE label < 5), n AS (SELECT DISTINCT id, neighbour FROM u WHERE id IN (SELECT id FROM c)), s AS (SELECT id, count(*) FILTER (neighbour IN (SELECT id FROM c)) / count(*) AS s FROM n GROUP BY id) SELECT c.id, round(coalesce(s, 0), 6) AS score FROM c LEFT JOIN s ON s.id = c.id")
def graph_overlap_score(spark, d):
    c = read(spark, d, "embeddings").filter("label < 5").select(F.col("vec_id").alias("id"))
    return graph.overlap(edges_of(spark, d), c, True).select("id", F.round("score", 6).alias("score"))


@query("WITH " + BOTH + ", r AS (SELECT id, string_agg(neighbour || ':' || relation_type, ',' ORDER BY neighbour, relation_type) AS relations FROM (SELECT DISTINCT * FROM u) GROUP BY id) SELECT vec_id AS id, relations FROM embeddings LEFT JOIN r ON r.id = vec_id")
def relation_expand(spark, d):
    hits = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    text = F.transform("relations", lambda r: F.concat_ws(":", r["neighbour"].cast("string"), r["relation_type"]))
    return graph.expand(hits, edges_of(spark, d)).select("id", F.array_join(text, ",").alias("relations"))


@query("WITH " + EDGES + " SELECT source_id, target_id, relation_type FROM e WHERE source_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3) AND target_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def detach_delete(spark, d):
    e = read(spark, d, "embeddings")
    nodes, ids = e.select(F.col("vec_id").alias("id")), e.filter("label = 3").select(F.col("vec_id").alias("id"))
    return graph.detach_delete(nodes, edges_of(spark, d), ids)[1]


@query("WITH " + EDGES + ", n AS (SELECT vec_id FROM embeddings WHERE label < 5) SELECT source_id, target_id, relation_type FROM e WHERE relation_type = 'related_to' UNION SELECT source_id, target_id, relation_type FROM e WHERE source_id IN (FROM n) AND target_id IN (FROM n)")
def graph_merge_edges(spark, d):
    # all edges, merged into those of one type; only some of the ends are nodes
    e = edges_of(spark, d)
    nodes = read(spark, d, "embeddings").filter("label < 5").select(F.col("vec_id").alias("id"))
    return graph.merge_edges(e.filter("relation_type = 'related_to'"), e, nodes)


@query("SELECT vec_id::VARCHAR AS id, CASE WHEN label < 5 THEN 'v2' ELSE label::VARCHAR END AS label, CASE WHEN label < 5 THEN 'yes' END AS extra FROM embeddings")
def graph_merge_nodes(spark, d):
    a = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.array(F.lit("Concept")).alias("tags"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("properties"))
    b = a.filter(F.col("properties")["label"].cast("int") < 5).withColumn("properties", F.create_map(F.lit("label"), F.lit("v2"), F.lit("extra"), F.lit("yes")))
    return graph.merge_nodes(a, b).select("id", F.col("properties")["label"].alias("label"), F.col("properties")["extra"].alias("extra"))


@query("SELECT doc_id AS id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS existing_id, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents")
def sha_dedup(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return ingest.dedup(docs).select("id", "sha256", "existing_id", "is_duplicate")


@query(
    "WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), r AS (SELECT doc_id, l, 1 AS i, 0 AS c, l[1] AS t, len(regexp_extract_all(l[1], '[^ \\t\\n\\r]+')) AS n, false AS cut FROM l WHERE len(l) > 0 UNION ALL SELECT doc_id, l, i + 1, CASE WHEN n + m <= 100 THEN c ELSE c + 1 END, CASE WHEN n + m <= 100 THEN t || chr(10) || l[i + 1] ELSE l[i + 1] END, CASE WHEN n + m <= 100 THEN n + m ELSE m END, false FROM (SELECT *, len(regexp_extract_all(l[i + 1], '[^ \\t\\n\\r]+')) AS m FROM r WHERE i < len(l))) SELECT doc_id, c::BIGINT AS chunk_index, arg_max(t, i) AS content, max(n)::BIGINT AS token_est FROM r GROUP BY doc_id, c"
)
def line_chunks(spark, d):
    return chunking.line_packs(read(spark, d, "documents"), 100).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content", F.col("token_est").cast("long").alias("token_est"))


@query("WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) SELECT doc_id, i::BIGINT AS i, array_to_string(list(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), chr(10)) AS context FROM s")
def sentence_window_context(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    return chunking.window_context(s, "doc_id", "i", "s").select("doc_id", F.col("i").cast("long").alias("i"), "context")


@query(r"SELECT page_id, len(regexp_extract_all(html, '<h[1-6]'))::BIGINT AS headings, len(regexp_extract_all(html, '<a '))::BIGINT AS links, len(regexp_extract_all(html, '<li'))::BIGINT AS list_items FROM pages")
def html_to_markdown(spark, d):
    p = read(spark, d, "pages").select("page_id", parsing.parsed(F.col("html"), F.lit("html"))["content"].alias("m"))
    return p.select("page_id", F.regexp_count("m", F.lit(r"(?m)^#{1,6} ")).cast("long").alias("headings"), F.regexp_count("m", F.lit(r"\]\(")).cast("long").alias("links"), F.regexp_count("m", F.lit(r"(?m)^ *- ")).cast("long").alias("list_items"))


@query(r"SELECT event_id, '- **k**: ' || regexp_extract(props, '(\d+)', 1) AS content FROM events")
def json_outline(spark, d):
    return read(spark, d, "events").select("event_id", parsing.parsed(F.col("props"), F.lit("json"))["content"].alias("content"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10), repeat(chr(10), 4)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def tidy_markdown(spark, d):
    return read(spark, d, "documents").select("doc_id", T.tidy_markdown(F.replace("text", F.lit("\n"), F.lit("\n\n\n\n"))).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unsupported_format' WHEN octet_length(encode(text)) > 3000 THEN 'too_large' WHEN doc_id % 7 = 0 THEN 'empty' END AS parse_error FROM documents")
def parse_gate(spark, d):
    docs = read(spark, d, "documents")
    ext = F.when(F.col("doc_id") % 5 == 0, "exe").otherwise("md")
    raw = F.when((F.col("doc_id") % 7 == 0) & (F.octet_length("text") <= 3000), F.lit("")).otherwise(F.col("text")).cast("binary")
    return docs.select("doc_id", parsing.gate(raw, ext, 3000).alias("parse_error"))


@query(r"WITH m AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 5 = 1 THEN '# ' || x WHEN i % 5 = 3 THEN '## ' || x ELSE x END) AS l FROM documents), h AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS line FROM m), g AS (SELECT doc_id, line, length(regexp_extract(s, '^(#{1,6}) ', 1)) AS level, trim(regexp_extract(s, '^#{1,6} (.*)$', 1)) AS title FROM h WHERE regexp_matches(s, '^#{1,6} ')) SELECT doc_id, line::BIGINT AS line, level::BIGINT AS level, title, coalesce((SELECT min(k.line) FROM g k WHERE k.doc_id = g.doc_id AND k.line > g.line AND k.level <= g.level), -1)::BIGINT AS end_line FROM g")
def heading_sections(spark, d):
    line = lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("# "), x)).when(i % 5 == 2, F.concat(F.lit("## "), x)).otherwise(x)
    docs = read(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    return chunking.headings(docs).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("line", "level")], "title", F.coalesce("end_line", F.lit(-1)).cast("long").alias("end_line"))


@query()
def chunk_recursive(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.explode(chunking.chunk_recursive(F.col("text"), 256, 16)).alias("c")).select("doc_id", "c.*")


@query()
def chunk_semantic(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.explode(chunking.chunk_semantic(F.col("text"), chunking.hashed_vectors, 256)).alias("c")).select("doc_id", "c.*")


@query()
def sentence_split(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(chunking.sentences(F.col("text"))).alias("s")).select("doc_id", "s.*")


@query()
def ingest_documents(spark, d):
    p = read(spark, d, "pages").select(F.concat("page_id", F.lit(".html")).alias("name"), F.lit("html").alias("ext"), F.col("html").cast("binary").alias("content"))
    return ingest.ingest(p, size=256, overlap=16)[0]


def chunks_of(spark, d):
    """Documents as chunks of the embeddings with the same id."""
    docs = read(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 4).alias("doc_id"), (F.col("doc_id") % 4).alias("chunk_index"), F.col("text").alias("content"))


@query(MULTI.replace("rank < 20", "rank < 10") + ", f AS (SELECT vec_id AS chunk_id, sum(1 / (60.0 + rank + 1)) AS rrf, max(score) AS score FROM r GROUP BY vec_id ORDER BY round(rrf, 12) DESC, vec_id LIMIT 5) SELECT chunk_id, doc_id // 4 AS doc_id, CASE WHEN (doc_id // 4) % 2 = 0 THEN 'doc' || (doc_id // 4) ELSE '' END AS doc_name, text AS content, round(score, 5) AS score FROM f JOIN documents ON doc_id = chunk_id")
def rag_search(spark, d):
    p = read(spark, d, "embeddings")
    chunks = chunks_of(spark, d)
    names = chunks.select("doc_id").distinct().filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc"), "doc_id").alias("name"))
    points = p.select(F.col("vec_id").alias("id"), "embedding")
    out = rag.search(points, chunks, names, {q: vector_of(p, q) for q in range(4)}, 5, min_score=0.2)
    return out.select("chunk_id", "doc_id", "doc_name", "content", F.round("score", 5).alias("score"))


@query("SELECT doc_id AS id, n_chars AS size FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def rag_list(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.timestamp_seconds("n_chars").alias("created_at"))
    return rag.list_documents(docs).select("id", "size")


@query("WITH g AS (SELECT DISTINCT doc_id // 4 AS id FROM documents WHERE source = 'src1'), k AS (SELECT doc_id FROM documents WHERE doc_id // 4 NOT IN (FROM g)) SELECT (SELECT count(DISTINCT doc_id // 4) FROM k)::BIGINT AS documents, (SELECT count(*) FROM k)::BIGINT AS chunks, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id // 4 IN (FROM g)))::BIGINT AS points")
def rag_delete_cascade(spark, d):
    chunks = chunks_of(spark, d)
    docs = chunks.select(F.col("doc_id").alias("id")).distinct()
    gone = read(spark, d, "documents").filter("source = 'src1'").select(F.floor(F.col("doc_id") / 4).alias("id")).distinct()
    points = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    a, b, c = rag.delete_documents(docs, chunks, points, gone)
    n = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    return n(a, "documents").join(n(b, "chunks")).join(n(c, "points"))


@query("SELECT conv_id, turn, '[' || role || '] ' || text AS content, 0.6::DOUBLE AS relevance FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def history_tail(spark, d):
    return context.history_tail(read(spark, d, "conversations"), 3).select("conv_id", "turn", "content", "relevance")


def packets_of(spark, d):
    m = read(spark, d, "conversations").withColumn("query_id", F.col("conv_id"))
    source = F.when(F.col("role") == "system", "system").when(F.col("turn") % 3 == 0, "rag").when(F.col("turn") % 3 == 1, "memory").otherwise("history")
    at = F.timestamp_micros((F.lit(1706745600) - F.col("turn") * 864000) * 1000000)
    return m.select("query_id", F.concat_ws("-", "conv_id", "turn").alias("packet_id"), source.alias("source"), F.when(F.col("turn") % 2 == 0, "semantic").otherwise("episodic").alias("memory_type"), F.col("turn").alias("pos"), F.col("text").alias("content"), at.alias("timestamp"), F.when(F.col("turn") % 4 == 0, -1.0).otherwise(F.col("turn") / 10.0).alias("relevance"), T.context_tokens(F.col("text")).alias("token_count"))


PACKETS = r"k AS (SELECT conv_id AS query_id, conv_id || '-' || turn AS packet_id, CASE WHEN role = 'system' THEN 'system' WHEN turn % 3 = 0 THEN 'rag' WHEN turn % 3 = 1 THEN 'memory' ELSE 'history' END AS source, CASE WHEN turn % 2 = 0 THEN 'semantic' ELSE 'episodic' END AS memory_type, turn AS pos, text AS content, floor(0.25 * length(text))::BIGINT AS token_count, CASE WHEN turn % 4 = 0 THEN -1.0 ELSE turn / 10.0 END::DOUBLE AS rel0, turn FROM conversations), j AS (SELECT *, list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS t, ['with', 'that', 'this', 'nderer'] AS q FROM k), x AS (SELECT *, CASE WHEN rel0 < 0 THEN len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))) ELSE rel0 END AS relevance FROM j), z AS (SELECT *, 0.7 * relevance + 0.3 * CASE WHEN source = 'memory' AND memory_type = 'semantic' THEN relevance ELSE least(1.0, greatest(0.1, exp(-0.01 * (turn * 240.0) / 24))) END AS score FROM x)"


@query("WITH " + PACKETS + " SELECT packet_id, round(relevance, 6) AS relevance, round(score, 6) AS score FROM z")
def packet_scores(spark, d):
    return context.score_packets(packets_of(spark, d), QUERY, NOW).select("packet_id", F.round("relevance", 6).alias("relevance"), F.round("score", 6).alias("score"))


@query("WITH RECURSIVE " + PACKETS + ", o AS (SELECT query_id, list({'k': packet_id, 'n': token_count} ORDER BY -score, packet_id) AS l FROM z GROUP BY query_id), f AS (SELECT query_id, l, 0 AS i, 0::BIGINT AS used, []::VARCHAR[] AS ids FROM o UNION ALL SELECT query_id, l, i + 1, CASE WHEN used + l[i + 1].n <= 120 THEN used + l[i + 1].n ELSE used END, CASE WHEN used + l[i + 1].n <= 120 THEN list_append(ids, l[i + 1].k) ELSE ids END FROM f WHERE i < len(l)) SELECT query_id, unnest(ids) AS packet_id, (generate_subscripts(ids, 1) - 1)::BIGINT AS rank FROM f WHERE i = len(l)")
def greedy_budget_select(spark, d):
    scored = context.score_packets(packets_of(spark, d), QUERY, NOW)
    return context.greedy_fit(scored, "query_id", 120, "packet_id").select("query_id", "packet_id", F.col("rank").cast("long").alias("rank"))


@query("WITH RECURSIVE " + PACKETS + ", s AS (SELECT query_id, sum(token_count)::BIGINT AS used FROM z WHERE source = 'system' GROUP BY query_id), o AS (SELECT z.query_id, coalesce(any_value(used), 0)::BIGINT AS u0, list({'k': packet_id, 'n': token_count} ORDER BY -score, packet_id) AS l FROM z LEFT JOIN s ON s.query_id = z.query_id WHERE source <> 'system' AND relevance >= 0.1 GROUP BY z.query_id), f AS (SELECT query_id, l, 0 AS i, u0 AS used, []::VARCHAR[] AS ids FROM o WHERE u0 < 150 UNION ALL SELECT query_id, l, i + 1, CASE WHEN used + l[i + 1].n <= 150 THEN used + l[i + 1].n ELSE used END, CASE WHEN used + l[i + 1].n <= 150 THEN list_append(ids, l[i + 1].k) ELSE ids END FROM f WHERE i < len(l)), g AS (SELECT query_id, unnest(ids) AS packet_id FROM f WHERE i = len(l) UNION ALL SELECT query_id, packet_id FROM z WHERE source = 'system') SELECT query_id, packet_id FROM g")
def select_packets(spark, d):
    return context.select_packets(packets_of(spark, d), QUERY, NOW, 150, 0.1).select("query_id", "packet_id")


@query(
    "WITH " + PACKETS + ", s AS (SELECT query_id, string_agg(content, chr(10) ORDER BY pos) FILTER (source = 'system') AS r, string_agg(content, chr(10) || '---' || chr(10) ORDER BY pos) FILTER (source = 'rag' OR (source = 'memory' AND memory_type = 'semantic')) AS e, string_agg(content, chr(10) ORDER BY pos) FILTER (source = 'history' OR (source = 'memory' AND memory_type <> 'semantic')) AS c FROM z GROUP BY query_id) SELECT query_id, concat_ws(chr(10) || chr(10), '[Role]' || chr(10) || r, '[Task]' || chr(10) || 'with that this nderer', '[Evidence]' || chr(10) || e, '[Context]' || chr(10) || c, '[Output]' || chr(10) || 'Answer.') AS prompt FROM s"
)
def structured_prompt(spark, d):
    return context.structure(packets_of(spark, d), QUERY, "Answer.")


@query("SELECT conv_id, turn, '[' || role || '] ' || text || ' ' || CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS message FROM conversations")
def render_messages(spark, d):
    m = read(spark, d, "conversations")
    return m.select("conv_id", "turn", context.render_message(F.col("role"), F.col("text"), F.col("text")).alias("message"))


@query("WITH m AS (SELECT *, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS t, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS a FROM conversations) SELECT conv_id, turn, '[' || role || ']' || CASE WHEN turn % 3 = 0 THEN '[call_id=c' || turn || ']' ELSE '' END || CASE WHEN turn % 2 = 0 THEN '[name=' || role || ']' ELSE '' END || ' ' || text || ' [image: ' || t || '] [audio: wav ' || t || '] [file: f.txt ' || t || ']' || CASE WHEN turn % 2 = 1 THEN ' [tool_calls: find(' || a || '), stop()]' ELSE '' END AS message FROM m")
def render_whole_messages(spark, d):
    m, text = read(spark, d, "conversations"), F.col("text")
    part = lambda kind, **has: F.struct(F.lit(kind).alias("type"), *[has.get(c, F.lit(None).cast("string")).alias(c) for c in ("text", "data", "format", "name")])
    parts = F.array(part("text", text=text), part("image_url", data=text), part("input_audio", data=text, format=F.lit("wav")), part("file", data=text, name=F.lit("f.txt")))
    call = lambda name, args: F.struct(F.lit(name).alias("name"), args.alias("arguments"))
    calls = F.when(F.col("turn") % 2 == 1, F.array(call("find", text), call("stop", F.lit(""))))
    call_id, name = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("c"), "turn")), F.when(F.col("turn") % 2 == 0, F.col("role"))
    return m.select("conv_id", "turn", context.render_whole(F.col("role"), context.render_parts(parts), call_id, name, calls).alias("message"))


@query("SELECT conv_id, turn FROM conversations QUALIFY count(*) OVER (PARTITION BY conv_id) <= 5 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def history_cap(spark, d):
    return context.cap_history(read(spark, d, "conversations"), 5, 2).select("conv_id", "turn")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice > 1000 AND o_orderpriority ILIKE '%urgent%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def store_query(spark, d):
    where = [store.Condition("o_orderstatus", "IN", ["O", "F"]), store.Condition("o_totalprice", ">", 1000.0), store.Condition("o_orderpriority", "LIKE", "%urgent%")]
    return store.Query(where, [("o_totalprice", True), ("o_orderkey", False)], 50, 10, ["o_orderkey", "o_totalprice"]).run(read(spark, d, "orders"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT c_custkey + 10000000, 'new' FROM customer WHERE c_custkey % 10 = 0")
def store_upsert(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    tenth = c.filter("c_custkey % 10 = 0")
    new = tenth.union(tenth.selectExpr("c_custkey + 10000000", "c_name")).withColumn("c_name", F.lit("new"))
    return store.upsert(c, new, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def store_get(spark, d):
    return store.get(read(spark, d, "customer"), "c_custkey", 7).select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def store_cascade_delete(spark, d):
    orders = read(spark, d, "orders")
    gone = orders.filter("o_orderstatus = 'O'")
    return store.cascade(orders, read(spark, d, "lineitem"), gone, "o_orderkey", "l_orderkey")[1].select("l_orderkey", "l_linenumber")


@query("""SELECT doc_id, '["' || lang || '","' || source || '"]' AS tags, lang AS first_tag FROM documents""")
def json_codec(spark, d):
    df = store.encode(read(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("tags")))
    back = store.decode(df.withColumn("t", F.col("tags")), {"t": "array<string>"})
    return back.select("doc_id", "tags", F.col("t")[0].alias("first_tag"))


@query("WITH h AS (SELECT doc_id, sha1(unhex(substr(sha1('strata.points'), 1, 32)) || encode(doc_id::VARCHAR)) AS h FROM documents) SELECT doc_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', ('0x' || h[17:17])::INT % 4 + 1, 1) || h[18:20], h[21:32]) AS point_id FROM h")
def point_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", T.point_id(F.col("doc_id").cast("string")).alias("point_id"))


@query("WITH " + NOTES + " SELECT id, type FROM n WHERE (contains(lower(title), 'with') OR contains(lower(content), 'with')) AND list_has_any(tags, ['en', 'src1']) ORDER BY updated_at DESC, id LIMIT 20")
def note_search(spark, d):
    return notes.search(notes_of(spark, d), "With", None, ["en", "src1"]).select("id", "type")


@query("WITH " + NOTES + " SELECT id, title FROM n WHERE type = 'action' ORDER BY updated_at DESC, id LIMIT 20")
def note_list(spark, d):
    return notes.list_notes(notes_of(spark, d), "action").select("id", "title")


@query("WITH " + NOTES + " SELECT type, count(*)::BIGINT AS count, (SELECT count(*) FROM n)::BIGINT AS total, (SELECT string_agg(id, ',' ORDER BY updated_at DESC, id) FROM (SELECT id, updated_at FROM n ORDER BY updated_at DESC, id LIMIT 5)) AS recent FROM n GROUP BY type")
def note_summary(spark, d):
    out = notes.summary(notes_of(spark, d))
    return out.withColumn("recent", F.array_join(F.transform("recent", lambda x: x["id"]), ","))


@query("WITH " + NOTES + " SELECT id, CASE WHEN id::INT % 2 = 0 THEN 'renamed' ELSE title END AS title, content FROM n")
def note_update(spark, d):
    n = notes_of(spark, d)
    c = n.filter("cast(id as int) % 2 = 0").select("id", F.lit("renamed").alias("title"), F.lit("").alias("type"), F.lit("").alias("content"), F.array().cast("array<string>").alias("tags"), F.lit(NOW).cast("timestamp").alias("updated_at"))
    return notes.update(n, c).select("id", "title", "content")


@query("WITH " + NOTES + ", b AS (SELECT id, type, updated_at, 0 AS o FROM n WHERE type = 'blocker' ORDER BY updated_at DESC, id LIMIT 3), q AS (SELECT id, type, updated_at, 1 AS o FROM n WHERE contains(lower(title), 'with') OR contains(lower(content), 'with') ORDER BY updated_at DESC, id LIMIT 3), a AS (SELECT * FROM (SELECT * FROM b UNION ALL SELECT * FROM q) QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) = 1 ORDER BY o, updated_at DESC, id LIMIT 3) SELECT id, type, CASE type WHEN 'blocker' THEN 0.85 WHEN 'action' THEN 0.8 ELSE 0.75 END::DOUBLE AS relevance FROM a")
def note_packets(spark, d):
    return context.gather_notes(notes_of(spark, d), "with", 3).select("id", "type", "relevance")


@query("SELECT page_id, list_filter(list_transform(string_split(url, '/'), lambda x: trim(x)), lambda x: x <> '')[1] AS first_part FROM pages")
def tag_codec(spark, d):
    return read(spark, d, "pages").select("page_id", T.split_tags(F.replace("url", F.lit("/"), F.lit(",")))[0].alias("first_part"))


@query(r"SELECT item_id, trim(regexp_replace('1. ) ' || text, '^[0-9. )\-、]+', '')) AS variant FROM benchmark")
def query_variants(spark, d):
    return read(spark, d, "benchmark").select("item_id", T.clean_variant(F.concat(F.lit("1. ) "), "text")).alias("variant"))


@query("SELECT item_id, 'data:text/plain;base64,' || base64(encode(text)) AS url FROM benchmark")
def data_urls(spark, d):
    return read(spark, d, "benchmark").select("item_id", T.data_url(F.lit("text/plain"), F.col("text").cast("binary")).alias("url"))


@query("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE event_id::VARCHAR END AS DOUBLE), 0) AS v FROM events")
def loose_numbers(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("event_id").cast("string"))
    return read(spark, d, "events").select("event_id", T.loose_double(v).alias("v"))


@query()
def hashed_embeddings(spark, d):
    return read(spark, d, "benchmark").select("item_id", connectors.hashed_embedding(F.col("text"), 16).alias("vector"))


@query("SELECT lang, count(*)::BIGINT AS n FROM documents WHERE n_chars > 500 GROUP BY lang")
def chain_dag(spark, d):
    r = chain.Registry()
    r.register(chain.Tool("read", lambda name: read(spark, d, name), (chain.Parameter("name", required=True),)))
    r.register(chain.Tool("longer", lambda df, least: df.filter(F.col("n_chars") > least), (chain.Parameter("df", "object", True), chain.Parameter("least", "integer", default=500))))
    r.register(chain.Tool("count", lambda df, by: df.groupBy(by).agg(F.count(F.lit(1)).alias("n")), (chain.Parameter("df", "object", True), chain.Parameter("by", required=True))))
    steps = [chain.Step("a", "read", {"name": "$input.table"}), chain.Step("b", "longer", {"df": "$steps.a"}), chain.Step("c", "count", {"df": "$steps.b", "by": "lang"})]
    return chain.Chain(r, steps).run(table="documents")


@query("SELECT user_id::VARCHAR AS session_id, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def working_stream_state(spark, d):
    """The stateful buffer over one batch of the events, read as a stream."""
    import tempfile
    import uuid

    from .streaming.working import buffer

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = read(spark, d, "events")
        stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
        out = buffer(stream.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at")), 5)
        name = "buffer_" + uuid.uuid4().hex
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        at = f"{shared}/{name}" if shared else tempfile.mkdtemp(prefix="strata-")
        q = out.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).select("session_id", "id")
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)


@query("SELECT 'memory' AS source, event_id AS pos, concat_ws(' ', event_type, props) AS content, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' WHEN event_id % 3 = 1 THEN '0.25' END AS DOUBLE), (event_id % 11) / 10.0) AS relevance, 'episodic' AS memory_type, floor(0.25 * length(concat_ws(' ', event_type, props)))::BIGINT AS token_count FROM events UNION ALL SELECT 'rag', doc_id, text, doc_id % 5 / 4.0, NULL, floor(0.25 * length(text))::BIGINT FROM documents")
def gathered_packets(spark, d):
    score = F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "0.25")
    items = items_of(spark, d).withColumns({"metadata": F.create_map(F.lit("score"), score), "type": F.lit("episodic"), "pos": F.col("id")})
    hits = read(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("content"), (F.col("doc_id") % 5 / 4).alias("score"))
    return context.gather({"memory": context.memory_packets(items), "rag": context.rag_packets(hits)}).select("source", "pos", "content", "relevance", "memory_type", "token_count")


@query("SELECT count(*)::BIGINT AS count FROM embeddings")
def graph_node_count(spark, d):
    return graph.node_count(read(spark, d, "embeddings"))


@query("WITH " + BOTH + " SELECT DISTINCT u.id AS of, vec_id AS id, label FROM u JOIN embeddings ON vec_id = neighbour WHERE u.id IN (SELECT vec_id FROM embeddings WHERE label = 2)")
def graph_neighbour_nodes(spark, d):
    nodes = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return graph.neighbour_nodes(nodes, edges_of(spark, d), nodes.filter("label = 2"))


@query("WITH " + EDGES + ", g AS (SELECT vec_id AS id FROM embeddings WHERE label = 4) SELECT 'node' AS part, count(*)::BIGINT AS n FROM embeddings WHERE label <> 4 UNION ALL SELECT 'edge', count(*) FROM e WHERE source_id NOT IN (FROM g) AND target_id NOT IN (FROM g) UNION ALL SELECT 'point', count(*) FROM embeddings WHERE label <> 4")
def semantic_delete(spark, d):
    p = read(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    out = memory.semantic_delete(p.select("id"), edges_of(spark, d), p, p.filter("label = 4"))
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, x in zip(("node", "edge", "point"), out)]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS session_id, 'episodic' AS type, coalesce(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'none' ELSE (event_id % 11)::VARCHAR END AS DOUBLE), 0) AS importance, 'summary=' || event_type || ',event_type=' || event_type AS metadata, CASE WHEN event_id % 5 > 0 THEN date_trunc('second', ts) END AS created_at FROM events")
def stored_rows_as_items(spark, d):
    e = read(spark, d, "events")
    weight = F.when(F.col("event_id") % 4 == 0, "none").otherwise((F.col("event_id") % 11).cast("string"))
    at = F.when(F.col("event_id") % 5 == 0, "some day").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("props").alias("content"), F.col("event_type").alias("summary"), "event_type", weight.alias("importance"), at.alias("created_at"))
    items = memory.episodes_as_items(memory.rows_as_episodes(rows))
    meta = F.concat(F.lit("summary="), F.col("metadata")["summary"], F.lit(",event_type="), F.col("metadata")["event_type"])
    return items.select("id", "session_id", "type", "importance", meta.alias("metadata"), F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("SELECT vec_id::VARCHAR AS id, 's' || label AS session_id, label / 10.0::DOUBLE AS importance, 'Concept,L' || label AS tags FROM embeddings")
def nodes_as_items(spark, d):
    e = read(spark, d, "embeddings")
    props = F.create_map(F.lit("session_id"), F.concat(F.lit("s"), "label"), F.lit("importance"), (F.col("label") / 10).cast("string"))
    nodes = e.select(F.col("vec_id").cast("string").alias("id"), F.array(F.lit("Concept"), F.concat(F.lit("L"), "label")).alias("tags"), props.alias("properties"))
    return memory.semantics_as_items(memory.nodes_as_semantics(nodes)).select("id", "session_id", "importance", F.col("metadata")["tags"].alias("tags"))


@query("SELECT event_id AS id FROM events WHERE user_id = 2")
def session_items(spark, d):
    s = memory.Sessions()
    for name in ("1", "2", "3"):
        s.add(name)
    s.use("2")
    return s.of(items_of(spark, d)).select("id")


@query(MULTI.replace("q.vec_id < 4", "q.vec_id < 3") + "SELECT vec_id, round(sum(1 / (60.0 + rank + 1)), 8) AS rrf FROM r GROUP BY vec_id ORDER BY round(sum(1 / (60.0 + rank + 1)), 12) DESC, vec_id LIMIT 10")
def recall_with_passage(spark, d):
    # stand-ins for the models: the query, its one variant and the passage have the first three vectors
    p = read(spark, d, "embeddings")
    table = dict(p.filter("vec_id < 3").select(F.element_at(F.array(*map(F.lit, ("what", "which", "It is."))), (F.col("vec_id") + 1).cast("int")), "embedding").collect())  # three rows
    found = rag.query_vectors("what", table.__getitem__, lambda q: ["1. which", "what"], lambda told, q: " It is. ")
    return vectors.recall(p, found, 10, 0.2).select("vec_id", F.round("rrf", 8).alias("rrf"))


@query("SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces FROM documents")
def batched_embedding(spark, d):
    embed = connectors.batched(lambda texts: [[len(t), t.count(" ")] for t in texts])
    out = read(spark, d, "documents").select("doc_id", embed(F.col("text")).alias("v"))
    return out.select("doc_id", F.col("v")[0].alias("chars"), F.col("v")[1].alias("spaces"))


@query("WITH " + NOTES + " SELECT id, title, type FROM n WHERE contains(lower(title), 'th') OR contains(lower(content), 'th') ORDER BY updated_at DESC, id LIMIT 15")
def note_action(spark, d):
    r = chain.Registry()
    r.register(tools.note_tool(notes_of(spark, d)))
    return chain.Chain(r, [chain.Step("found", "note", {"action": "search", "query": "$input.text", "limit": 15})]).run(text="TH").select("id", "title", "type")
