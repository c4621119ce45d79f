"""Lexical ranking: postings, BM25, TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import LITERAL_TERMS, terms

K1, B = 1.5, 0.75


def query_terms(query: str) -> list[str]:
    """Terms of a literal query, in order, with repeats."""
    return LITERAL_TERMS.findall(query.lower())


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    return docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _counted(docs: DataFrame, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with `len` and `tf`, an array by wanted term; one row of stats). Terms of a literal query are counted in the row, so nothing is exploded;
    only the counts are shuffled, so that rows and stats share one exchange and each text is read and split once."""
    same = lambda w: lambda x: x == w
    rows = docs.select("doc_id", terms(F.col("text")).alias("t"))
    rows = rows.select("doc_id", F.size("t").alias("len"), F.array(*[F.size(F.filter("t", same(w))) for w in wanted]).alias("tf")).repartition("doc_id")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), F.array(*[F.coalesce(F.sum((F.col("tf")[i] > 0).cast("long")), F.lit(0)) for i in range(len(wanted))]).alias("df"))
    return rows, stats


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(docs: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score of the documents that hold any term of the query; its repeats count once."""
    wanted = list(dict.fromkeys(query_terms(query)))
    if not wanted:
        return docs.select("doc_id", F.lit(0.0).alias("score")).filter(F.lit(False))
    rows, stats = _counted(docs, wanted)
    rows = rows.crossJoin(F.broadcast(stats))  # one row
    score = sum((bm25_idf(F.col("n"), F.col("df")[i]) * F.col("tf")[i] * (k1 + 1) / (F.col("tf")[i] + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))) for i in range(len(wanted))), F.lit(0.0))
    return rows.select("doc_id", score.alias("score")).filter("score > 0")  # any term adds something; a test of tf alone would split the exchange


def bm25_topk(docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The k best (all if k <= 0), by score, then doc_id."""
    out = bm25(docs, query).orderBy(F.desc("score"), "doc_id")
    return out.limit(k) if k > 0 else out


def tfidf_vectors(docs: DataFrame) -> DataFrame:
    """doc_id, term, weight = tf / length * idf, sparse vectors in long form."""
    p = postings(docs)
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = docs.select("doc_id", F.size(terms(F.col("text"))).alias("len"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return p.join(df, "term").join(rows, "doc_id").crossJoin(F.broadcast(n)).select("doc_id", "term", (F.col("tf") / F.col("len") * bm25_idf(F.col("n"), F.col("df"))).alias("weight"))


def tfidf_query(docs: DataFrame, query: str) -> DataFrame:
    """One row: the query's weights in the order of its distinct terms (repeats count, unknown terms weigh nothing)."""
    words = query_terms(query)
    wanted = list(dict.fromkeys(words))
    _, stats = _counted(docs, wanted)
    weight = [F.when(F.col("df")[i] > 0, words.count(w) * bm25_idf(F.col("n"), F.col("df")[i])).otherwise(0.0) for i, w in enumerate(wanted)]
    return stats.select(F.array(*map(F.lit, wanted)).alias("terms"), F.array(*weight).alias("weights"))


def tfidf_match(docs: DataFrame, query: str) -> DataFrame:
    """doc_id, dot, cosine of each document's vector with the query's, for documents with a term of it."""
    words = list(dict.fromkeys(query_terms(query)))
    q = tfidf_query(docs, query).select(F.posexplode(F.arrays_zip("terms", "weights")).alias("i", "x")).select(F.col("x.terms").alias("term"), F.col("x.weights").alias("qw"))
    v = tfidf_vectors(docs)
    size = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    hit = v.filter(F.col("term").isin(*words)).join(F.broadcast(q), "term").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("qw")).alias("dot"))
    qn = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    out = hit.join(size, "doc_id").crossJoin(F.broadcast(qn))
    return out.select("doc_id", "dot", F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("qn")), F.lit(0.0)).alias("cosine"))
