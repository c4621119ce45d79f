"""Context assembly: gather, select within a token budget, structure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scores as S, text as T
from .lexical import query_terms

HISTORY = 32
#: Relevance of history messages and of notes by type.
HISTORY_RELEVANCE, NOTE_RELEVANCE = 0.6, {"blocker": 0.85, "action": 0.80}
NOTE_DEFAULT = 0.75
SECTIONS = ("Role", "Task", "Evidence", "Context", "Output")


def budget(max_tokens: int = 102_400, reserve: float = 0.1) -> int:
    return int(max_tokens * (1 - reserve))


def history_tail(messages: DataFrame, n: int = HISTORY, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each conversation as packets: content "[role] text"."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))
    return messages.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r").withColumn("content", F.concat(F.lit("["), "role", F.lit("] "), "text")).withColumn("relevance", F.lit(HISTORY_RELEVANCE))


def note_relevance(kind: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for k, v in NOTE_RELEVANCE.items():
        out = out.when(kind == k, v)
    return out.otherwise(NOTE_DEFAULT)


def gather_notes(notes: DataFrame, query: str, most: int = 5) -> DataFrame:
    """Blockers first, then notes that hold the query, each note once, `most` in all."""
    newest = [F.desc("updated_at"), F.col("id")]
    a = notes.filter(F.col("type") == "blocker").orderBy(*newest).limit(most).withColumn("_o", F.lit(0))
    low = query.lower()
    b = notes.filter(F.contains(F.lower("title"), F.lit(low)) | F.contains(F.lower("content"), F.lit(low))).orderBy(*newest).limit(most).withColumn("_o", F.lit(1))
    both = a.unionByName(b).withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("_o"))).filter("_r = 1")
    return both.orderBy("_o", *newest).limit(most).drop("_o", "_r").withColumn("relevance", note_relevance(F.col("type")))


def memory_packets(items: DataFrame) -> DataFrame:
    """Packets of memory items: relevance is the score among the metadata, or the importance where there is none that is a number."""
    score = F.coalesce(F.col("metadata")["score"].try_cast("double"), F.col("importance"))
    return items.withColumns({"timestamp": F.col("created_at"), "relevance": score, "memory_type": F.col("type")}).drop("created_at", "importance", "type")


def rag_packets(hits: DataFrame) -> DataFrame:
    """Packets of retrieved chunks: relevance is the score."""
    at = F.col("created_at") if "created_at" in hits.columns else F.lit(None).cast("timestamp")
    return hits.withColumns({"timestamp": at, "relevance": F.col("score")}).drop("created_at", "score")


def gather(parts: dict[str, DataFrame]) -> DataFrame:
    """Packets of all sources in their order: parts(content, timestamp, relevance, memory_type, pos) by source."""
    out = None
    for i, (source, p) in enumerate(parts.items()):
        have = p.columns
        one = p.select(F.lit(source).alias("source"), F.lit(i).alias("source_ord"), (F.col("pos") if "pos" in have else F.lit(0)).cast("long").alias("pos"), "content", (F.col("timestamp") if "timestamp" in have else F.lit(None)).cast("timestamp").alias("timestamp"), F.col("relevance").cast("double").alias("relevance"), (F.col("memory_type") if "memory_type" in have else F.lit(None)).cast("string").alias("memory_type"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("token_count", T.context_tokens(F.col("content")))


def score_packets(packets: DataFrame, query: str, now: str, relevance_weight: float = 0.7, recency_weight: float = 0.3, relevance: Callable[[Column], Column] | None = None, recency: Callable[[Column], Column] | None = None) -> DataFrame:
    """packets with relevance (by terms in common where it is negative or null) and score; a semantic memory's recency is its relevance."""
    wanted = F.array(*map(F.lit, dict.fromkeys(query_terms(query)))).cast("array<string>")
    own = relevance(F.col("content")) if relevance else S.jaccard(F.array_distinct(T.terms(F.col("content"))), wanted)
    out = packets.withColumn("relevance", F.when(F.coalesce(F.col("relevance"), F.lit(-1.0)) < 0, own).otherwise(F.col("relevance")))
    fresh = recency(F.col("timestamp")) if recency else S.context_recency(F.col("timestamp"), now)
    semantic = (F.col("source") == "memory") & (F.col("memory_type") == "semantic")
    return out.withColumn("score", relevance_weight * F.col("relevance") + recency_weight * F.when(semantic, F.col("relevance")).otherwise(fresh))


def greedy_fit(scored: DataFrame, group: str, limit: int, key: str, score: str = "score", tokens: str = "token_count") -> DataFrame:
    """group, key of what fits: by score, then key, each that still fits is taken, one that doesn't is skipped. A group's packets are one array."""
    order = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col(tokens).cast("long").alias("n"))))
    kind = dict(scored.dtypes)[key]
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.expr(f"cast(array() as array<{kind}>)").alias("ids"))
    fold = lambda acc, x: F.when(acc["used"] + x["n"] <= limit, F.struct((acc["used"] + x["n"]).alias("used"), F.concat(acc["ids"], F.array(x["k"])).alias("ids"))).otherwise(acc)
    out = scored.groupBy(group).agg(order.alias("o")).select(group, F.aggregate("o", zero, fold).alias("f"))
    return out.select(group, F.posexplode("f.ids").alias("rank", key))


def select_packets(packets: DataFrame, query: str, now: str, limit: int, min_relevance: float = 0.3, group: str = "query_id", key: str = "packet_id", **weights) -> DataFrame:
    """System packets always; if they leave room, others of at least min_relevance, greedily by score."""
    system = packets.filter(F.col("source") == "system")
    used = system.groupBy(group).agg(F.sum("token_count").alias("used"))
    rest = score_packets(packets.filter(F.col("source") != "system"), query, now, **weights).filter(F.col("relevance") >= min_relevance)
    rest = rest.join(used, group, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), F.col("token_count").cast("long").alias("n"))))
    kind = dict(packets.dtypes)[key]
    zero = F.struct(F.col("used").cast("long").alias("used"), F.expr(f"cast(array() as array<{kind}>)").alias("ids"))
    fold = lambda acc, x: F.when(acc["used"] + x["n"] <= limit, F.struct((acc["used"] + x["n"]).alias("used"), F.concat(acc["ids"], F.array(x["k"])).alias("ids"))).otherwise(acc)
    fits = rest.groupBy(group, "used").agg(order.alias("o")).filter(F.col("used") < limit).select(group, F.explode(F.aggregate("o", zero, fold)["ids"]).alias(key))
    return packets.join(system.select(group, key).union(fits), [group, key], "left_semi")


def section(source: Column, memory_type: Column) -> Column:
    evidence = source.isin("rag", "note") | ((source == "memory") & (memory_type == "semantic"))
    return F.when(source == "system", "Role").when(evidence, "Evidence").otherwise("Context")


def structure(packets: DataFrame, query: str, output: str = "", group: str = "query_id", classify: Callable[[Column, Column], Column] = section, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """group, prompt: packets(source, memory_type, pos, content) in sections of a fixed order; empty ones are left out."""
    rows = packets.withColumn("section", classify(F.col("source"), F.coalesce("memory_type", F.lit(""))))
    lists = {s: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("pos", "content")))), lambda x: x["content"]) for s in sections if s not in ("Task", "Output")}
    out = rows.groupBy(group).agg(*[v.alias(s) for s, v in lists.items()])
    body = {s: F.array_join(s, "\n---\n" if s == "Evidence" else "\n") for s in lists} | {"Task": F.lit(query), "Output": F.lit(output)}
    parts = [F.when(F.length(body[s]) > 0, F.concat(F.lit(f"[{s}]\n"), body[s])) for s in sections]
    return out.select(group, F.concat_ws("\n\n", *parts).alias("prompt"))


def render_message(role: Column, text: Column, args: Column | None = None, most: int = 200) -> Column:
    """"[role] text", with a tool call's arguments cut at `most` characters."""
    shown = F.concat(F.lit("["), role, F.lit("] "), F.coalesce(text, F.lit("")))
    if args is None:
        return shown
    return F.concat(shown, F.when(args.isNull(), "").otherwise(F.concat(F.lit(" "), F.when(F.length(args) > most, F.concat(F.left(args, F.lit(most)), F.lit("..."))).otherwise(args))))


def shorten(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(F.coalesce(text, F.lit("")))


def render_parts(parts: Column, most: int = 100) -> Column:
    """Content parts(type, text, data, format, name) as one text; an unknown type is empty. Labels are fixed values."""

    def one(p: Column) -> Column:
        data, some = shorten(p["data"], most), lambda c: F.coalesce(p[c], F.lit(""))
        labelled = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
        out = F.when(p["type"] == "text", some("text")).when(p["type"] == "image_url", labelled("[image: ", data, "]"))
        return out.when(p["type"] == "input_audio", labelled("[audio: ", some("format"), " ", data, "]")).when(p["type"] == "file", labelled("[file: ", some("name"), " ", data, "]")).otherwise("")

    return F.array_join(F.transform(parts, one), " ")


def render_whole(role: Column, content: Column, call_id: Column, name: Column, calls: Column, most: int = 200) -> Column:
    """A message with its call id, name, content and tool calls(name, arguments), each only where it has one. Arguments are cut at `most` characters."""
    some = lambda x, *around: F.when(F.coalesce(F.length(x), F.lit(0)) > 0, F.concat(F.lit(around[0]), x, F.lit(around[1]))).otherwise("")
    each = F.transform(calls, lambda c: F.concat(F.lit(" "), c["name"], F.lit("("), shorten(c["arguments"], most), F.lit(")")))
    return F.concat(F.lit("["), role, F.lit("]"), some(call_id, "[call_id=", "]"), some(name, "[name=", "]"), some(content, " ", ""), some(F.array_join(each, ","), " [tool_calls:", "]"))


def cap_history(messages: DataFrame, most: int = 1024, keep: int = 512, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """A conversation of more than `most` messages keeps its last `keep`."""
    all_ = W.partitionBy(group)
    out = messages.withColumn("_n", F.count(F.lit(1)).over(all_)).withColumn("_r", F.row_number().over(all_.orderBy(F.desc(order))))
    return out.filter((F.col("_n") <= most) | (F.col("_r") <= keep)).drop("_n", "_r")
