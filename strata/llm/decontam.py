"""Benchmark decontamination, with DataFrame functions only.

Benchmark items become windows of `width` consecutive words; an item with fewer is one window. A document
cannot hold a window without holding, at a position divisible by `step`, one of the `gram` word runs of that
window, as `step` is the number of such runs in it; so only every step-th position is looked up in a hash
set of the benchmark's runs, and only what is found is compared, word for word, with the windows.

Grams are hashes of lower-cased words (a superset of the matches; sigma is lowered first, as its form would
else depend on what follows); windows are compared by the contract's own case rule. The benchmark is broadcast only if its windows were counted and are few (`most`); else the
same joins shuffle.

Defined cases: null or wordless texts and items have no windows. Rows are told apart by doc_id and text, so
null and repeated doc_ids are judged by their own text. Item ids that repeat count once; all items without id
count as one more, whose windows hit like any other's but which isn't listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import exchange as X

#: What stands between words before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")


def lowered(text: Column) -> Column:
    """Lower case, each letter by itself."""
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """len, key, item: the distinct windows of each item; key has the words lower-cased A-Z, with single spaces."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.translate("text", UPPER, LOW)).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(width)))
    return items.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.concat_ws(" ", F.slice("w", i, F.col("len"))))).alias("key")).distinct()


def gram_hash(w: Column, at: Column, gram: int) -> Column:
    """Hash of the words at .. at + gram - 1, from 1."""
    return F.xxhash64(*[F.element_at(w, (at + k).cast("int")) for k in range(gram)])


def find_windows(docs: DataFrame, benchmark: DataFrame, width: int = 13, gram: int = 4, most: int = 200_000) -> DataFrame:
    """doc_id, th (hash of the text), start, len, item: each occurrence of a window, start in words from 0."""
    windows = X.cut(item_windows(benchmark, width))
    held = X.small_side(windows, most)
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), words(lowered(F.col("text"))).alias("lw"), words(F.col("text")).alias("w"))
    found = None
    for n in sorted(r["len"] for r in windows.select("len").distinct().collect()):  # at most `width` lengths
        g = min(gram, n)
        step = n - g + 1
        own = windows.filter(F.col("len") == n).select(F.split(lowered(F.col("key")), " ").alias("w"))
        grams = X.cut(own.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(step)), lambda i: gram_hash(F.col("w"), i, g))).alias("gh")).distinct())
        spots = F.when(F.size("lw") >= g, F.transform(F.sequence(F.lit(0), F.size("lw") - g, F.lit(step)), lambda i: F.struct(i.alias("at"), gram_hash(F.col("lw"), i + 1, g).alias("gh"), F.slice("w", F.greatest(i + 1 - (step - 1), F.lit(1)), F.lit(n + step - 1) + F.least(i - (step - 1), F.lit(0))).alias("near"))))
        hit = base.select("doc_id", "th", F.explode(spots).alias("s")).select("doc_id", "th", F.col("s.at").alias("at"), F.col("s.gh").alias("gh"), F.col("s.near").alias("near"))
        hit = hit.join(X.small_side(grams, most), "gh", "left_semi")
        first = F.greatest(F.col("at") - (step - 1), F.lit(0))
        hit = hit.filter(F.size("near") >= n).withColumn("first", first)
        # starts from which a window of n words lies within what is near and covers the gram
        hit = hit.select("doc_id", "th", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.size("near") - n, F.col("at") - F.col("first"))), lambda k: F.struct((F.col("first") + k).alias("start"), F.translate(F.concat_ws(" ", F.slice("near", k + 1, F.lit(n))), UPPER, LOW).alias("key")))).alias("x"))
        hit = hit.select("doc_id", "th", F.col("x.start").alias("start"), F.lit(n).alias("len"), F.col("x.key").alias("key"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return base.filter(F.lit(False)).select("doc_id", "th", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("item"))
    return found.join(held, ["len", "key"]).select("doc_id", "th", "start", "len", "item")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, most: int = 200_000) -> DataFrame:
    """For each row of docs(doc_id, text): n_words, n_hit, n_items, items (sorted ids of items with windows in it), spans (maximal
    hit runs of words, from 0, end exclusive), contaminated (share * n_hit >= n_words and a hit), and th, its text's hash."""
    hits = find_windows(docs, benchmark, width, most=most)
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))))
    hits = hits.groupBy("doc_id", "th").agg(spans.alias("s"), F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("int")).alias("unnamed"))
    # overlapping and touching spans, in order, become one
    merged = F.aggregate("s", F.expr("cast(array() as array<struct<start:int,end:int>>)"), lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    hits = hits.select("doc_id", "th", "items", (F.size("items") + F.col("unnamed")).alias("n_items"), merged.alias("spans"))
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = base.alias("d").join(hits.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.th") == F.col("h.th")), "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]), F.lit(0).cast("long"))
    out = out.select(F.col("d.doc_id").alias("doc_id"), F.col("d.th").alias("th"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def remove_documents(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """docs without the contaminated ones. judged: what decontaminate() gives for them."""
    bad = X.cut(judged.filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct())
    return docs.join(X.small_side(bad), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left_anti")


def remove_spans(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """doc_id, text: the words outside all spans, joined by one space; texts without a span are unchanged."""
    cuts = judged.filter("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "spans").dropDuplicates(["_id", "_th"])
    out = docs.select("doc_id", "text").join(cuts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left")
    kept = F.filter(words(F.col("text")), lambda w, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    return out.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(kept, " ")).alias("text"))
