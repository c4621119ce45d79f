"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket; running sums find the bucket in which a source's budget ends;
only that bucket is summed again by finer buckets, down to single hash values. What lies below the
threshold is taken, with no sort of documents. Budgets are nested: a document in a smaller one is in every
larger one. Hashes are of doc_id, so reruns agree.

Defined cases: null text has no words; a null source is a source of its own, after all others; rows without
doc_id share one hash, as do rows that repeat a doc_id, and are taken together. A source without words has
target 0. Histograms aggregate before they shuffle, so a source with most rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import exchange as X

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the 60-bit hash that each refinement resolves.
LEVELS = (10, 10, 20, 20)
#: Passes over a source at most.
REPEATS = 3


def hash60(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """source, source_size, target, passes, rest: shares by weight of share * all sizes, none above `repeats` times its source; what is above goes to the others by weight."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    own = own.withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size"))
    # sources in the order in which they reach their cap as the level of words for each unit of weight rises
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own = own.withColumn("num", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("den", F.sum("weight").over(after))
    own = own.withColumn("capped", F.col("num") / F.col("den") > F.col("cap") / F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct("capped", (F.col("cap") / F.col("weight")).alias("r"), "num", "den"))).over(everything)
    own = own.withColumn("level", level)
    target = F.when(F.col("capped") | F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level.num") / F.col("level.den")))
    own = own.select("source", "source_size", target.alias("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return own.withColumn("passes", passes.cast("long")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets(source, budget, rest, ...) with `below`: a document of the source is taken once more if its hash is less. The set is the prefix, in hash order, whose size is nearest to rest."""
    found = X.cut(budgets.withColumns({"prefix": F.lit(0).cast("long"), "base": F.lit(0).cast("long"), "step": F.lit(0).cast("long")}))
    shift = 60
    for bits in LEVELS:
        shift -= bits
        hist = sizes.alias("d").join(X.small_side(found.select("source", "budget", "prefix")).alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.shiftright("d.h", shift + bits) == F.col("b.prefix")))
        hist = hist.groupBy(F.col("b.source").alias("s"), F.col("b.budget").alias("k"), F.shiftright("d.h", shift).alias("bucket")).agg(F.sum("d.size").alias("own"))
        hist = hist.withColumn("upto", F.sum("own").over(W.partitionBy("s", "k").orderBy("bucket")))
        f = found.alias("f").join(hist.alias("h"), F.col("f.source").eqNullSafe(F.col("h.s")) & (F.col("f.budget") == F.col("h.k")), "left")
        # the first bucket that ends above the budget; a source whose budget is all it has gets none
        hit = F.min(F.when(F.col("base") + F.col("upto") > F.col("rest"), F.struct("bucket", "upto", "own")))
        f = f.groupBy(*[F.col(f"f.{c}").alias(c) for c in found.columns]).agg(hit.alias("hit"))
        found = X.cut(f.select(*[c for c in found.columns if c not in ("prefix", "base", "step")], F.col("hit.bucket").alias("prefix"), (F.col("base") + F.col("hit.upto") - F.col("hit.own")).alias("base"), F.col("hit.own").alias("step")))
    nearer = (2 * F.col("base") + F.col("step") <= 2 * F.col("rest")).cast("long")
    return found.withColumn("below", F.when(F.col("rest") <= 0, F.lit(0)).otherwise(F.coalesce(F.col("prefix") + nearer, F.lit(1 << 60)))).drop("prefix", "base", "step")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shares: tuple[float, ...] = (1.0,), repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, takes for each row of docs(doc_id, text, source). weights: by the order of
    the sources, repeating. shares: nested budgets as shares of all words, increasing; takes has the words taken for each, target and taken are the last one's."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sizes = X.cut(docs.select("doc_id", "source", size.alias("size"), hash60(F.col("doc_id")).alias("h")))
    budgets = None
    for k, share in enumerate(shares):
        one = targets(sizes, weights, share, repeats).withColumn("budget", F.lit(k))
        budgets = one if budgets is None else budgets.unionByName(one)
    found = thresholds(sizes, budgets)
    by_source = X.cut(found.groupBy("source", "source_size").agg(F.max(F.struct("budget", "target")).getField("target").alias("target"), F.array_sort(F.collect_list(F.struct("budget", "passes", "below"))).alias("b")))
    out = sizes.alias("d").join(X.small_side(by_source).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    takes = F.transform("b", lambda x: F.col("size") * (x["passes"] + F.when(F.col("h") < x["below"], 1).otherwise(0)))
    out = out.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", takes.alias("takes"))
    return out.select("doc_id", "source", "size", "source_size", "target", F.element_at("takes", -1).alias("taken"), "takes")
