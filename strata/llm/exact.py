"""Exact dedup: counting quotient filters of text fingerprints, then byte verification of what they count twice.

Each partition builds a filter of its 64-bit fingerprints for each range of quotients; filters of one range
merge losslessly, as both hold their remainders sorted. Only texts whose fingerprint has a count above one
are compared, byte by byte, by grouping on the text itself, with partial aggregation, so a group of copies
with a third of all rows leaves each map task as one row.

Defined cases: null text counts as empty. Copies without doc_id come after those with one: of a group with
no doc_id at all keep_id is null. Rows that repeat both doc_id and text are each marked kept; `keep_first`, which
the pipeline uses, leaves one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as X, kernels as K

BLANKS = r"[\x20\x09-\x0D]+"


class QuotientFilter:
    """A static counting quotient filter: fingerprints split into a quotient and a remainder. Bit `occupied[q]` says
    that quotient q has a run; `run_end` marks the last slot of each run; remainders are sorted in their run; each
    slot has a count."""

    def __init__(self, bits: int, skip: int, occupied: np.ndarray, run_end: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.skip, self.occupied, self.run_end, self.remainders, self.counts = bits, skip, occupied, run_end, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, skip: int) -> QuotientFilter:
        """skip: leading bits that all fingerprints share. Equal fingerprints add their counts."""
        order = np.argsort(fingerprints, kind="stable")
        f, c = fingerprints[order], counts[order]
        new = np.ones(len(f), bool)
        new[1:] = f[1:] != f[:-1]
        at = np.flatnonzero(new)
        return cls.from_sorted(f[at], np.add.reduceat(c, at) if len(at) else c, skip)

    @classmethod
    def from_sorted(cls, f: np.ndarray, c: np.ndarray, skip: int) -> QuotientFilter:
        """f: different fingerprints in order."""
        bits = max(1, min(63 - skip, int(np.ceil(np.log2(max(2, len(f)))))))
        body = f << np.uint64(skip) if skip else f
        q = (body >> np.uint64(64 - bits)).astype(np.int64)
        occupied = np.zeros(1 << bits, bool)
        occupied[q] = True
        end = np.ones(len(f), bool)
        end[:-1] = q[1:] != q[:-1]
        return cls(bits, skip, occupied, end, (body << np.uint64(bits)) >> np.uint64(bits + skip), c)

    def items(self, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints in order, counts)."""
        run = np.concatenate([[0], np.cumsum(self.run_end)[:-1]]).astype(np.int64)
        q = np.flatnonzero(self.occupied)[run] if len(run) and len(self.remainders) else np.zeros(0, np.int64)
        f = (q.astype(np.uint64) << np.uint64(64 - self.bits - self.skip)) | self.remainders
        return (f | (np.uint64(prefix) << np.uint64(64 - self.skip)) if self.skip else f), self.counts

    def merge(self, other: QuotientFilter, prefix: int) -> QuotientFilter:
        """Both hold their remainders in order, so one pass finds where each of the other's goes; what both have adds up."""
        (a, m), (b, n) = self.items(prefix), other.items(prefix)
        at = np.searchsorted(a, b)
        both = np.zeros(len(b), bool)
        inside = at < len(a)
        both[inside] = a[at[inside]] == b[inside]
        m = m.copy()
        m[at[both]] += n[both]
        return QuotientFilter.from_sorted(np.insert(a, at[~both], b[~both]), np.insert(m, at[~both], n[~both]), self.skip)

    def dump(self) -> tuple[bytes, bytes, bytes, bytes]:
        head = np.array([self.bits, self.skip, len(self.counts)], np.int64).tobytes()
        return head + np.packbits(self.occupied).tobytes(), np.packbits(self.run_end).tobytes(), X.pack_ints(self.counts), self.remainders.astype("<u8").tobytes()

    @classmethod
    def load(cls, a: bytes, b: bytes, c: bytes, h: bytes) -> QuotientFilter:
        bits, skip, n = np.frombuffer(a[:24], np.int64).tolist()
        unbits = lambda raw, k: np.unpackbits(np.frombuffer(raw, np.uint8))[:k].astype(bool)
        return cls(bits, skip, unbits(a[24:], 1 << bits), unbits(b, n), np.frombuffer(h, "<u8"), X.unpack_ints(c))


def build_filters(bits: int):
    def run(batches):
        held: dict[int, list[QuotientFilter]] = {}
        for rb in batches:
            f = K.ints(rb.column(0))[0].view(np.uint64)
            for b, at in X.by_bucket(X.top_bits(f, bits)):
                stack = held.setdefault(b, [])
                stack.append(QuotientFilter.of(f[at], np.ones(len(at), np.int64), bits))
                while len(stack) > 1 and len(stack[-2].counts) <= 2 * len(stack[-1].counts):  # so that a fingerprint is merged a few times only
                    last = stack.pop()
                    stack[-1] = stack[-1].merge(last, b)
        out = []
        for b, stack in held.items():
            while len(stack) > 1:
                last = stack.pop()
                stack[-1] = stack[-1].merge(last, b)
            out.append((b, 0, *stack[0].dump()))
        if out:
            yield X.batch(out)

    return run


def repeated(packs: pa.Table) -> pa.Table:
    """Fingerprints of one range whose merged count is above one."""
    prefix = packs.column("bucket")[0].as_py()
    filters = [QuotientFilter.load(*x) for x in zip(*(packs.column(n).to_pylist() for n in "abch"))]
    while len(filters) > 1:  # pairwise, so each level touches each slot once
        filters = [a.merge(b[0], prefix) if b else a for a, b in ((filters[i], filters[i + 1 : i + 2]) for i in range(0, len(filters), 2))]
    f, n = filters[0].items(prefix)
    return pa.table({"fp": pa.array(f[n > 1].view(np.int64)), "n": pa.array(n[n > 1].astype(np.int64))})


def dedup_exact(docs: DataFrame, by_text: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the text with runs of blanks as one space) for each row of docs(doc_id, text); with
    by_text also th, the text's hash."""
    extra = ["th"] if by_text else []
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " ")
    base = docs.select("doc_id", norm.alias("norm"), *(F.xxhash64("text").alias(c) for c in extra)).select("doc_id", "norm", F.xxhash64("norm").alias("fp"), *extra)
    prints = X.cut(base.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256"), *extra))
    bits = X.bits_for(16 * prints.count(), 64 << 20)
    twice = X.cut(prints.select("fp").mapInArrow(build_filters(bits), X.PACKED).groupBy("bucket").applyInArrow(repeated, "fp long, n long"))
    same = base.join(X.small_side(twice.select("fp")), "fp").groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    same = X.cut(same.select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size").filter("group_size > 1"))
    out = prints.join(X.small_side(same), ["fp", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", *extra)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each normalised text: the least doc_id's; of rows that share that too the one with the least hash of its text, then of all its columns."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = X.cut(dedup_exact(docs, by_text=True))
    gone = X.cut(judged.filter("not kept").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct())
    # rows that their doc_id doesn't tell apart
    twice = judged.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("th"), F.collect_set("th").alias("all")).filter("n > 1")
    twice = X.cut(twice.select("doc_id", "th", F.explode("all").alias("each")))
    same = lambda th: F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col(th))
    out = docs.join(X.small_side(gone), same("__th"), "left_anti")
    if twice.isEmpty():
        return out
    side = X.small_side(twice.select(F.col("doc_id").alias("__id"), F.col("each").alias("__each"), F.col("th").alias("__least")))
    alone = out.join(side, same("__each"), "left_anti")
    first = out.join(side, same("__each") & (F.col("__each") == F.col("__least")), "left_semi").groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th")).agg(F.min_by(every, F.xxhash64(every)).alias("__row"))
    return alone.unionByName(first.select("__row.*"))
