"""MinHash near-dedup by a multi-index Hamming join.

Each set of word shingles has a signature of `slots` b-bit MinHash values (b = 8); two sets of similarity j
agree in a slot with probability j + (1 - j) / 256. Pairs whose signatures differ in at most `distance`
slots are all found: the slots are split into `chunks`, and by the pigeonhole principle, with
distance = chunks * e + a, two such signatures differ in at most e slots of one of the first a + 1 chunks or
in at most e - 1 of another. A chunk with up to e errors is indexed under each choice of e of its slots left
out, so the search for errors is an equality join.

Rows with the same shingle set are one class before any search. Within a bucket of the index no pairs are
listed. Members are linked to the bucket's least and greatest id; links are confirmed on the full sets and
merged into components. Where a bucket still holds several components, signatures at most `distance` apart
connect its members to families; each family is compared on full sets, in memory, by products of 0/1
matrices, block by block if it is large, and gives at most a link for two components and block. No partner
or candidate is capped.

`distance` and `chunks` follow from the percentage: for sets exactly at it the signature distance exceeds
`distance` with a probability below 1e-4 (80 %: distance 28, 6.0e-5; 85 %: 23, 7.7e-5), and of the ways to cut
the slots into chunks that leave three slots or more in each key, the one with the fewest keys is taken.

Defined cases: a text without words has an empty set and is linked with nothing. Rows that repeat a doc_id
are one document if their sets are equal; else each set counts, under the same id, which links them (not so
with `by_text`, where rows are told apart by doc_id and text). Rows without doc_id are returned with null
component_id, kept, and take no part.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as X, kernels as K

SLOTS, BITS = 72, 8
#: Probability at most that two sets exactly at the percentage are further apart than `distance`, and slots of a key at least.
MISS, KEY = 1e-4, 3


def shingles(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingle hashes of each row, sorted within it, and each row's first."""
    start, end, first = K.words(buf, off)
    h = K.word_hashes(K.LOWER[buf], start, end)
    _, s = K.window_hashes(h, first, width)
    row = K.window_rows(first, width)
    n = np.diff(first)
    few = np.flatnonzero((n > 0) & (n < width))
    s = np.concatenate([s, K.spans_hash(h, first[few], first[few + 1])])
    row = np.concatenate([row, few])
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[new], row[new]
    return s, np.searchsorted(row, np.arange(len(off)))


def signatures(s: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """One row of b-bit MinHash values for each row that has shingles."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(some), slots), np.uint8)
    seeds = np.random.RandomState(11).randint(1, 1 << 62, size=(slots, 2), dtype=np.int64).astype(np.uint64)
    for k in range(slots if len(some) else 0):
        h = (s ^ seeds[k, 0]) * (seeds[k, 1] * np.uint64(2) + np.uint64(1))
        low = np.minimum.reduceat(h, first[some])
        out[:, k] = K.mix(low) >> np.uint64(64 - BITS)
    return out


def miss(slots: int, percent: int, distance: int) -> float:
    """Probability that signatures of two sets exactly at `percent` differ in more than `distance` slots."""
    q = (1 - percent / 100) * (1 - 0.5**BITS)
    return sum(comb(slots, k) * q**k * (1 - q) ** (slots - k) for k in range(distance + 1, slots + 1))


def search(slots: int, percent: int) -> tuple[int, int]:
    """(chunks, distance) for sets that share `percent` %."""
    distance = next(d for d in range(slots + 1) if miss(slots, percent, d) < MISS)

    def cost(chunks: int) -> tuple[bool, int]:
        e, a = divmod(distance, chunks)
        edges = np.linspace(0, slots, chunks + 1).astype(int)
        kept = [(j - i, max(1, j - i - (e if k <= a else e - 1))) for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if e or k <= a]
        return min(k for _, k in kept) < KEY, sum(comb(n, k) for n, k in kept)

    return min(range(1, slots + 1), key=cost), distance


def index_parts(slots: int, chunks: int, distance: int) -> list[tuple[int, ...]]:
    """The slots of each key under which a signature is indexed."""
    e, a = divmod(distance, chunks)
    out, edges = [], np.linspace(0, slots, chunks + 1).astype(int)
    for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
        errors = e if k <= a else e - 1
        if errors >= 0:
            out += combinations(range(i, j), max(1, j - i - errors))
    return out


SETS = "doc_id long, n_shingles long, set_hash binary, sig binary"


def names_of(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """The rows that have shingles, and for each row 128 bits that name its set: two sums of mixed hashes."""
    some = np.flatnonzero(np.diff(first))
    name = np.zeros((len(some), 2), np.uint64)
    if len(some):
        name[:, 0] = np.add.reduceat(K.mix(s), first[some])
        name[:, 1] = np.add.reduceat(K.mix(s ^ np.uint64(0x5851F42D4C957F2D)), first[some])
    out: list[bytes | None] = [None] * (len(first) - 1)
    for k, r in enumerate(some.tolist()):
        out[r] = name[k].tobytes()
    return some, out


def sketch(width: int, slots: int):
    """(doc_id, n_shingles, set_hash, sig) and what columns follow doc_id and text."""

    def run(batches):
        for rb in batches:
            ids, none = K.ints(rb.column(0))
            buf, off = K.buffers(rb.column(1))
            for i, j in K.pieces(off, X.PIECE):
                s, first = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                some, named = names_of(s, first)
                sig, sigs = signatures(s, first, slots), [None] * (j - i)
                for k, r in enumerate(some.tolist()):
                    sigs[r] = sig[k].tobytes()
                rest = range(2, rb.num_columns)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64(), mask=none[i:j]), pa.array(np.diff(first).astype(np.int64)), pa.array(named, pa.binary()), pa.array(sigs, pa.binary()), *(rb.column(c).slice(i, j - i) for c in rest)], names=["doc_id", "n_shingles", "set_hash", "sig", *(rb.schema.names[c] for c in rest)])

    return run


def index(parts: list[tuple[int, ...]]):
    """(key, doc_id, comp, sig) for each key of each signature."""

    def run(batches):
        weights = np.random.RandomState(13).randint(1, 1 << 62, size=(len(parts), 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for rb in batches:
            n = rb.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(rb.column(1).to_pylist()), np.uint8).reshape(n, -1).astype(np.uint64)
            keys = np.empty((n, len(parts)), np.uint64)
            for k, slots in enumerate(parts):
                h = np.full(n, (k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
                for s in slots:
                    h = (h + sig[:, s] + np.uint64(1)) * weights[k, s]
                    h ^= h >> np.uint64(31)
                keys[:, k] = K.mix(h)
            at = pa.array(np.repeat(np.arange(n), len(parts)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *(rb.column(i).take(at) for i in range(rb.num_columns))], names=["key", *rb.schema.names])

    return run


def full_sets(width: int):
    """(doc_id, set_hash, s): name and sorted shingle hashes of each row's set."""

    def run(batches):
        for rb in batches:
            ids, _ = K.ints(rb.column(0))
            buf, off = K.buffers(rb.column(1))
            for i, j in K.pieces(off, X.PIECE):
                s, first = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                _, named = names_of(s, first)
                for r in range(0, j - i, 256):
                    q = min(j - i, r + 256)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + r : i + q], pa.int64()), pa.array(named[r:q], pa.binary()), pa.array([s[a:b].tobytes() for a, b in zip(first[r:q].tolist(), first[r + 1 : q + 1].tolist())], pa.binary())], names=["doc_id", "set_hash", "s"])

    return run


def similar(percent: int):
    """Keeps the pairs (a, b, sa, sb) whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        for rb in batches:
            ok = np.zeros(rb.num_rows, bool)
            for i in range(rb.num_rows):
                x, y = (np.frombuffer(rb.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    inter = int(np.count_nonzero(both[1:] == both[:-1]))
                    ok[i] = 100 * inter >= percent * (len(x) + len(y) - inter)
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([rb.column(0).take(at), rb.column(1).take(at)], names=["a", "b"])

    return run


def sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, s): the full sets of the classes in ids(doc_id), by their names in classes(doc_id, rep, set_hash)."""
    wanted = X.fit(classes.join(X.small_side(X.fit(ids.distinct())), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), F.col("rep").alias("doc_id"), "set_hash"))
    texts = docs.join(X.small_side(wanted.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(full_sets(width), "doc_id long, set_hash binary, s binary").dropDuplicates(["doc_id", "set_hash"])
    return X.cut(sets.join(X.small_side(wanted), ["doc_id", "set_hash"]).select(F.col("node").alias("doc_id"), "s"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets(doc_id, s)."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(similar(percent), "a long, b long")


#: Buckets up to this size are listed pair by pair.
FEW = 12
#: Members of a family that one task compares with as many others at a time.
CROWD = 3000
#: Members of a bucket whose signatures one task compares with as many others at a time.
BUCKET = 50_000


def meetings(member: DataFrame, group: str, n: str, most: int) -> DataFrame:
    """member(group, doc_id, comp, n) with x, y, side: the comparisons in which each row takes part. Up to `most` members (n) meet all at
    once, as side 0. Of larger groups all but the largest component are dealt in blocks that meet each other (side 1 has the lesser number) and
    themselves; the largest component is dealt in blocks that meet those, but neither each other nor themselves, as it is linked already."""
    tally = member.filter(F.col(n) > most).groupBy(group, "comp").agg(F.count(F.lit(1)).alias("c"))
    tally = tally.groupBy(group).agg(F.max(F.struct("c", "comp")).alias("big"), F.sum("c").alias("all"))
    pieces = lambda c: F.greatest(F.ceil(c / F.lit(most)), F.lit(1)).cast("int")
    tally = X.fit(tally.select(F.col(group).alias("g"), F.col("big.comp").alias("main"), pieces(F.col("big.c")).alias("crowd"), pieces(F.col("all") - F.col("big.c")).alias("rest")))
    out = member.join(X.small_side(tally), F.col(group) == F.col("g"), "left").withColumn("h", F.xxhash64("doc_id"))
    main = F.col("comp") == F.col("main")
    out = out.withColumn("block", F.when(main, F.col("rest") + F.pmod("h", F.col("crowd"))).otherwise(F.pmod("h", F.col("rest"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(main, F.col("rest")).otherwise(F.col("rest") + F.col("crowd")) - 1)
    side = lambda j: F.when(F.col("block") == j, 0).when(F.col("block") < j, 1).otherwise(2)
    meet = F.transform(others, lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y"), side(j).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side")))
    return out.select(*member.columns, F.explode(F.when(F.col("g").isNull(), alone).otherwise(meet)).alias("m")).select(*member.columns, "m.*")


def neighbours(distance: int):
    """Links (a, b) that connect what is connected, in one bucket or between two of its blocks (doc_id, side, sig), by signatures at most
    `distance` slots apart. In a bucket a member is compared only with those not reached yet, so a crowd of alike members costs little more
    than one pass; between blocks a member is linked once with what others have joined."""

    def run(packs: pa.Table) -> pa.Table:
        ids, side = packs.column("doc_id").to_numpy(), packs.column("side").to_numpy()
        sig = np.frombuffer(b"".join(packs.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        todo, a, b = np.arange(len(ids)), [], []
        if side.max() > 0:
            todo, right = np.zeros(0, np.int64), np.flatnonzero(side == 2)
            joined = np.arange(len(right))
            for x in np.flatnonzero(side == 1):
                hit = np.flatnonzero(np.count_nonzero(sig[right] != sig[x], axis=1) <= distance)
                parts, first = np.unique(joined[hit], return_index=True)
                a.append(np.full(len(first), ids[x]))
                b.append(ids[right[hit[first]]])
                if len(parts) > 1:
                    joined[np.isin(joined, parts)] = parts[0]
        while len(todo):
            queue, todo = [todo[0]], todo[1:]
            while queue and len(todo):
                x = queue.pop()
                hit = np.count_nonzero(sig[todo] != sig[x], axis=1) <= distance
                found, todo = todo[hit], todo[~hit]
                a.append(np.full(len(found), ids[x]))
                b.append(ids[found])
                queue += found.tolist()
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], block: int = 1024) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets: products of 0/1 matrices, `block` shared elements at a time."""
    l, r = np.concatenate(left), np.concatenate(right)
    row_l, row_r = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.intersect1d(l, r)
    at_l, at_r = np.searchsorted(both, l), np.searchsorted(both, r)
    ok_l, ok_r = at_l < len(both), at_r < len(both)
    ok_l[ok_l] = both[at_l[ok_l]] == l[ok_l]
    ok_r[ok_r] = both[at_r[ok_r]] == r[ok_r]
    at_l, row_l, at_r, row_r = at_l[ok_l], row_l[ok_l], at_r[ok_r], row_r[ok_r]
    order_l, order_r = np.argsort(at_l, kind="stable"), np.argsort(at_r, kind="stable")
    at_l, row_l, at_r, row_r = at_l[order_l], row_l[order_l], at_r[order_r], row_r[order_r]
    out = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, len(both), block):
        width = min(block, len(both) - i)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        p, q = np.searchsorted(at_l, [i, i + width])
        x[row_l[p:q], at_l[p:q] - i] = 1
        p, q = np.searchsorted(at_r, [i, i + width])
        y[row_r[p:q], at_r[p:q] - i] = 1
        out += x @ y.T
    return out


def family_links(percent: int):
    """Links (a, b) between members of different components in a family, or between two of its blocks: (doc_id, comp, side, s). Of the
    links between two components one is enough."""

    def run(packs: pa.Table) -> pa.Table:
        ids, comp, side = (packs.column(c).to_numpy() for c in ("doc_id", "comp", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in packs.column("s").to_pylist()]
        crowd = np.bincount(np.unique(comp, return_inverse=True)[1])
        big = np.unique(comp)[crowd.argmax()]
        # all but the largest component are compared with all
        left = np.flatnonzero((comp != big) & (side <= 1) if side.max() <= 1 else side == 1)
        right = np.arange(len(ids)) if side.max() <= 1 else np.flatnonzero(side == 2)
        a, b = [], []
        size = np.array([len(x) for x in sets], np.float32)
        for i in range(0, len(left), 256):
            l = left[i : i + 256]
            inter = overlaps([sets[k] for k in l], [sets[k] for k in right])
            ok = (100 * inter >= percent * (size[l][:, None] + size[right][None, :] - inter)) & (comp[l][:, None] != comp[right][None, :])
            x, y = np.nonzero(ok)
            pair = np.unique(np.stack([comp[l][x], comp[right][y]], 1), axis=0, return_index=True)[1] if len(x) else x
            a.append(ids[l][x[pair]])
            b.append(ids[right][y[pair]])
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return run


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(doc_id, comp): the least id reachable, for each id in edges(a, b); alternating large-star and small-star steps
    (Kiveris et al., 2014), each cut to the shared folder. Stars aggregate before they shuffle but for their own members."""
    e = X.fit(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    last = None
    for _ in range(most):
        # large star: neighbours above u go to the least of u's neighbourhood
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # small star: u and its lesser neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(least.select("u", F.col("m").alias("v"))).distinct()
        e = X.cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = X.counted(e, now[0])
        if now == last:
            return e.select(F.col("u").alias("doc_id"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("doc_id"), F.col("v").alias("comp")).distinct())
        last = now
    raise RuntimeError("components did not settle")


def distant(distance: int):
    """Keeps the pairs (a, b, xa, xb) whose signatures differ in at most `distance` slots."""

    def run(batches):
        for rb in batches:
            n = rb.num_rows
            if n:
                x, y = (np.frombuffer(b"".join(rb.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in (2, 3))
                at = pa.array(np.flatnonzero(np.count_nonzero(x != y, axis=1) <= distance))
                yield pa.RecordBatch.from_arrays([rb.column(0).take(at), rb.column(1).take(at)], names=["a", "b"])

    return run


def dedup_near(docs: DataFrame, width: int = 5, percent: int = 80, slots: int = SLOTS, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text): component_id is the least doc_id that can be
    reached by links between texts whose sets of `width`-word shingles have percent % or more in common. With by_text also th, the
    text's hash, and texts are not linked by an id that they share."""
    docs = X.narrow(docs, "doc_id", "text")
    chunks, distance = search(slots, percent)
    extra = ["th"] if by_text else []
    sets = X.cut(docs.withColumns({c: F.xxhash64("text") for c in extra}).mapInArrow(sketch(width, slots), SETS + "".join(f", {c} long" for c in extra)))
    some = sets.filter("doc_id is not null and set_hash is not null").select("doc_id", "set_hash", "sig")
    classes = X.cut(some.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    # a class is named by its least doc_id; further classes with the same one by a hash of their set
    several = X.cut(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min("set_hash").alias("least")).filter("n > 1").select("rep", "least"))
    classes = X.cut(classes.join(X.small_side(several), "rep", "left").select("rep", "set_hash", "sig", F.when(F.col("least") != F.col("set_hash"), F.xxhash64("set_hash")).otherwise(F.col("rep")).alias("doc_id")))
    parts = index_parts(slots, chunks, distance)
    keyed = classes.select("doc_id", "sig")
    found = keyed.select("doc_id", "sig").mapInArrow(index(parts), "key long, doc_id long, sig binary").select("key", "doc_id")
    # keys with more than one member: the least and the greatest are the hubs
    hubs = found.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    shared = X.cut(found.join(hubs, "key"))
    pairs = X.cut(shared.select(F.col("lo").alias("a"), F.col("doc_id").alias("b")).union(shared.select(F.col("doc_id").alias("a"), F.col("hi").alias("b"))).filter("a < b").distinct())
    sig = keyed.dropDuplicates(["doc_id"])
    near = lambda p: p.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("xa")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("xb")), "b").select("a", "b", "xa", "xb").mapInArrow(distant(distance), "a long, b long")
    pairs = X.fit(near(pairs))
    links = X.fit(confirm(pairs, sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), classes, docs, width), percent))
    comp = X.fit(components(links))
    # what is left: members of a bucket that holds several components
    member = shared.select("key", "doc_id").join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    split = member.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("n")).filter("c0 < c1 and n > 2").select("key", "n")
    member = X.cut(member.join(split, "key"))
    few = member.filter(F.col("n") <= FEW)
    listed = few.select("key", F.col("doc_id").alias("a"), F.col("comp").alias("ca")).join(few.select("key", F.col("doc_id").alias("b"), F.col("comp").alias("cb")), "key").filter("a < b and ca <> cb").select("a", "b").distinct()
    crowds = meetings(member.filter(F.col("n") > FEW), "key", "n", BUCKET).join(sig, "doc_id").select("key", "x", "y", "side", "doc_id", "sig")
    crowds = crowds.groupBy("key", "x", "y").applyInArrow(neighbours(distance), "a long, b long")
    # families: all that signatures connect in some bucket; each is compared on full sets
    family = X.fit(components(near(listed).union(crowds)).withColumnRenamed("comp", "family"))
    member = X.fit(member.select("doc_id", "comp").distinct().join(family, "doc_id"))
    size = member.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("family", "n")
    member = X.fit(member.join(size, "family"))
    full = sets_of(member.select("doc_id"), classes, docs, width)
    crowd = meetings(member, "family", "n", CROWD).select("doc_id", "comp", "family", "x", "y", "side").join(full, "doc_id")
    more = X.fit(crowd.groupBy("family", "x", "y").applyInArrow(family_links(percent), "a long, b long"))
    links = links.union(more)
    if not by_text:  # an id with several sets stands for several classes, which it links
        met = some.join(classes.select("set_hash", F.col("doc_id").alias("node")), "set_hash").select("doc_id", "node")
        ends = X.cut(met.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a"))
        links = links.union(met.join(X.small_side(ends), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b"))
    comp = X.fit(components(links)).join(classes.select("doc_id", "rep"), "doc_id")
    least = comp.groupBy("comp").agg(F.min("rep").alias("least"))
    comp = X.fit(comp.join(least, "comp").select("doc_id", "least"))
    by_class = classes.select("set_hash", "rep", "doc_id").join(comp, "doc_id", "left").select("set_hash", F.coalesce("least", "rep").alias("comp"))
    out = sets.select("doc_id", "n_shingles", "set_hash", *extra).join(by_class, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *extra)
