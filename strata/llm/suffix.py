"""Suffix-array dedup of byte strings: two-stage sorting, then adjacent common prefixes.

A corpus-wide suffix array is cut into independent ones such that equal strings of `width` bytes always meet:
each window of `width` bytes belongs to its minimizer, the least hash of the 32-byte strings in it.

1. Map: minimizers of all windows of whole texts, about one in 35 bytes; those that occur once cannot lie in
   a repeated window. Reduce by hash: the places of minimizers that occur more than once.
2. At these places the windows of one minimizer form one short segment. Equal segments collapse to the
   earliest, in each task and again in each bucket. Segments go to the bucket of their minimizer.
3. For each bucket, the suffixes that begin a window are sorted in two stages: those smaller than their
   successor directly, all others induced by scans of the byte buckets in order. Suffixes whose common
   prefix with their neighbour has `width` bytes are equal windows; all but the earliest are removals.
4. Removals meet their texts by doc_id and merge into maximal spans.

Minimizers that occur at least `hot` times (raised so that no more than 65,536 can exist) send their windows
one by one, by the window's own hash, so no bucket holds a passage of a third of all rows with its contexts.

Defined cases: null text is empty. Rows without doc_id take no part and lose nothing. Different texts under one
doc_id are different documents, in the order of a hash of the text; rows that repeat both are one document and
keep the same. Order is (doc_id, that hash, start).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import exchange as X, kernels as K
from .substring import earliest

GRAM = 32
#: Window starts that are hashed at a time; their arrays stay in a core's cache.
BLOCK = 1 << 16
MASK = np.uint64((1 << 21) - 1)
#: Bits of a minimizer that travel, by which hot ones are told.
TRAVELS = np.uint64((1 << 56) - 1)
#: A run of removed windows, or of windows with one minimizer, as it travels. Starts are bytes of one text, below 2**31.
RUN = np.dtype([("doc_id", "<i8"), ("version", "<i8"), ("start", "<u4"), ("n", "<u4")])
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def anchors(buf: np.ndarray, width: int):
    """(first start, minimizer position of each window, its hash) for blocks of window starts. Ties go to the leftmost."""
    total = len(buf) - width + 1
    for s in range(0, total, BLOCK):
        e = min(total, s + BLOCK)
        h = K.byte_hashes(buf[s : e + width - 1], GRAM)
        low = K.sliding_min((h & ~MASK) | np.arange(len(h), dtype=np.uint64), width - GRAM + 1)
        at = (low & MASK).astype(np.int64)
        yield s, at + s, K.mix(h[at])  # minima are small numbers; mixed again, they fill all buckets alike


def segments(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, minimizer position, hash) of the runs of windows with one minimizer, none across rows."""
    parts = []
    for s, at, h in anchors(buf, width):
        start = np.arange(s, s + len(at))
        lo, hi = np.searchsorted(off, [s, s + len(at) - 1], "right") - 1
        held = np.diff(np.clip(off[lo : hi + 2], s, s + len(at)))
        row = np.repeat(np.arange(lo, hi + 1), held)
        ok = start + width <= np.repeat(off[lo + 1 : hi + 2], held)
        start, at, h, row = start[ok], at[ok], h[ok], row[ok]
        if len(start):
            new = np.ones(len(start), bool)
            new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
            k = np.flatnonzero(new)
            parts.append((row[k], start[k], np.diff(np.append(k, len(start))), at[k], h[k]))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def hash_anchors(width: int, bits: int):
    def run(batches):
        for rb in X.gathered(batches):
            ids, none = K.ints(rb.column(0))
            ver, _ = K.ints(rb.column(1))
            buf, off = K.buffers(rb.column(2))
            found = []
            for i, j in K.pieces(off, X.PIECE):
                row, _, _, at, h = segments(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                # one minimizer that two blocks share counts once
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                ok = new & ~none[i:j][row]
                found.append((row[ok] + i, at[ok] + off[i], h[ok]))
            if not found:
                continue
            row, at, h = (np.concatenate(x) for x in zip(*found))
            rows = []
            for b, k in X.by_bucket(X.top_bits(h, bits)):
                change = np.flatnonzero(np.diff(row[k], prepend=-1))
                rows.append((b, 0, X.pack_ints(ids[row[k]][change]), X.pack_ints(np.diff(np.append(change, len(k)))), X.pack_ints(at[k] - off[row[k]] + (row[k] << 32)), X.pack_hashes(h[k]), X.pack_ints(ver[row[k]][change])))
            if rows:
                yield X.batch(rows)

    return run


def repeated(id_bits: int, hot: int):
    """Places of minimizers that occur more than once (kind 1), and the hashes of hot ones (kind 2)."""

    def run(packs: pa.Table) -> pa.Table:
        rows, bits = [], packs.column("bucket")[0].as_py()
        a, b, c, x, alt = (packs.column(n).to_pylist() for n in "abchv")
        h = np.concatenate([X.unpack_hashes(v) for v in x])
        own, ver = (np.concatenate([np.repeat(X.unpack_ints(v), X.unpack_ints(w)) for v, w in zip(y, b)]) for y in (a, alt))
        pos = np.concatenate([X.unpack_ints(v) for v in c]) & 0xFFFFFFFF
        order = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1], [True]]))
        n = np.diff(edge)
        many = order[np.repeat(n > 1, n)]
        rows += X.places(own[many], ver[many], pos[many], id_bits)
        if (n >= hot).any():
            rows.append((bits, 2, None, None, None, h[order[edge[:-1]]][n >= hot].astype("<u8").tobytes()))
        return X.table(rows)

    return run


def as_records(ids: np.ndarray, ver: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), RUN)
    out["doc_id"], out["version"], out["start"], out["n"] = ids, ver, start, n
    return out


def spans(ids: np.ndarray, ver: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Records of runs of n removed windows each; touching runs of a document merge."""
    order = np.lexsort((start, ver, ids))
    ids, ver, start, end = ids[order], ver[order], start[order], (start + n)[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (ver[1:] != ver[:-1]) | (start[1:] > end[:-1])
    k = np.flatnonzero(new)
    return as_records(ids[k], ver[k], start[k], (np.maximum.reduceat(end, k) if len(k) else end) - start[k])


def cut_segments(width: int, bits: int, hot: np.ndarray):
    """Texts of one bucket of documents and the places in them: the segments at these places, one row for each bucket of minimizers (kind 0),
    and the removals among equal ones, which all lie in these documents (kind 1)."""

    def cut_piece(own, ver, buf, off, some, pos, at_marks, home: int) -> list[pa.RecordBatch]:
        sub = np.concatenate([buf[off[k] : off[k + 1]] for k in some.tolist()])
        base = np.concatenate([[0], np.cumsum((off[1:] - off[:-1])[some])])
        row, start, n, at, h = segments(sub, base, width)
        want = np.zeros(len(sub), bool)
        for r, k in enumerate(some.tolist()):
            p = pos[slice(*at_marks[k])] + base[r]
            want[p[p < base[r + 1]]] = True
        ok = want[at]
        row, start, n, h = row[ok], start[ok], n[ok], h[ok]
        single = np.isin(h & TRAVELS, hot)
        if single.any():
            r, s, c = row[single], start[single], n[single]
            s = np.repeat(s, c) + K.ranges(c)
            row, start, n = np.concatenate([row[~single], np.repeat(r, c)]), np.concatenate([start[~single], s]), np.concatenate([n[~single], np.ones(len(s), np.int64)])
            h = np.concatenate([h[~single], K.spans_hash(sub, s, s + width)])
        if not len(row):
            return []
        doc, alt, rel = own[some][row], ver[some][row], start - base[row]
        name = K.spans_hash(sub, start, start + n + width - 1) ^ K.mix(h)
        keep, later = earliest(name, doc, alt, rel)
        keep.sort()
        gone = spans(doc[later], alt[later], rel[later], n[later])
        size, first = n[keep] + width - 1, start[keep]
        body = lambda k: sub[np.repeat(first[k], size[k]) + K.ranges(size[k])]
        return X.dealt(np.full(len(gone), home), gone, 1) + X.dealt(X.top_bits(h[keep], bits), as_records(doc[keep], alt[keep], rel[keep], n[keep]), 0, size, body)

    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        marked, out = X.Marks(marks, "b"), []
        packs = list(X.unpack_texts(texts)) if len(marked.values[0]) else []
        if packs:
            home = texts.column("bucket")[0].as_py()
            own, ver, none, buf, size = (np.concatenate(x) for x in zip(*((own, ver, none, buf, np.diff(off)) for own, ver, none, buf, off in packs)))
            del packs
            off = np.concatenate([[0], np.cumsum(size)])
            at_marks = marked.of(own, ver, none)
            some = np.flatnonzero([hi > lo for lo, hi in at_marks])
            held = np.concatenate([[0], np.cumsum(size[some])])
            for p, q in K.pieces(held, 4 * X.PIECE):
                out += cut_piece(own, ver, buf, off, some[p:q], marked.values[0], at_marks, home)
        return pa.Table.from_batches(out, X.PACKED_ARROW)

    return run


def two_stage_sort(text: np.ndarray, first: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows in the order of their first `width` bytes. text: segments one after another, each with an end
    marker 0 (bytes are 1 to 256); first: their starts; n: windows that begin in each."""
    total = len(text)
    # a suffix is smaller than its successor if the first change of byte from it on is a rise
    change = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.searchsorted(change, np.arange(total))
    rise = np.zeros(total, bool)
    has = nxt < len(change)
    at = change[nxt[has]]
    rise[has] = text[at] < text[at + 1]
    rise[text == 0] = True  # an end marker is the least of all
    # to be ordered: windows, and what follows the last one of a segment up to the first suffix that is sorted directly
    stop = first + n
    ups = np.flatnonzero(rise)
    stop = ups[np.searchsorted(ups, stop)]
    size = stop - first + 1
    todo = np.repeat(first, size) + K.ranges(size)
    direct = todo[rise[todo]]
    pad = np.maximum(np.concatenate([text, np.zeros(width, text.dtype)]), 1) - 1
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(pad.astype(np.uint8), width)[direct])
    order = pc.array_sort_indices(pa.Array.from_buffers(pa.binary(width), len(direct), [None, pa.py_buffer(keys)])).to_numpy()
    direct = direct[order]
    ends = text[direct] == 0  # in the keys an end marker looks like a zero byte
    direct = np.concatenate([direct[ends], direct[~ends]])
    del keys
    lead = np.zeros(total, bool)
    lead[first] = True
    induces = np.zeros(total, bool)  # the suffix before it is to be ordered and not sorted directly
    inner = todo[~lead[todo]]
    induces[inner] = ~rise[inner - 1]
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    by_byte = np.searchsorted(text[direct], np.arange(258))
    out = []

    def deal(run: np.ndarray, byte: int) -> np.ndarray:
        """The suffixes before those of a run, into the buckets of their first bytes; those of this bucket are returned."""
        before = run[induces[run]] - 1
        own = text[before]
        same = before[own == byte]
        up = own > byte
        before, own = before[up], own[up]
        k = np.argsort(own, kind="stable")
        before, own = before[k], own[k]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if j > i:
                waiting[int(own[i])].append(before[i:j])
        return same

    for byte in range(257):
        run = np.concatenate(waiting[byte]) if waiting[byte] else direct[:0]
        waiting[byte] = []
        while len(run):
            out.append(run)
            run = deal(run, byte)
        run = direct[by_byte[byte] : by_byte[byte + 1]]
        if len(run):
            out.append(run)
            deal(run, byte)
    full = np.concatenate(out) if out else direct
    is_window = np.zeros(total, bool)
    is_window[np.repeat(first, n) + K.ranges(n)] = True
    return full[is_window[full]]


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, width: int, block: int = 1 << 15) -> np.ndarray:
    """Common prefix, up to width, of each suffix with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    rows = np.lib.stride_tricks.sliding_window_view((text - 1).astype(np.uint8), width)  # no window holds an end marker
    for i in range(1, len(order), block):
        j = min(i + block, len(order))
        both = rows[order[i - 1 : j]]
        differ = both[1:] != both[:-1]
        out[i:j] = np.where(differ.any(1), differ.argmax(1), width)
    return out


def resolve(width: int, id_bits: int):
    def run(packs: pa.Table) -> pa.Table:
        through = packs.filter(pc.equal(packs.column("kind"), 1))
        packs = packs.filter(pc.equal(packs.column("kind"), 0))
        if not packs.num_rows:
            return through
        held, (body, _) = X.records(packs, RUN), K.buffers(packs.column("c"))
        ids, ver, start, n = (held[f].astype(np.int64) for f in RUN.names)
        size = n + width - 1
        first = np.cumsum(size) - size
        keep, later = earliest(K.spans_hash(body, first, first + size), ids, ver, start)
        keep.sort()
        gone = [(ids[later], ver[later], start[later], n[later])]
        ids, ver, start, n, size, first = ids[keep], ver[keep], start[keep], n[keep], size[keep], first[keep]
        text = np.zeros(int(size.sum()) + len(size), np.uint16)
        to = np.cumsum(size + 1) - size - 1
        text[np.repeat(to, size) + K.ranges(size)] = body[np.repeat(first, size) + K.ranges(size)].astype(np.uint16) + 1
        order = two_stage_sort(text, to, n, width)
        same = adjacent_prefixes(text, order, width) >= width
        group = np.cumsum(~same).astype(np.uint64)
        seg = np.searchsorted(to, order, "right") - 1
        own, alt, pos = ids[seg], ver[seg], start[seg] + order - to[seg]
        many = np.zeros(len(order), bool)
        many[same] = True
        many[:-1] |= same[1:]
        _, later = earliest(group[many], own[many], alt[many], pos[many])
        gone.append((own[many][later], alt[many][later], pos[many][later], np.ones(len(later), np.int64)))
        gone = spans(*(np.concatenate(x) for x in zip(*gone)))
        rows = X.dealt(X.id_bucket(gone["doc_id"], id_bits, gone["version"]), gone, 1)
        return pa.concat_tables([through, pa.Table.from_batches(rows, X.PACKED_ARROW)])

    return run


def strip(width: int):
    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        marked = X.Marks.of_records(X.records(marks, RUN))
        pos, n = marked.values
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
        for own, ver, none, buf, off in X.unpack_texts(texts):
            for i, (doc, (lo, hi)) in enumerate(zip(own.tolist(), marked.of(own, ver, none))):
                raw = buf[off[i] : off[i + 1]]
                gone = np.zeros(len(raw), bool)
                if hi > lo:
                    step = np.zeros(len(raw) + 1, np.int64)
                    s, m = pos[lo:hi], n[lo:hi]
                    np.add.at(step, s, 1)
                    np.add.at(step, s + m + width - 1, -1)
                    gone = np.cumsum(step[:-1]) > 0
                out["doc_id"].append(None if none[i] else doc)
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int(np.count_nonzero(gone)))
                out["n_spans"].append(K.runs(gone))
                out["kept"].append(raw[~gone].tobytes())
        return pa.table({k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()})

    return run


def dedup_bytes(docs: DataFrame, width: int = 100, hot: int = 100_000) -> DataFrame:
    """For each row of docs(doc_id, text), as UTF-8: bytes, removed bytes, their maximal spans and the bytes that are kept."""
    docs, size = X.versioned(docs)
    bits = X.bits_for(size)
    hot = max(hot, size * 4 // (width - GRAM) // 65_536)
    # an anchor is few bytes: its buckets stand for 32 MB of text, so rows from buckets of anchors to those of documents stay long
    found = X.cut(docs.mapInArrow(hash_anchors(width, max(3, bits - 2)), X.PACKED).groupBy("bucket").applyInArrow(repeated(bits, hot), X.PACKED))
    hottest = [np.frombuffer(r["h"], "<u8") for r in found.filter("kind = 2").select("h").collect()]
    hottest = np.concatenate(hottest) if hottest else np.zeros(0, np.uint64)
    texts = docs.mapInArrow(X.pack_texts(bits), X.PACKED)
    cuts = texts.groupBy("bucket").cogroup(found.filter("kind = 1").groupBy("bucket")).applyInArrow(cut_segments(width, bits + 3, hottest), X.PACKED)
    marks = cuts.groupBy("bucket").applyInArrow(resolve(width, bits), X.PACKED)
    return texts.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(strip(width), OUT)
