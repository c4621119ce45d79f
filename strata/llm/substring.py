"""Substring dedup: Rabin-Karp hashes of every window of `width` tokens, counted in Spark.

1. Map: words of whole texts, 64-bit rolling hashes of all windows. Of windows equal within a batch only the
   earliest goes on; the others are removals already, so a passage in a third of all rows reaches its
   reducer once for each batch.
2. Reduce by hash bucket: windows whose hash occurs more than once; all but the earliest are removals.
3. Removals meet their texts by doc_id; overlapping windows merge into maximal removal intervals.

Defined cases: a null or empty text has no words. Rows without doc_id take no part and lose nothing. Different
texts under one doc_id are different documents, in the order of a hash of the text; rows that repeat both are
one document and keep the same. Order is (doc_id, that hash, start). Equality is that of 64-bit hashes of
64-bit word hashes, of which the bucket and 56 bits travel: 59 bits and more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X, kernels as K

OUT = "doc_id long, n_words long, n_removed long, n_spans long, intervals array<struct<start:long,end:long>>, kept_text string"
INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def earliest(h: np.ndarray, ids: np.ndarray, ver: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, later): indices of the earliest (id, version, pos) of each hash, and of those that come after one of the same hash."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    many = same[:-1] | same[1:]
    single, rest = order[~many], order[many]
    rest = rest[np.lexsort((pos[rest], ver[rest], ids[rest], h[rest]))]
    lead = np.ones(len(rest), bool)
    lead[1:] = h[rest[1:]] != h[rest[:-1]]
    group = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(rest) else rest
    head = rest[group]
    later = (ids[rest] != ids[head]) | (ver[rest] != ver[head]) | (pos[rest] != pos[head])
    return np.concatenate([single, rest[lead]]), rest[later]


def hash_windows(width: int, bits: int, id_bits: int):
    def run(batches):
        for rb in batches:
            ids, none = K.ints(rb.column(0))
            ver, _ = K.ints(rb.column(1))
            buf, off = K.buffers(rb.column(2))
            for i, j in K.pieces(off, X.PIECE):
                part = buf[off[i] : off[j]]
                start, end, first = K.words(part, off[i : j + 1] - off[i])
                at, h = K.window_hashes(K.word_hashes(part, start, end), first, width)
                row = K.window_rows(first, width)
                ok = ~none[i:j][row]
                at, h, row = at[ok], h[ok], row[ok]
                if not len(at):
                    continue
                own, alt, pos = ids[i:j][row], ver[i:j][row], at - first[row]
                keep, later = earliest(h, own, alt, pos)
                rows = []
                for r in X.places(own[later], alt[later], pos[later], id_bits):
                    rows.append((r[0] % (1 << bits), 1, r[2], r[3], X.pack_ints(np.array([r[0]])), None, r[6]))
                keep.sort()
                for b, k in X.by_bucket(X.top_bits(h[keep], bits)):
                    k = keep[k]
                    change = np.flatnonzero(np.diff(row[k], prepend=-1))
                    rows.append((b, 0, X.pack_ints(own[k][change]), X.pack_ints(np.diff(np.append(change, len(k)))), X.pack_ints(at[k] - first[row[k]] + (row[k] << 32)), X.pack_hashes(h[k]), X.pack_ints(alt[k][change])))
                yield X.batch(rows)

    return run


def resolve(id_bits: int):
    def run(packs: pa.Table) -> pa.Table:
        own, alt, pos, h, rows = [], [], [], [], []
        for kind, a, b, c, x, v in zip(*(packs.column(n).to_pylist() for n in ("kind", "a", "b", "c", "h", "v"))):
            if kind:
                rows.append((int(X.unpack_ints(c)[0]), 1, a, b, None, None, v))
            else:
                n = X.unpack_ints(b)
                own.append(np.repeat(X.unpack_ints(a), n))
                alt.append(np.repeat(X.unpack_ints(v), n))
                pos.append(X.unpack_ints(c) & 0xFFFFFFFF)
                h.append(X.unpack_hashes(x))
        if h:
            own, alt, pos, h = np.concatenate(own), np.concatenate(alt), np.concatenate(pos), np.concatenate(h)
            _, later = earliest(h, own, alt, pos)
            rows += X.places(own[later], alt[later], pos[later], id_bits)
        return X.table(rows)

    return run


def strip(width: int):
    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        marked = X.Marks(marks, "b")
        pos = marked.values[0]
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "n_spans", "intervals", "kept_text")}
        for own, ver, none, buf, off in X.unpack_texts(texts):
            start, end, first = K.words(buf, off)
            for i, (doc, (lo, hi)) in enumerate(zip(own.tolist(), marked.of(own, ver, none))):
                s, e = start[first[i] : first[i + 1]], end[first[i] : first[i + 1]]
                gone = K.cover(pos[lo:hi], width, len(s)) if hi > lo else np.zeros(len(s), bool)
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                raw = buf[off[i] : off[i + 1]].tobytes()
                base = int(off[i])
                out["doc_id"].append(None if none[i] else doc)
                out["n_words"].append(len(s))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(len(edge) // 2)
                out["intervals"].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                out["kept_text"].append(b" ".join(raw[a - base : b - base] for a, b in zip(s[~gone].tolist(), e[~gone].tolist())).decode("utf-8", "replace"))
        return pa.table({k: pa.array(v, INTERVALS if k == "intervals" else pa.string() if k == "kept_text" else pa.int64()) for k, v in out.items()})

    return run


def dedup_substrings(docs: DataFrame, width: int = 20) -> DataFrame:
    """For each row of docs(doc_id, text): words, removed words, their maximal intervals (in words) and the text that is kept, its words joined by one space."""
    docs, size = X.versioned(docs)
    bits = id_bits = X.bits_for(size)
    marks = docs.mapInArrow(hash_windows(width, bits, id_bits), X.PACKED).groupBy("bucket").applyInArrow(resolve(id_bits), X.PACKED)
    texts = docs.mapInArrow(X.pack_texts(id_bits), X.PACKED)
    return texts.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(strip(width), OUT)

