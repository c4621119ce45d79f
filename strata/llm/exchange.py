"""Packed exchanges: rows of many small values travel as a few column blobs for each bucket.

A window, an anchor or a token is 8 bytes; as a Spark row it would be 40 and a few microseconds. Map tasks
sort what a batch holds by bucket and emit one row of packed columns for each bucket; a bucket is a group
of `applyInArrow`. The number of buckets follows the counted bytes of the input, so a group stays near 16 MB at
any scale; beyond some 2**16 buckets a packed row holds few values, and the bytes shuffled for each value rise.
Every function is deterministic in its input rows, so a lost task is simply run again.

A document is told by its doc_id and a version: 0, or a hash of the text where rows repeat the doc_id.
"""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that a map task turns into arrays at a time.
PIECE = 2 << 20


#: Bytes of an Arrow batch, at most, on its way to or from a Python worker.
BATCH = 8 << 20


def small_batches(df: DataFrame) -> None:
    """Bounds Arrow batches in df's session by bytes, so rows with long texts or sets don't fill a task's memory. Results are the same with any bound."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts of docs(text), counted."""
    small_batches(docs)
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def bits_for(size: int, bytes_each: int = 8 << 20) -> int:
    """log2 of the number of buckets such that one stands for about `bytes_each` of `size` bytes."""
    return max(3, math.ceil(math.log2(max(1, size / bytes_each))))


def versioned(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs(doc_id, version, text) and the bytes of its texts. version: 0, or a hash of the text where the doc_id repeats, so different
    texts under one doc_id are different documents, and rows that repeat both are one."""
    small_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size")))
    size = seen.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    again = seen.filter("doc_id is not null and n > 1").select("doc_id", F.lit(True).alias("again"))
    if again.isEmpty():
        return docs.select("doc_id", F.lit(0).cast("long").alias("version"), "text"), size
    return docs.join(small_side(again), "doc_id", "left").select("doc_id", F.when(F.col("again"), F.xxhash64("text")).otherwise(0).alias("version"), "text"), size


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, a folder of this machine, if all tasks run on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="strata-")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder that the cluster names in spark.checkpoint.dir, without its lineage."""
    small_batches(df)
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fit(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """cut(df), in as many partitions as its rows fill. Small tables that are shuffled many times then write few files."""
    df = cut(df)
    return counted(df, df.count(), rows)


def counted(df: DataFrame, n: int, rows: int = 200_000) -> DataFrame:
    """df, which was cut and has n rows, in as many partitions as they fill; small_side() need not count them again."""
    out = df.coalesce(max(1, math.ceil(n / rows)))
    out.__dict__["_counted"] = n
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones with clashing names never travel."""
    return df.select(*columns)


def small_side(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a hint to broadcast it if it was counted (it should be cut before) to have at most `rows` rows; else it is left to a shuffle join."""
    n = df.__dict__.get("_counted")
    n = df.limit(rows + 1).count() if n is None else n
    return F.broadcast(df) if n <= rows else df.hint("merge")


def squeeze(raw: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes() if isinstance(raw, np.ndarray) else raw)


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack_ints(x: np.ndarray) -> bytes:
    """Differences of int64 values, byte plane by byte plane, compressed: sorted or alike values take about a byte each."""
    d = np.diff(x.astype(np.int64), prepend=np.int64(0)).astype(np.int64)
    d = (d << 1) ^ (d >> 63)
    return squeeze(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T))


def unpack_ints(raw: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(expand(raw), np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)
    d = (d >> np.uint64(1)).astype(np.int64) ^ -(d & np.uint64(1)).astype(np.int64)
    return np.cumsum(d)


def pack_hashes(h: np.ndarray) -> bytes:
    """The low seven bytes of each; the top bits are the bucket."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unpack_hashes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8")


def by_bucket(bucket: np.ndarray):
    """(bucket, indices in their order) for each bucket that occurs."""
    if len(bucket) == 0:
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
    for i, j in zip(edges[:-1], edges[1:]):
        yield int(b[i]), order[i:j]


def top_bits(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def id_bucket(ids: np.ndarray, bits: int, version: np.ndarray | int = 0) -> np.ndarray:
    """The bucket of a document: consecutive ids are dealt evenly, and so are the texts of one id."""
    from .kernels import mix

    return top_bits(mix((ids.astype(np.int64) ^ version).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), bits)


#: Rows of a packed exchange. kind 0: values to be resolved in their bucket; kind 1: results that only pass through.
PACKED = "bucket int, kind int, a binary, b binary, c binary, h binary, v binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abchv")])


def batch(rows: list[tuple], schema: pa.Schema = PACKED_ARROW) -> pa.RecordBatch:
    """rows as a record batch; what rows leave out at their end is null."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def table(rows: list[tuple], schema: pa.Schema = PACKED_ARROW) -> pa.Table:
    return pa.Table.from_batches([batch(rows, schema)])


def places(ids: np.ndarray, ver: np.ndarray, pos: np.ndarray, bits: int, kind: int = 1) -> list[tuple]:
    """(doc_id, version, position) as packed rows, one for each bucket of documents."""
    out = []
    for b, at in by_bucket(id_bucket(ids, bits, ver)):
        at = at[np.lexsort((pos[at], ver[at], ids[at]))]
        out.append((b, kind, pack_ints(ids[at]), pack_ints(pos[at]), None, None, pack_ints(ver[at])))
    return out


def gathered(batches, limit: int = 16 * PIECE):
    """Record batches joined up to `limit` bytes: what is packed for each bucket then grows with the bytes of a task, not with its batches."""
    held, size = [], 0
    for rb in batches:
        if held and size + rb.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(rb)
        size += rb.nbytes
    if held:
        yield pa.concat_batches(held)


def dealt(bucket: np.ndarray, records: np.ndarray, kind: int = 0, size: np.ndarray | None = None, body=None, limit: int = 16 * PIECE) -> list[pa.RecordBatch]:
    """Records, and the `size` bytes that body(their indices) has for each, as one row (a, c) for each bucket that occurs, in batches of
    about `limit` bytes. Rows are slices of two buffers, so a row of one record costs no more than its bytes."""
    from .kernels import pieces

    order, out = np.argsort(bucket, kind="stable"), []
    size = np.zeros(len(order), np.int64) if size is None else size[order]
    for i, j in pieces(np.concatenate([[0], np.cumsum(size + records.itemsize)]), limit):
        at, b = order[i:j], bucket[order[i:j]]
        edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
        rows, none = len(edge) - 1, pa.nulls(len(edge) - 1, pa.binary())
        slices = lambda to, raw: pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(raw)])
        a = slices(edge * records.itemsize, records[at].tobytes())
        c = none if body is None else slices(np.concatenate([[0], np.cumsum(size[i:j])])[edge], body(at))
        out.append(pa.RecordBatch.from_arrays([pa.array(b[edge[:-1]], pa.int32()), pa.array(np.full(rows, kind, np.int32)), a, none, c, none, none], schema=PACKED_ARROW))
    return out


def records(packs: pa.Table, kind: np.dtype) -> np.ndarray:
    """What dealt() put into column a."""
    from .kernels import buffers

    return buffers(packs.column("a"))[0].view(kind)


def pack_texts(bits: int):
    """mapInArrow function: (doc_id, version, text) into compressed packs by the bucket of the document. Rows without doc_id are dealt by position."""
    from .kernels import buffers, ints, pieces

    def run(batches):
        for rb in gathered(batches):
            ids, none = ints(rb.column(0))
            ver, _ = ints(rb.column(1))
            buf, off = buffers(rb.column(2))
            for i, j in pieces(off, 16 * PIECE):
                rows, size = [], np.diff(off[i : j + 1])
                for b, at in by_bucket(id_bucket(np.where(none[i:j], np.arange(i, j), ids[i:j]), bits, ver[i:j])):
                    body = b"".join(buf[off[i + k] : off[i + k + 1]].tobytes() for k in at)
                    rows.append((b, 0, pack_ints(ids[i:j][at]), pack_ints(size[at]), squeeze(body), none[i:j][at].tobytes(), pack_ints(ver[i:j][at])))
                if rows:
                    yield batch(rows)

    return run


def unpack_texts(packs: pa.Table):
    """(doc_ids, versions, mask of null ids, bytes, offsets) for each packed row."""
    for a, b, c, h, v in zip(*(packs.column(x).to_pylist() for x in "abchv")):
        size = unpack_ints(b)
        yield unpack_ints(a), unpack_ints(v), np.frombuffer(h, bool), np.frombuffer(expand(c), np.uint8), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


class Marks:
    """What is known of each document: values by (doc_id, version), in the order of the position."""

    def __init__(self, packs: pa.Table, *columns: str):
        self.sort(*(np.concatenate([unpack_ints(x) for x in packs.column(c).to_pylist()]) if packs.num_rows else np.zeros(0, np.int64) for c in ("a", "v", *columns)))

    def sort(self, *cols: np.ndarray) -> Marks:
        order = np.lexsort((cols[2], cols[1], cols[0]))
        ids, ver, *self.values = (c[order] for c in cols)
        edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ver[1:] != ver[:-1]), [True]])) if len(ids) else np.zeros(1, np.int64)
        self.where = dict(zip(zip(ids[edge[:-1]].tolist(), ver[edge[:-1]].tolist()), zip(edge[:-1].tolist(), edge[1:].tolist())))
        return self

    @classmethod
    def of_records(cls, found: np.ndarray) -> Marks:
        """Those of dealt() records, whose fields are doc_id, version, position and others."""
        return cls.__new__(cls).sort(*(found[f].astype(np.int64) for f in found.dtype.names))

    def of(self, ids: np.ndarray, ver: np.ndarray, none: np.ndarray) -> list[tuple[int, int]]:
        """The range of values of each document; that of documents without doc_id is empty."""
        return [(0, 0) if x else self.where.get((i, v), (0, 0)) for i, v, x in zip(ids.tolist(), ver.tolist(), none.tolist())]
