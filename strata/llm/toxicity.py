"""Toxicity by compression distance: one zstandard dictionary trained on toxic text, one on ordinary text.

A window is a word between blanks, written as its overlapping runs of four bytes, which lengthens a match fourfold
so that short words and parts of words show too. It is compressed with either dictionary; what the toxic one
saves over the ordinary one is the window's distance, and a text has the greatest distance of all its windows.
Distances become probabilities by isotonic regression on labelled rows that trained no dictionary.

The dictionaries are first trained on all different windows of each toxic and of each ordinary text. Most windows
of a toxic text are ordinary, so in further rounds the toxic dictionary is trained on those `TOP` windows of each
toxic text that are furthest from the ordinary dictionary, and the ordinary one also on those windows of ordinary
texts that came closest to the toxic one. The round with the least loss on the calibration rows is kept. Of near
copies among the fitted rows one counts, else the words of one copied text would pass for those of a class.

Fitting uses at most `sample` labelled rows of each class, those with the least hash of doc_id among rows that have
a document, with their whole texts, in one executor task; only the model reaches the driver. Scoring reads every
whole text.

Defined cases: texts without words (or null) get the probability of texts without distance. A doc_id with several
labels counts as toxic if any says so; of several texts under one doc_id the one with the least hash is fitted.
Without labelled rows of either class all scores are 0.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import exchange as X, kernels as K
from .neardup import shingles, signatures

SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LEVEL, DICTIONARY = 3, 65_536
#: Segment and chain lengths, in bytes, with which zstandard picks a dictionary's content.
SEGMENT, CHAIN = 40, 8
#: Rounds of training, and windows that each text gives to the later ones.
ROUNDS, TOP = 3, 3
#: MinHash values by which near copies among the fitted rows are told.
SLOTS, BAND = 36, 3


def window(word: bytes) -> bytes:
    """The word as its overlapping runs of four bytes: a match of n bytes becomes one of about 4 n."""
    w = b"   " + word + b"   "
    return b"".join(w[k : k + 4] for k in range(len(w) - 3))


@dataclass(frozen=True)
class Model:
    toxic: bytes
    toxic_raw: bool
    ordinary: bytes
    ordinary_raw: bool
    distances: tuple[float, ...]
    scores: tuple[float, ...]

    def compressors(self):
        for body, raw in ((self.ordinary, self.ordinary_raw), (self.toxic, self.toxic_raw)):
            kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT
            settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            yield zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind), compression_params=settings)

    def score(self, distance: np.ndarray) -> np.ndarray:
        return np.interp(distance, self.distances, self.scores)


class Measure:
    """Distances of words, each word compressed once; the memory holds `most` words at most."""

    def __init__(self, model: Model, most: int = 100_000):
        self.ordinary, self.toxic = (c.compress for c in model.compressors())
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, word: bytes) -> int:
        got = self.known.get(word)
        if got is None:
            w = window(word)
            got = len(self.ordinary(w)) - len(self.toxic(w))
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[word] = got
        return got


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of x with the best non-decreasing fit of y, by pooling neighbours. Each pool is smoothed towards the mean of all."""
    values = np.unique(x)
    mean = np.average(y, weights=w)
    pools = []
    for v in values:
        k = x == v
        pools.append([w[k].sum(), (w[k] * y[k]).sum(), [v]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([a[0] + b[0], a[1] + b[1], a[2] + b[2]])
    return values, np.concatenate([np.full(len(p[2]), (p[1] + mean) / (p[0] + 1)) for p in pools])


def dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """(body, whether it is raw content): with too few samples to train on, their own bytes are the dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=SEGMENT, d=CHAIN).as_bytes(), False
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples)) or b" " * 8, True


def furthest(texts: list[list[bytes]], distances: list[np.ndarray], most: int) -> list[bytes]:
    """The `most` windows of each text with the greatest distance."""
    return [window(words[k]) for words, d in zip(texts, distances) for k in np.argsort(-d, kind="stable")[:most].tolist()]


def models(toxic: list[list[bytes]], ordinary: list[list[bytes]]):
    """The model of each round, not calibrated. Texts are lists of their different words."""
    every = [window(w) for words in ordinary for w in words]
    of = lambda t, o: Model(*dictionary(t), *dictionary(o), (0.0,), (0.0,))
    model = of([window(w) for words in toxic for w in words], every)
    for _ in range(ROUNDS - 1):
        yield model
        measure = Measure(model)
        far = [[np.array([measure(w) for w in words], float) for words in texts] for texts in (toxic, ordinary)]
        model = of(furthest(toxic, far[0], TOP), every + TOP * furthest(ordinary, far[1], 3 * TOP))
    yield model


def fit(rows: list[tuple[int, int, list[bytes], bytes]], totals: tuple[int, int]) -> Model | None:
    """rows: (doc_id, label, different words, signature); totals: labelled rows of each class in the corpus."""
    seen, half = set(), [[], []]
    for doc, label, words, sig in sorted(rows):
        bands = {(b, sig[b : b + BAND]) for b in range(0, len(sig), BAND)}
        if not bands & seen:
            half[zlib.crc32(f"fit {doc}".encode()) % 2].append((words, label))
        seen |= bands
    if not all(any(label == k for _, label in part) for k in (0, 1) for part in half):
        return None
    y = np.array([label for _, label in half[1]], float)
    w = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    w *= len(y) / w.sum()
    best = None
    for model in models(*([words for words, label in half[0] if label == k] for k in (1, 0))):
        measure = Measure(model)
        x = np.array([max((measure(v) for v in words), default=0) for words, _ in half[1]], float)
        x = np.maximum(x, 0)
        values, p = isotonic(x, y, w)
        fitted = np.clip(np.interp(x, values, p), 1e-6, 1 - 1e-6)
        loss = -np.average(y * np.log(fitted) + (1 - y) * np.log(1 - fitted), weights=w)
        if best is None or loss < best[0]:
            best = (loss, replace(model, distances=tuple(values.tolist()), scores=tuple(np.clip(p, 0, 1).tolist())))
    return best[1]


DIGEST = "doc_id long, toxic int, words binary, sig binary"


def digest(batches):
    """mapInArrow function: (doc_id, toxic, text) to the different words of each text, joined by blanks, and its signature."""
    for rb in batches:
        buf, off = K.buffers(rb.column(2))
        for i, j in K.pieces(off, X.PIECE):
            raw, base = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            s, some = shingles(raw, base, 5)
            sigs = [b""] * (j - i)
            for r, sig in zip(np.flatnonzero(np.diff(some)).tolist(), signatures(s, some, SLOTS)):
                sigs[r] = sig.tobytes()
            part = K.LOWER[raw]
            start, end, first = K.words(part, base, SEPARATORS)
            body = part.tobytes()
            words = [b" ".join(dict.fromkeys(body[a:b] for a, b in zip(start[f:g].tolist(), end[f:g].tolist()))) for f, g in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([rb.column(0).slice(i, j - i), rb.column(1).slice(i, j - i), pa.array(words, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "toxic", "words", "sig"])


MODEL = "toxic binary, toxic_raw boolean, ordinary binary, ordinary_raw boolean, distances array<double>, scores array<double>"


def fit_task(totals: tuple[int, int]):
    def run(rows: pa.Table) -> pa.Table:
        ids, labels, words, sigs = (rows.column(c).to_pylist() for c in ("doc_id", "toxic", "words", "sig"))
        m = fit([(i, y, w.split(), s) for i, y, w, s in zip(ids, labels, words, sigs)], totals)
        out = [] if m is None else [m]
        return pa.table({"toxic": pa.array([m.toxic for m in out], pa.binary()), "toxic_raw": pa.array([m.toxic_raw for m in out], pa.bool_()), "ordinary": pa.array([m.ordinary for m in out], pa.binary()), "ordinary_raw": pa.array([m.ordinary_raw for m in out], pa.bool_()), "distances": pa.array([list(m.distances) for m in out], pa.list_(pa.float64())), "scores": pa.array([list(m.scores) for m in out], pa.list_(pa.float64()))})

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> Model | None:
    X.small_batches(docs)
    labels = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = X.cut(labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    totals = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}  # two rows
    if len(totals) < 2:
        return None
    chosen = None
    for k in (0, 1):
        one = labels.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = one if chosen is None else chosen.union(one)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * sample rows at most
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(digest, DIGEST)
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("words", "sig"), F.xxhash64("words")).alias("m")).select("doc_id", "toxic", "m.*")
    got = rows.groupBy().applyInArrow(fit_task((totals[0], totals[1])), MODEL).collect()  # the model: one row
    return Model(bytes(got[0]["toxic"]), got[0]["toxic_raw"], bytes(got[0]["ordinary"]), got[0]["ordinary_raw"], tuple(got[0]["distances"]), tuple(got[0]["scores"])) if got else None


def apply(model: Model):
    """mapInArrow function: (doc_id, text, ...) to (doc_id, score, distance, ...)."""

    def run(batches):
        measure = Measure(model)
        for rb in batches:
            buf, off = K.buffers(rb.column(1))
            worst = np.zeros(rb.num_rows)
            for i, j in K.pieces(off, X.PIECE):
                part = K.LOWER[buf[off[i] : off[j]]]
                start, end, first = K.words(part, off[i : j + 1] - off[i], SEPARATORS)
                h = K.word_hashes(part, start, end)
                _, one, back = np.unique(h, return_index=True, return_inverse=True)
                raw = part.tobytes()
                d = np.array([measure(raw[a:b]) for a, b in zip(start[one].tolist(), end[one].tolist())] or [0], float)
                some = np.flatnonzero(np.diff(first))
                if len(some):
                    worst[i + some] = np.maximum(np.maximum.reduceat(d[back], first[some]), 0)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(model.score(worst)), pa.array(worst), *rb.columns[2:]], names=["doc_id", "score", "distance", *rb.schema.names[2:]])

    return run


def score(docs: DataFrame, model: Model | None, by_text: bool = False) -> DataFrame:
    """doc_id, score, distance for each row of docs(doc_id, text); with by_text also th, the text's hash."""
    X.small_batches(docs)
    extra = [F.xxhash64("text").alias("th")] if by_text else []
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("distance"), *extra)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra).mapInArrow(apply(model), "doc_id long, score double, distance double" + ", th long" * by_text)
