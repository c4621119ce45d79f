"""Language-model scoring: a log-bilinear model over word symbols, trained with noise-contrastive estimation.

Symbols are the `symbols` most frequent words, 16 classes of other words by their length, an end and a begin.
The model predicts a symbol from the two before it: score(w | a, b) = (R[a] C1 + R[b] C2) . Q[w] + bias[w].
As the score is a sum of a table of (a, w) and one of (b, w), the normaliser of all contexts is one product
of matrices, exp(AQ + bias) exp(BQ)^T, and every token gets a normalised log-probability. A word of a class is
then drawn from the class's own counts, discounted; what the discount leaves is shared by as many unseen words
as the class has known ones, and one more, so that an unseen word costs more than any known one of its class.

Counts cover every training token. They are summed in packed form by token hash; the at most `head` most
frequent words (a bound by parameter) are then shipped to all tasks, and only the rest of a document's words
travel to the bucket that holds their counts. Each training partition runs one pass of noise-contrastive
stochastic gradient over all its tokens, from the same start; the parameters and AdaGrad's sums are averaged by
tokens, in two levels of groups, and the next of `rounds` passes starts from there.

Words are told apart by 64-bit hashes. Rows are told apart by their place in the input, so null and repeated
doc_ids are rows like any other; a null doc_id trains. Null text is empty and has one token, the end. Without
training rows N and V are 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import exchange as X, kernels as K

CLASSES = 16
DISCOUNT = 0.75
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"
SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class by length, first) of the lower-cased words of each row."""
    part = K.LOWER[buf]
    start, end, first = K.words(part, off)
    return K.word_hashes(part, start, end), np.minimum(end - start, CLASSES).astype(np.int64) - 1, first


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash in order, count, class) summed over parts."""
    h, n, c = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h, kind="stable")
    h, n, c = h[order], n[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(n, at) if len(at) else n, c[at]


def count_tokens(bits: int, most: int = 1_500_000):
    """Counts of a partition's words as packed rows by hash; sums are emitted whenever more than `most` words are held."""

    def rows(held):
        h, n, c = held
        return [(b, 0, X.pack_ints(n[k]), X.pack_ints(c[k]), None, h[k].astype("<u8").tobytes()) for b, k in X.by_bucket(X.top_bits(h, bits))]

    def run(batches):
        held = None
        for rb in batches:
            buf, off = K.buffers(rb.column(0))
            for i, j in K.pieces(off, X.PIECE):
                h, c, _ = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                one = merge_counts([(h, np.ones(len(h), np.int64), c)])
                held = merge_counts([held, one]) if held is not None else one
                if len(held[0]) > most:
                    yield X.batch(rows(held))
                    held = None
        if held is not None and len(held[0]):
            yield X.batch(rows(held))

    return run


def sum_counts(packs: pa.Table) -> pa.Table:
    a, b, h = (packs.column(n).to_pylist() for n in "abh")
    h, n, c = merge_counts([(np.frombuffer(z, "<u8"), X.unpack_ints(x), X.unpack_ints(y)) for x, y, z in zip(a, b, h)])
    return X.table([(packs.column("bucket")[0].as_py(), 0, X.pack_ints(n), X.pack_ints(c), None, h.astype("<u8").tobytes())])


def histogram(batches):
    """(class, eighth of a power of two of the count, words, tokens) of each packed row."""
    for rb in batches:
        for a, b in zip(rb.column("a").to_pylist(), rb.column("b").to_pylist()):
            n, c = X.unpack_ints(a), X.unpack_ints(b)
            key = c * 1024 + np.floor(8 * np.log2(n)).astype(np.int64)
            k, back = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(k // 1024), pa.array(k % 1024), pa.array(np.bincount(back)), pa.array(np.bincount(back, n).astype(np.int64))], names=["cls", "bin", "words", "tokens"])


def frequent(least: int):
    """The words with at least `least` occurrences."""

    def run(batches):
        for rb in batches:
            for a, b, h in zip(*(rb.column(n).to_pylist() for n in "abh")):
                n, c, h = X.unpack_ints(a), X.unpack_ints(b), np.frombuffer(h, "<i8")
                k = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(h[k]), pa.array(n[k]), pa.array(c[k])], names=["h", "n", "c"])

    return run


@dataclass
class Vocabulary:
    total: int  # training tokens, ends included
    distinct: int
    rows: int  # training rows, so many ends
    head: np.ndarray  # hashes in order
    counts: np.ndarray
    symbol: np.ndarray  # of each head word, or -1: its class
    n_symbols: int  # of words; then come classes, end, begin
    mass: np.ndarray  # tokens of each class outside the symbols
    kinds: np.ndarray  # words of it

    @property
    def size(self) -> int:
        return self.n_symbols + CLASSES + 2

    @property
    def end(self) -> int:
        return self.n_symbols + CLASSES

    def unigram(self) -> np.ndarray:
        """Counts of symbols, none zero; the begin is never predicted."""
        out = np.zeros(self.size)
        k = self.symbol >= 0
        out[self.symbol[k]] = self.counts[k]
        out[self.n_symbols : self.end] = self.mass
        out[self.end] = self.rows
        return out[:-1] + 0.5

    def rare(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of the share of a word with count c in its class, 0 for an unseen word."""
        mass, kinds = self.mass[cls].astype(float), self.kinds[cls].astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(c > 0, c - DISCOUNT, DISCOUNT * kinds / (kinds + 1)) / mass
        return np.log10(np.where(mass > 0, share, 1 / (kinds + 1)))

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in head, whether it is there)."""
        if not len(self.head):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return at, self.head[at] == h

    def symbols_of(self, h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, there = self.look(h)
        sym = self.n_symbols + cls
        own = self.symbol[at] if len(self.head) else np.full(len(h), -1)
        known = there & (own >= 0)
        sym[known] = own[known]
        return sym, at, there


def vocabulary(counts: DataFrame, rows: int, head: int, symbols: int) -> Vocabulary:
    """From packed counts. Collects the histogram of counts by class (a few hundred rows) and at most `head` words."""
    hist = counts.mapInArrow(histogram, "cls long, bin long, words long, tokens long").groupBy("cls", "bin").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()
    total, distinct = sum(r["tokens"] for r in hist), sum(r["words"] for r in hist)
    room, least = head, 1 << 62
    for b in sorted({r["bin"] for r in hist}, reverse=True):
        room -= sum(r["words"] for r in hist if r["bin"] == b)
        if room < 0:
            break
        least = math.ceil(2 ** (b / 8) - 1e-9)
    got = counts.mapInArrow(frequent(least), "h long, n long, c long").toPandas()
    h, n, c = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64), got["c"].to_numpy(np.int64)
    order = np.argsort(h)
    h, n, c = h[order], n[order], c[order]
    top = np.lexsort((h, -n))[:symbols]
    symbol = np.full(len(h), -1, np.int64)
    symbol[top] = np.arange(len(top))
    mass, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in hist:
        mass[r["cls"]] += r["tokens"]
        kinds[r["cls"]] += r["words"]
    np.subtract.at(mass, c[top], n[top])
    np.subtract.at(kinds, c[top], 1)
    return Vocabulary(total + rows, distinct + (rows > 0), rows, h, n, symbol, len(top), mass, kinds)


@dataclass
class Model:
    r: np.ndarray  # vectors of context symbols
    c1: np.ndarray
    c2: np.ndarray
    q: np.ndarray  # vectors of predicted symbols
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.c1, self.c2, self.q, self.bias)]).astype(np.float32)

    @classmethod
    def of(cls, flat: np.ndarray, size: int, width: int) -> Model:
        shapes = [(size, width), (width, width), (width, width), (size - 1, width), (size - 1,)]
        cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
        return cls(*(x.reshape(s) for x, s in zip(np.split(flat.astype(np.float32), cuts), shapes)))

    @classmethod
    def start(cls, vocab: Vocabulary, width: int) -> Model:
        rng = np.random.RandomState(3)
        u = vocab.unigram()
        return cls(rng.normal(0, 0.1, (vocab.size, width)).astype(np.float32), np.eye(width, dtype=np.float32), 0.5 * np.eye(width, dtype=np.float32), rng.normal(0, 0.1, (vocab.size - 1, width)).astype(np.float32), np.log(u / u.sum()).astype(np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(AQ + bias, BQ, log Z), natural logarithms, for all contexts (a, b): batched products of matrices."""
        aq = (self.r @ self.c1) @ self.q.T + self.bias
        bq = (self.r @ self.c2) @ self.q.T
        ma, mb = aq.max(1), bq.max(1)
        z = np.exp(aq - ma[:, None]) @ np.exp(bq - mb[:, None]).T
        return aq, bq, np.log(z) + ma[:, None] + mb[None, :]


def contexts(sym: np.ndarray, first: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(last symbol, the one before, symbol, row) for each word and the end of each row."""
    n = np.diff(first)
    begin = vocab.size - 1
    size = n + 3  # two begins, the words, an end
    edge = np.concatenate([[0], np.cumsum(size)])
    line = np.full(edge[-1], begin, np.int64)
    line[np.repeat(edge[:-1] + 2, n) + K.ranges(n)] = sym
    line[edge[1:] - 1] = vocab.end
    at = np.repeat(edge[:-1] + 2, n + 1) + K.ranges(n + 1)
    return line[at - 1], line[at - 2], line[at], np.repeat(np.arange(len(n)), n + 1)


def scatter(to: np.ndarray, at: np.ndarray, add: np.ndarray) -> None:
    for d in range(to.shape[1]):
        to[:, d] += np.bincount(at, add[:, d], minlength=len(to))


class Trainer:
    """Noise-contrastive estimation with AdaGrad; the noise words of a minibatch are shared by its tokens. sums: AdaGrad's, of earlier rounds."""

    def __init__(self, model: Model, vocab: Vocabulary, noise: int = 128, rate: float = 0.05, seed: int = 0, sums: Model | None = None):
        self.m, self.noise, self.rate = model, noise, rate
        p = vocab.unigram()
        self.log_noise = np.log(noise * p / p.sum()).astype(np.float32)
        self.cdf = np.cumsum(p / p.sum())
        self.rng = np.random.RandomState(seed)
        self.of = sums if sums is not None else Model(*(np.ones(x.shape, np.float32) for x in (model.r, model.c1, model.c2, model.q, model.bias)))
        self.sums = [self.of.r, self.of.c1, self.of.c2, self.of.q, self.of.bias]

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random_sample(self.noise)), len(self.cdf) - 1)
        ra, rb = m.r[a], m.r[b]
        hat = ra @ m.c1 + rb @ m.c2
        qw, qn = m.q[w], m.q[noise]
        good = 1 / (1 + np.exp(np.einsum("ij,ij->i", hat, qw) + m.bias[w] - self.log_noise[w]))
        bad = -1 / (1 + np.exp(-(hat @ qn.T + (m.bias[noise] - self.log_noise[noise]))))
        d_hat = good[:, None] * qw + bad @ qn
        grads = [np.zeros_like(x) for x in (m.r, m.c1, m.c2, m.q, m.bias)]
        scatter(grads[0], a, d_hat @ m.c1.T)
        scatter(grads[0], b, d_hat @ m.c2.T)
        grads[1], grads[2] = ra.T @ d_hat, rb.T @ d_hat
        scatter(grads[3], w, good[:, None] * hat)
        np.add.at(grads[3], noise, bad.T @ hat)
        grads[4] += np.bincount(w, good, minlength=len(m.bias))
        np.add.at(grads[4], noise, bad.sum(0))
        for x, g, s in zip((m.r, m.c1, m.c2, m.q, m.bias), grads, self.sums):
            g = g.astype(np.float32)
            s += g * g
            x += self.rate * g / np.sqrt(s)


def train_part(vocab: Vocabulary, flat: np.ndarray, width: int, size: int, batch: int = 2048):
    """One pass over a partition's tokens; emits its parameters and AdaGrad's sums in blocks, with its tokens as their weight."""

    def run(batches):
        (model, sums), seen = (Model.of(x.copy(), size, width) for x in np.split(flat, 2)), 0
        part = TaskContext.get().partitionId()
        trainer = Trainer(model, vocab, seed=part, sums=sums)
        for rb in batches:
            buf, off = K.buffers(rb.column(0))
            for i, j in K.pieces(off, X.PIECE):
                h, cls, first = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                sym, _, _ = vocab.symbols_of(h, cls)
                a, b, w, _ = contexts(sym, first, vocab)
                for k in range(0, len(w), batch):
                    trainer.step(a[k : k + batch], b[k : k + batch], w[k : k + batch])
                seen += len(w)
        if seen:
            yield sums_batch(part % 64, np.concatenate([model.flat(), trainer.of.flat()]) * np.float64(seen), seen)

    return run


BLOCK = 8192
SUMS = "part int, block int, weight double, vec binary"


def sums_batch(part: int, vec: np.ndarray, weight: float) -> pa.RecordBatch:
    blocks = [vec[k : k + BLOCK].astype(np.float64).tobytes() for k in range(0, len(vec), BLOCK)]
    n = len(blocks)
    return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([float(weight)] * n), pa.array(blocks, pa.binary())], names=["part", "block", "weight", "vec"])


def add_up(packs: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, np.float64) for v in packs.column("vec").to_pylist())
    return pa.table({"part": pa.array([0], pa.int32()), "block": packs.column("block").slice(0, 1).cast(pa.int32()), "weight": pa.array([float(sum(packs.column("weight").to_pylist()))]), "vec": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, vocab: Vocabulary, width: int, rounds: int) -> Model:
    """docs(text): training rows only."""
    model = Model.start(vocab, width)
    state = np.concatenate([model.flat(), np.ones(model.flat().shape, np.float32)])
    for _ in range(rounds if vocab.rows else 0):
        sums = docs.mapInArrow(train_part(vocab, state, width, vocab.size), SUMS)
        for keys in (("part", "block"), ("block",)):
            sums = sums.groupBy(*keys).applyInArrow(add_up, SUMS)
        got = sorted(sums.select("block", "weight", "vec").collect())  # one row for each block of parameters
        state = np.concatenate([np.frombuffer(r["vec"], np.float64) / r["weight"] for r in got]).astype(np.float32)
    return Model.of(np.split(state, 2)[0], vocab.size, width)


def score_rows(vocab: Vocabulary, flat: np.ndarray, width: int, bits: int):
    """kind 1: each row's sums over what the task knows itself; kind 0: words outside the head, by their hash, with the keys of their rows."""

    def run(batches):
        aq, bq, z = Model.of(flat, vocab.size, width).tables()
        part, at_row = TaskContext.get().partitionId(), 0
        for rb in batches:
            ids, none = K.ints(rb.column(0))
            buf, off = K.buffers(rb.column(1))
            for i, j in K.pieces(off, X.PIECE):
                h, cls, first = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                n, rows = np.diff(first), np.arange(j - i)
                keys = (part << 36) + at_row + rows
                at_row += j - i
                sym, at, there = vocab.symbols_of(h, cls)
                a, b, w, row = contexts(sym, first, vocab)
                model = np.bincount(row, (aq[a, w] + bq[b, w] - z[a, b]) / math.log(10), minlength=j - i)
                row = np.repeat(rows, n)
                c = vocab.counts[at[there]] if len(vocab.head) else np.zeros(0, np.int64)
                base = np.bincount(row[there], np.log10(c + 1), minlength=j - i) + math.log10(vocab.rows + 1)
                own = there & (sym >= vocab.n_symbols)  # in the head, but not a symbol
                if own.any():
                    model += np.bincount(row[own], vocab.rare(vocab.counts[at[own]], cls[own]), minlength=j - i)
                known = np.bincount(row[there], minlength=j - i) + (vocab.rows > 0)
                base -= (n + 1) * math.log10(vocab.total + vocab.distinct + 1)
                out = [(b, 1, X.pack_ints(keys[k]), X.pack_ints(np.concatenate([ids[i:j][k], none[i:j][k], n[k] + 1])), X.pack_ints(known[k]), np.concatenate([base[k], model[k]]).tobytes()) for b, k in X.by_bucket(X.id_bucket(keys, bits))]
                out = [(r[0] % (1 << bits), *r[1:]) for r in out]
                h, cls, row = h[~there], cls[~there], row[~there]
                for b, k in X.by_bucket(X.top_bits(h, bits)):
                    out.append((b, 0, X.pack_ints(keys[row[k]]), X.pack_ints(cls[k]), None, X.pack_hashes(h[k])))
                yield X.batch(out)

    return run


def resolve(vocab: Vocabulary, bits: int):
    """Words outside the head meet their counts; sums by row go on to the bucket of the row, with what only passes through."""

    def run(packs: pa.Table, counts: pa.Table) -> pa.Table:
        rows, key, cls, h = [], [], [], []
        for b, kind, a, x, c, v in zip(*(packs.column(n).to_pylist() for n in ("bucket", "kind", "a", "b", "c", "h"))):
            if kind:
                rows.append((b, 1, a, x, c, v))
            else:
                key.append(X.unpack_ints(a))
                cls.append(X.unpack_ints(x))
                h.append(X.unpack_hashes(v))
        if key:
            key, cls, h = np.concatenate(key), np.concatenate(cls), np.concatenate(h)
            c = np.zeros(len(h), np.int64)
            if counts.num_rows:
                there = np.frombuffer(counts.column("h")[0].as_py(), "<u8") & np.uint64((1 << 56) - 1)
                n = X.unpack_ints(counts.column("a")[0].as_py())
                order = np.argsort(there, kind="stable")
                at = np.minimum(np.searchsorted(there[order], h), len(order) - 1)
                hit = there[order][at] == h
                c[hit] = n[order][at[hit]]
            own, back = np.unique(key, return_inverse=True)
            sums = [np.bincount(back, x, minlength=len(own)) for x in (np.log10(c + 1), vocab.rare(c, cls), c > 0)]
            for b, k in X.by_bucket(X.id_bucket(own, bits)):
                rows.append((b, 0, X.pack_ints(own[k]), X.pack_ints(sums[2][k].astype(np.int64)), None, np.concatenate([sums[0][k], sums[1][k]]).tobytes()))
        return X.table(rows)

    return run


def gather(packs: pa.Table) -> pa.Table:
    """Sums of all parts of each row."""
    key, known, base, model, meta = [], [], [], [], []
    for kind, a, b, c, h in zip(*(packs.column(n).to_pylist() for n in ("kind", "a", "b", "c", "h"))):
        own, h = X.unpack_ints(a), np.frombuffer(h, np.float64)
        key.append(own)
        base.append(h[: len(own)])
        model.append(h[len(own) :])
        known.append(X.unpack_ints(c if kind else b))
        if kind:
            meta.append((own, X.unpack_ints(b).reshape(3, -1)))
    own = np.concatenate([m[0] for m in meta])
    ids, none, n = np.concatenate([m[1] for m in meta], axis=1)
    order = np.argsort(own)
    own = own[order]
    at = np.searchsorted(own, np.concatenate(key))
    sums = [np.bincount(at, np.concatenate(x), minlength=len(own)) for x in (known, base, model)]
    return pa.table({"doc_id": pa.array(ids[order], pa.int64(), mask=none[order].astype(bool)), "n_tokens": n[order], "n_known": sums[0].astype(np.int64), "base_score": sums[1], "score": sums[2]}, schema=SCORED_ARROW)


def score(docs: DataFrame, training: Column, head: int = 65_536, symbols: int = 1000, width: int = 16, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text). training: a boolean of doc_id."""
    X.small_batches(docs)
    learn = docs.filter(training).select("text")
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.coalesce(F.sum(training.cast("long")), F.lit(0))).first()
    bits = X.bits_for(size)
    counts = X.cut(learn.mapInArrow(count_tokens(bits), X.PACKED).groupBy("bucket").applyInArrow(sum_counts, X.PACKED))
    vocab = vocabulary(counts, rows, head, symbols)
    flat = train(learn, vocab, width, rounds).flat()
    packs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score_rows(vocab, flat, width, bits), X.PACKED)
    met = packs.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(resolve(vocab, bits), X.PACKED)
    out = met.groupBy("bucket").applyInArrow(gather, SCORED)
    return out.select("doc_id", (~training).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
