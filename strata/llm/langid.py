"""Language identification by Bayesian evidence fusion.

log p(language | page) adds up, to a constant:
- the text's likelihood under hashed byte trigrams of each language (counts of all training texts), tempered
  by `text_power` as trigrams overlap and repeat;
- what the markup declares (`lang` of <html>) and the address suffix (a two-letter path segment or
  top-level domain), each right with a probability that is estimated from agreement with the text;
- a prior of the host, smoothed towards its domain's, smoothed towards that of all pages, from grouped counts
  of the languages that the other evidence gives.

Counts by host aggregate before they shuffle; the join back splits a host with most pages if its side is
shuffled at all.

Every language that a training row names is counted and scored; a language takes 64 KB in each task.

Defined cases: a null or empty page has no text, and a null url no suffix and the host "": the prior decides. Trained on
no text at all, no page has a language (null).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as X, kernels as K

BINS = 1 << 13
HIDDEN = re.compile(r"(?is)<(script|style|noscript|nav|footer|template)\b.*?</\1\s*>|<!--.*?-->")
TAG = re.compile(r"(?s)<[^>]*>")
DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""")
SUFFIX = re.compile(r"://([^/?#]*)(?:/([a-z]{2})(?=[/?#]|$))?", re.I)
ENTITY = re.compile(r"&[a-zA-Z]+;|&#\d+;")


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, row) of the overlapping byte trigrams of each row; only letters tell languages apart, all else is a blank."""
    table = np.where(((K.LOWER >= 97) & (K.LOWER <= 122)) | (np.arange(256) >= 128), K.LOWER, 32).astype(np.uint8)
    t = table[buf].astype(np.uint64)
    if len(t) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (t[:-2] << np.uint64(16)) | (t[1:-1] << np.uint64(8)) | t[2:]
    at = np.arange(len(h))
    row = np.searchsorted(off, at, "right") - 1
    ok = (at + 3 <= off[row + 1]) & (h != np.uint64(0x202020))
    return (K.mix(h[ok]) >> np.uint64(64 - 13)).astype(np.int64), row[ok]


def count_trigrams(languages: tuple[str, ...]):
    def run(batches):
        total: dict[int, np.ndarray] = {}  # of the languages that the partition holds
        where = {x: i for i, x in enumerate(languages)}
        for rb in batches:
            lang = np.array([where[x] for x in rb.column(0).to_pylist()], np.int64)
            buf, off = K.buffers(rb.column(1))
            for i, j in K.pieces(off, X.PIECE):
                b, row = trigrams(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                some, back = np.unique(lang[i:j], return_inverse=True)
                n = np.bincount(back[row] * BINS + b, minlength=len(some) * BINS).reshape(-1, BINS)
                for k, x in zip(some.tolist(), n):
                    total[k] = total[k] + x if k in total else x
        if total:
            n, part = sorted(total), sum(int(x.sum()) for x in total.values()) % 64
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array([part] * len(n), pa.int32()), pa.array([total[k].tobytes() for k in n], pa.binary())], names=["lang", "part", "n"])

    return run


def add_counts(packs: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in packs.column("n").to_pylist())
    return pa.table({"lang": packs.column("lang").slice(0, 1), "part": pa.array([0], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame) -> tuple[tuple[str, ...], np.ndarray]:
    """(languages, log-likelihood of each bin by language) from docs(text, lang)."""
    X.small_batches(docs)
    known = docs.filter("lang is not null")
    languages = tuple(sorted(r["lang"] for r in known.select("lang").distinct().collect()))
    if not languages:
        return (), np.zeros((0, BINS))
    counts = known.select("lang", "text").mapInArrow(count_trigrams(languages), "lang int, part int, n binary")
    for keys in (("lang", "part"), ("lang",)):
        counts = counts.groupBy(*keys).applyInArrow(add_counts, "lang int, part int, n binary")
    table = np.ones((len(languages), BINS)) * 0.5
    for r in counts.collect():  # one row for each language
        table[r["lang"]] += np.frombuffer(r["n"], np.int64)
    return languages, np.log(table / table.sum(1, keepdims=True))


def visible(html: str | None) -> str:
    return ENTITY.sub(" ", TAG.sub(" ", HIDDEN.sub(" ", html))) if html else ""


EVIDENCE = "page_id long, host string, domain string, declared int, suffix int, text array<double>"


def evidence(languages: tuple[str, ...], table: np.ndarray, power: float):
    where = {x: i for i, x in enumerate(languages)}

    def run(batches):
        for rb in batches:
            for i in range(0, rb.num_rows, 512):
                part = rb.slice(i, 512)
                htmls, urls = part.column(2).to_pylist(), part.column(1).to_pylist()
                buf, off = K.buffers(pa.array([visible(x) for x in htmls], pa.large_string()))
                b, row = trigrams(buf, off)
                n = np.maximum(np.bincount(row, minlength=len(htmls)), 1)
                text = np.stack([np.bincount(row, t[b], minlength=len(htmls)) for t in table], 1)
                text = text / n[:, None] * n[:, None] ** power
                host, domain, declared, suffix = [], [], [], []
                for url, html in zip(urls, htmls):
                    m, d = SUFFIX.search(url or ""), DECLARED.search(html or "")
                    h = m[1].lower() if m else ""
                    host.append(h)
                    domain.append(".".join(h.split(".")[-2:]))
                    declared.append(where.get(d[1].lower(), -1) if d else -1)
                    suffix.append(where.get((m[2] or h.rpartition(".")[2]).lower(), -1) if m else -1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(host), pa.array(domain), pa.array(declared, pa.int32()), pa.array(suffix, pa.int32()), pa.array(text.tolist(), pa.list_(pa.float64()))], names=["page_id", "host", "domain", "declared", "suffix", "text"])

    return run


def identify(pages: DataFrame, docs: DataFrame, text_power: float = 0.6, strength: float = 8.0) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, suffix, host, host_prior for each row of pages(page_id, url, html). strength: pages that a prior counts for."""
    languages, table = train(docs)
    if not languages:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("suffix", "string"), ("host", "string"), ("host_prior", "double"))]
        return pages.select("page_id", *none)
    n = len(languages)
    seen = X.cut(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(evidence(languages, table, text_power), EVIDENCE))
    best = lambda c: F.array_position(c, F.array_max(c)).cast("int") - 1
    seen = seen.withColumn("text_best", best(F.col("text")))
    agree = seen.agg(*[F.coalesce(F.sum((F.col(c) == F.col("text_best")).cast("long")), F.lit(0)).alias(c) for c in ("declared", "suffix")], *[F.count(F.when(F.col(c) >= 0, 1)).alias("n_" + c) for c in ("declared", "suffix")]).first()

    def told(c: str, right: int, of: int):
        p = (right + 4) / (of + 5)  # at most what the counts allow
        hit, miss = math.log(p), math.log((1 - p) / max(1, n - 1))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.col(c) < 0, 0.0).when(F.col(c) == i, hit).otherwise(miss))

    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    seen = seen.withColumn("own", plus(plus(F.col("text"), told("declared", agree["declared"], agree["n_declared"])), told("suffix", agree["suffix"], agree["n_suffix"])))
    soft = F.transform("own", lambda x: F.exp(x - F.array_max("own")))
    soft = F.transform(soft, lambda x: x / F.aggregate(soft, F.lit(0.0), lambda a, y: a + y))
    seen = X.cut(seen.withColumn("soft", soft))
    sums = [F.sum(F.element_at("soft", i + 1)).alias(f"c{i}") for i in range(n)]
    hosts = seen.groupBy("host", "domain").agg(*sums)
    domains = hosts.groupBy("domain").agg(*[F.sum(f"c{i}").alias(f"d{i}") for i in range(n)])
    every = domains.agg(*[F.sum(f"d{i}").alias(f"e{i}") for i in range(n)]).first()
    total = sum(every[f"e{i}"] or 0.0 for i in range(n))
    base = [((every[f"e{i}"] or 0.0) + 1) / (total + n) for i in range(n)]
    size_d, size_c = (sum((F.col(f"{k}{i}") for i in range(1, n)), F.col(f"{k}0")) for k in "dc")
    domains = domains.select("domain", *[((F.col(f"d{i}") + strength * base[i]) / (size_d + strength)).alias(f"p{i}") for i in range(n)])
    prior = X.cut(hosts.join(domains, "domain").select("host", F.array(*[(F.col(f"c{i}") + strength * F.col(f"p{i}")) / (size_c + strength) for i in range(n)]).alias("prior")))
    out = seen.join(X.small_side(prior), "host", "left").withColumn("all", F.zip_with("own", "prior", lambda x, p: x + F.log(p)))
    chosen = best(F.col("all"))
    probability = 1 / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("all")))
    name = lambda c: F.when(c >= 0, F.element_at(F.array(*map(F.lit, languages)), F.greatest(c, F.lit(0)) + 1))
    return out.select("page_id", name(chosen).alias("lang"), F.round(probability, 6).alias("probability"), name(F.col("text_best")).alias("text_lang"), name(F.col("declared")).alias("declared"), name(F.col("suffix")).alias("suffix"), "host", F.round(F.element_at("prior", chosen + 1), 6).alias("host_prior"))
