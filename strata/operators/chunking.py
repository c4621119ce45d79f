"""Chunks of Markdown by headings, of plain text by paragraphs and lines, of sentences by meaning.

Offsets are exact positions, in characters, in the text with \\r\\n as \\n.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import CJK
from ..schemas import CHUNK

HEADING = r"^(#{1,6}) (.*)$"
_CJK = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), CJK) + "]")
_RUN = re.compile(r"[^ \t\n\r]+")


def options(size: int, overlap: int) -> tuple[int, int]:
    """Usable values: size 512 unless positive, overlap within 0 and size."""
    size = size if size > 0 else 512
    overlap = max(overlap, 0)
    return size, overlap if overlap < size else size // 4


def estimate(text: str) -> int:
    n = len(_CJK.findall(text))
    return max(1, n + sum(len(_RUN.findall(x)) for x in _CJK.split(text)))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0), level, title, end_line: a section ends before the next heading of its level or above (null: at the end of the text)."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), "\n")).alias("line", "s"))
    h = lines.filter(F.col("s").rlike(HEADING)).select("doc_id", "line", F.length(F.regexp_extract("s", HEADING, 1)).alias("level"), F.trim(F.regexp_extract("s", HEADING, 2)).alias("title"))
    after = F.array_sort(F.collect_list(F.struct("line", "level")).over(W.partitionBy("doc_id")))
    nxt = F.filter(after, lambda x: (x["line"] > F.col("line")) & (x["level"] <= F.col("level")))
    return h.select("doc_id", "line", "level", "title", F.try_element_at(nxt, F.lit(1))["line"].alias("end_line"))


def pack(spans: list[tuple[int, int]], size: int, cost: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Neighbouring spans joined as long as their costs fit."""
    out, used = [], 0
    for a, b in spans:
        n = cost(a, b)
        if out and used + n <= size:
            out[-1], used = (out[-1][0], b), used + n
        else:
            out.append((a, b))
            used = n
    return out


def hard_cut(text: str, a: int, b: int, size: int) -> list[tuple[int, int]]:
    """Cuts after about `size` tokens, at the next stop within as many characters if there is one."""
    size, out = max(size, 10), []
    while a < b:
        e, n, word = a, 0, False
        while e < b and n < size:
            c = text[e]
            if _CJK.match(c):
                n, word = n + 1, False
            elif c in " \t\n\r":
                word = False
            elif not word:
                n, word = n + 1, True
            e += 1
        stop = re.compile("[。.\n！？]").search(text, e, min(b, e + size))
        e = stop.end() if stop and e < b else e
        out.append((a, e))
        a = e
    return out


def split_text(text: str, a: int, b: int, size: int) -> list[tuple[int, int]]:
    """One span if it fits; else packed paragraphs; those that do not fit, packed lines; those that do not, hard cuts."""
    cost = lambda i, j: estimate(text[i:j])
    if not text[a:b].strip():
        return []
    if cost(a, b) <= size:
        return [(a, b)]
    for gap in ("\n\n", "\n"):
        parts, at = [], a
        for piece in text[a:b].split(gap):
            if piece.strip():
                parts.append((at, at + len(piece)))
            at += len(piece) + len(gap)
        if len(parts) > 1:
            out = []
            for i, j in pack(parts, size, cost):
                out += [(i, j)] if cost(i, j) <= size else split_text(text, i, j, size)
            return out
    return hard_cut(text, a, b, size)


def sections(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, level, heading line), in order."""
    found = [(m.start(), len(m[1]), m[0].rstrip()) for m in re.finditer(r"(?m)^(#{1,6}) .*$", text)]
    return [(s, next((t for t, k, _ in found[i + 1 :] if k <= level), len(text)), level, line) for i, (s, level, line) in enumerate(found)]


def split_markdown(text: str, size: int) -> list[tuple[int, int, str]]:
    """(start, end, heading path) of chunks: a text or section that fits is one chunk under its full path, else its children of the next level are split
    in turn and the text around them is split as text. The text's children are the sections of the least level that occurs."""
    every = sections(text)

    def walk(a: int, b: int, level: int, path: list[str], body: int) -> list[tuple[int, int, str]]:
        head = "\n".join(path)
        if (b - a) / 2 <= size:
            return [(body, b, head)] if text[body:b].strip() else []
        kids = [s for s in every if body <= s[0] < b and s[2] == level + 1]
        if not kids:
            return [(i, j, head) for i, j in split_text(text, body, b, size)]
        out = [(i, j, head) for i, j in split_text(text, body, kids[0][0], size)]
        for s, e, k, line in kids:
            out += walk(s, min(e, b), k, [*path, line], min(e, s + len(line) + 1, b))
        out += [(i, j, head) for i, j in split_text(text, min(kids[-1][1], b), b, size)]
        return out

    return walk(0, len(text), min(s[2] for s in every) - 1, [], 0) if every else [(i, j, "") for i, j in split_text(text, 0, len(text), size)]


def finish(text: str, parts: list[tuple[int, int, str]], overlap: int) -> list[dict]:
    """Chunks with the end of the one before, as it then is, in front."""
    out, before = [], ""
    for i, (a, b, head) in enumerate(parts):
        body = text[a:b].strip()
        if overlap and before:
            tail = before[-2 * overlap :]
            body, start = f"{tail} {body}", max(0, a - len(tail))
        else:
            start = a
        content = f"{head}\n\n{body}" if head else body
        out.append({"index": i, "content": content, "token_est": estimate(content), "start_pos": start, "end_pos": b})
        before = body
    return out


def chunk_recursive(text: Column, size: int = 512, overlap: int = 0) -> Column:
    """Chunks of each text; none of a blank one."""
    size, overlap = options(size, overlap)

    @F.pandas_udf(CHUNK)
    def run(texts: pd.Series) -> pd.Series:
        clean = [(t or "").replace("\r\n", "\n") for t in texts]
        return pd.Series([finish(t, split_markdown(t, size), overlap) for t in clean])

    return run(text)


END = re.compile(r"[。！？；…]+|——|\.{3}|[.!?]|\n\n|\n")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    out, a = [], 0
    for m in END.finditer(text):
        e = m.end()
        if m[0] in ".!?":
            if m[0] == "." and m.start() and text[m.start() - 1].isdigit():
                continue
            rest = text[e:].lstrip(" \t")[:1] if e < len(text) else ""
            if rest and rest != "\n" and not re.match("[A-ZА-Я]", rest):
                continue
        if text[a:e].strip():
            out.append((a, e))
            a = e
    if text[a:].strip():
        out.append((a, len(text)))
    return out


def sentences(text: Column) -> Column:
    """array<struct<text,start,end>>; together they are the text, up to blanks at the end."""

    @F.pandas_udf("array<struct<text:string,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t[a:b], "start": a, "end": b} for a, b in sentence_spans(t)] for t in (x or "" for x in texts)])

    return run(text)


def window_context(rows: DataFrame, group: str, order: str, text: str, width: int = 2) -> DataFrame:
    """rows with `context`: each text with its width - 1 neighbours on either side."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(-(width - 1), width - 1)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


def breaks(vectors: np.ndarray, factor: float) -> list[int]:
    if len(vectors) <= 2:
        return []
    n = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(n == 0, 1, n)[:, None]
    sim = (unit[1:] * unit[:-1]).sum(1)
    return [] if sim.std() < 0.01 else np.flatnonzero(sim < sim.mean() - factor * sim.std()).tolist()


def semantic_spans(text: str, embed: Callable[[list[str]], np.ndarray], size: int, width: int, factor: float, least: int) -> list[tuple[int, int]]:
    spans = sentence_spans(text)

    def group(spans):
        shown = ["\n".join(text[a:b] for a, b in spans[max(0, i - width + 1) : i + width]) for i in range(len(spans))]
        cuts, out, a = breaks(embed(shown), factor) if spans else [], [], 0
        for c in cuts:  # short ones go on
            if estimate(text[spans[a][0] : spans[c][1]]) >= least:
                out.append(spans[a : c + 1])
                a = c + 1
        out.append(spans[a:])
        return [g for g in out if g]

    def walk(spans):
        groups = group(spans)
        if len(groups) == 1:
            return split_text(text, spans[0][0], spans[-1][1], size)
        out = []
        for g in groups:
            a, b = g[0][0], g[-1][1]
            out += [(a, b)] if estimate(text[a:b]) <= size else walk(g) if len(g) > 1 else split_text(text, a, b, size)
        return out

    return walk(spans) if spans else []


def chunk_semantic(text: Column, embed: Callable[[list[str]], np.ndarray], size: int = 512, overlap: int = 0, width: int = 2, factor: float = 1.0, least: int = 50) -> Column:
    """Chunks that end where neighbouring sentences differ in meaning. embed: texts to vectors, called with one text's sentences at a time."""
    size, overlap = options(size, overlap)

    @F.pandas_udf(CHUNK)
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            t = (t or "").replace("\r\n", "\n")
            out.append(finish(t, [(a, b, "") for a, b in semantic_spans(t, embed, size, width, factor, least)], overlap))
        return pd.Series(out)

    return run(text)


def hashed_vectors(texts: list[str], width: int = 64) -> np.ndarray:
    import zlib

    out = np.zeros((len(texts), width))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            out[i, zlib.crc32(w.encode()) % width] += 1
    return out


def line_packs(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, chunk_index, content, token_est: non-blank lines packed greedily, by a fold over each text's lines."""
    from ..functions.text import chunk_tokens

    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.trim(x) != "")
    zero = F.expr("cast(array() as array<struct<c:string,n:int>>)")
    last = lambda acc: F.try_element_at(acc, F.lit(-1))

    def fold(acc, x):
        n = chunk_tokens(x)
        fits = (F.size(acc) > 0) & (last(acc)["n"] + n <= size)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.concat(last(acc)["c"], F.lit("\n"), x).alias("c"), (last(acc)["n"] + n).cast("int").alias("n"))))
        return F.when(fits, joined).otherwise(F.concat(acc, F.array(F.struct(x.alias("c"), n.cast("int").alias("n")))))

    return docs.select("doc_id", F.posexplode(F.aggregate(lines, zero, fold)).alias("chunk_index", "x")).select("doc_id", "chunk_index", F.col("x.c").alias("content"), F.col("x.n").alias("token_est"))
