"""Registries of stores, embedders and other drivers by name; file sources; the notes sink; offline stand-ins for model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KINDS = ("structured", "vector", "graph", "embedding")
_drivers: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def register(kind: str, name: str, factory: Callable) -> None:
    """The last registration of a name holds."""
    if kind not in _drivers:
        raise ValueError(f"unknown kind {kind!r}")
    _drivers[kind][name] = factory


def build(kind: str, name: str, **options):
    if name not in _drivers.get(kind, {}):
        raise ValueError(f"no {kind} driver {name!r}")
    return _drivers[kind][name](**options)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, ext, content (binary), size of the files at path."""
    df = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "content", F.col("length").alias("size"))


def pasted(spark: SparkSession, texts: list[str]) -> DataFrame:
    rows = [("paste.txt", "paste.txt", "txt", bytearray(t, "utf-8"), len(t.encode())) for t in texts]
    return spark.createDataFrame(rows, "path string, name string, ext string, content binary, size bigint")


def note_files(notes: DataFrame) -> DataFrame:
    """name, value: each note as Markdown with YAML front matter."""
    text = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("title: "), F.to_json(F.struct("title")).substr(F.lit(10), F.length(F.to_json(F.struct("title"))) - 10)), F.concat(F.lit("type: "), "type"), F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]")), F.concat(F.lit("updated_at: "), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("---"), F.lit(""), F.col("content"))
    return notes.select(F.concat("id", F.lit(".md")).alias("name"), text.alias("value"))


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """A deterministic offline embedding: hashed term counts, normalised to length 1."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        import zlib

        for s in batches:
            out = []
            for t in s:
                v = np.zeros(width)
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % width] += 1 if h & 1 << 20 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return embed(text)


#: Statuses after which a batch is not sent again.
FINAL = (*range(400, 419), 421, 422, 423, 424, 425, 426, 428, 431, 451)


def retried(call: Callable, batch: list, attempts: int = 3, wait: float = 1.0):
    """call(batch), tried again after wait, 2 * wait, ... seconds unless the error names a final status."""
    import time

    for k in range(attempts):
        try:
            return call(batch)
        except Exception as error:
            if any(f"status {s}" in str(error) for s in FINAL):
                raise
            if k == attempts - 1:
                raise RuntimeError(f"no vectors after {attempts} attempts: {error}") from error
        time.sleep(wait * 2**k)


def by_index(items: list[dict], n: int) -> list:
    """The vectors of a service's answer, items(index, embedding) in any order, in the order of the n texts."""
    out = [None] * n
    for x in items:
        out[x["index"]] = x["embedding"]
    if any(v is None for v in out):
        raise ValueError(f"{sum(v is None for v in out)} of {n} texts have no vector")
    return out


def batched(embed: Callable[[list[str]], list], size: int = 32, attempts: int = 3, wait: float = 1.0) -> Callable[[Column], Column]:
    """A column function from a service that embeds lists of texts: `size` texts a call, a failed call tried again. Null is the empty text."""

    def column(text: Column) -> Column:
        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                texts, out = s.fillna("").tolist(), []
                for i in range(0, len(texts), size):
                    out += [list(map(float, v)) for v in retried(embed, texts[i : i + size], attempts, wait)]
                yield pd.Series(out, dtype=object)

        return run(text)

    return column


register("embedding", "hashed", lambda **o: lambda c: hashed_embedding(c, **o))


def expand_queries(query: str, lines: list[str], most: int = 3) -> list[str]:
    """The query and its variants from a model's lines: list markers stripped, empty ones and repeats of the query left out."""
    import re

    out = [re.sub(r"^[0-9. )\-、]+", "", x).strip() for x in lines]
    return [query, *[x for x in out if x and x != query][:most]]


def hypothetical(query: str, model: Callable[[str, str], str]) -> str:
    """A passage that would answer the query, by model(instruction, question); searched like another wording of the query."""
    told = "Write a short factual passage, as from a textbook, that answers the question in its own language. Write nothing else."
    passage = (model(told, query) or "").strip()
    if not passage:
        raise ValueError("the model gave no passage")
    return passage
