"""Tables as Parquet directories: conditions, upserts, deletes with cascade, JSON codecs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types

NAME = re.compile(r"^[A-Za-z0-9_]+$")


def checked(name: str) -> str:
    if not NAME.match(name):
        raise ValueError(f"bad identifier {name!r}")
    return name


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object

    def column(self) -> Column:
        c, op = F.col(checked(self.field)), self.op.upper()
        if op == "IN":
            return c.isin(*self.value) if self.value else F.lit(False)
        if op == "LIKE":
            return c.ilike(self.value)
        table = {"=": c == self.value, "!=": c != self.value, ">": c > self.value, ">=": c >= self.value, "<": c < self.value, "<=": c <= self.value}
        if op not in table:
            raise ValueError(f"unsupported operator {self.op!r}")
        return table[op]


@dataclass(frozen=True)
class Query:
    """A conjunctive select: conditions, (column, descending) orders, limit and offset (0: none)."""

    where: Sequence[Condition] = ()
    order_by: Sequence[tuple[str, bool]] = ()
    limit: int = 0
    offset: int = 0
    columns: Sequence[str] = field(default_factory=tuple)

    def run(self, df: DataFrame) -> DataFrame:
        for c in self.where:
            df = df.filter(c.column())
        if self.order_by:
            df = df.orderBy(*[F.col(checked(n)).desc() if down else F.col(checked(n)).asc() for n, down in self.order_by])
        df = df.offset(self.offset) if self.offset > 0 else df
        df = df.limit(self.limit) if self.limit > 0 else df
        return df.select(*self.columns) if self.columns else df


def get(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def upsert(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those with the same key. new has each key once, or the rows are ordered by `_seq`."""
    cols = df.columns
    both = df.withColumn("_v", F.lit(-1)).unionByName(new.select(*cols, (F.col("_seq") if "_seq" in new.columns else F.lit(0)).alias("_v")))
    return both.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_v")))).filter("_r = 1").select(*cols)


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def cascade(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) without the parents in ids(key) and their children."""
    return delete(parents, ids, key), delete(children, ids.select(F.col(key).alias(foreign)), foreign)


def encode(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def decode(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.from_json(c, s) for c, s in schemas.items()})


class Tables:
    """A directory of Parquet tables. A table is replaced by writing a new one beside it, whole, and then giving it the name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{checked(name)}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
        df.write.mode(mode).partitionBy(*partition_by).parquet(self.path(name))

    def create(self, name: str, schema: str) -> None:
        """Nothing if the table is there."""
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(self.path(name))

    def replace(self, name: str, df: DataFrame) -> None:
        """df, which may be made from the table itself, takes its place."""
        fresh = f"{self.root}/_{checked(name)}-{uuid.uuid4().hex}"
        df.write.parquet(fresh)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        old, new = path(self.path(name)), path(fresh)
        fs = new.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"{fresh} could not take the name {name!r}")
        self.spark.catalog.refreshByPath(self.path(name))

    def execute(self, statement: str) -> None:
        """A statement that defines or changes; rows are not returned. For trusted callers only: the text runs as it is."""
        self.spark.sql(statement)


class Collection:
    """Points (id, vector and payload columns) of one width in a table of tables, made if it is not there."""

    def __init__(self, tables: Tables, name: str, width: int, payload: str = ""):
        self.tables, self.name = tables, name
        kinds = list(types.StructType.fromDDL(payload)) if payload else []
        vector = types.StructField("vector", types.ArrayType(types.DoubleType()), True, {"width": width})
        schema = types.StructType([types.StructField("id", types.StringType()), vector, *kinds])
        tables.spark.createDataFrame([], schema).write.mode("ignore").parquet(tables.path(name))
        self.width = self.points().schema["vector"].metadata["width"]
        if self.width != width:
            raise ValueError(f"the vectors of {name!r} have {self.width} numbers, not {width}")

    def points(self) -> DataFrame:
        return self.tables.read(self.name)

    def upsert(self, new: DataFrame) -> None:
        """A vector of another width, or none, fails the write and leaves the table as it was."""
        wrong = F.raise_error(F.lit(f"a vector has not {self.width} numbers"))
        new = new.withColumn("vector", F.when(F.size("vector") == self.width, F.col("vector")).otherwise(wrong.cast("array<double>")))
        self._replace(upsert(self.points(), new, "id"))

    def delete(self, ids: DataFrame) -> None:
        self._replace(delete(self.points(), ids, "id"))

    def _replace(self, df: DataFrame) -> None:
        self.tables.replace(self.name, df.withMetadata("vector", {"width": self.width}))


class Derived:
    """What derive makes of a table (an index, say): made when it is asked for, held, and made anew only after a change."""

    def __init__(self, derive: Callable[[DataFrame], DataFrame], source: DataFrame):
        self.derive, self.source, self._made = derive, source, None

    def change(self, source: DataFrame) -> None:
        if self._made is not None:
            self._made.unpersist()
        self.source, self._made = source, None

    def get(self) -> DataFrame:
        if self._made is None:
            self._made = self.derive(self.source).persist()
        return self._made
