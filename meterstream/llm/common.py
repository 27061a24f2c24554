"""Shared helpers of the corpus operators."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A word is a run of anything but these white-space characters (Java and RE2 syntax).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only a local session without it (tests, a laptop) gets a folder of its own under the warehouse;
    on a cluster that might be each machine's own, so there the setting must be made.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-work"
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_open = threading.local()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``saved`` writes in here are deleted at its end."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        forget(*scopes.pop())


def saved(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors.

    Within ``scratch`` the table lives until its end, or with ``outlive`` until that of the scope around it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    scopes = _open.__dict__.get("scopes", [])
    if len(scopes) > outlive:
        scopes[-1 - outlive].append(out)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``saved`` once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_saved_at", None)
        if path:
            forget_path(df.sparkSession, path)


def forget_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of a table, as ``weight`` counts them, up to which it is broadcast.
MOST_BROADCAST = 64 << 20


def _bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        own = F.octet_length(value) + 16
    elif isinstance(kind, ArrayType):
        inner = isinstance(kind.elementType, (StringType, BinaryType, ArrayType, MapType, StructType))
        own = F.aggregate(value, F.lit(16).cast("long"), lambda n, x: n + _bytes(x, kind.elementType)) if inner else F.size(value) * 8 + 16
    elif isinstance(kind, MapType):
        own = _bytes(F.map_keys(value), ArrayType(kind.keyType)) + _bytes(F.map_values(value), ArrayType(kind.valueType))
    elif isinstance(kind, StructType):
        own = sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    else:
        own = F.lit(16)
    return F.coalesce(own, F.lit(8)).cast("long")


def weight(table: DataFrame) -> int:
    """About how many bytes a table's rows take."""
    return table.agg(F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(16)))).first()[0] or 0


def small(table: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The table, to be broadcast if its rows are measured to take ``most_broadcast`` bytes at most; else joins shuffle it."""
    return F.broadcast(table) if weight(table) <= most_broadcast else table


@contextmanager
def arrow_rows(spark: SparkSession, most: int = 500) -> Iterator[None]:
    """Tables written in here go to Python in batches of few rows, as both sides hold a batch at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_BLANKS = frozenset(b" \t\n\x0b\x0c\r")


def blank_cut(raw: bytes, piece: int = 1 << 18) -> Iterator[bytes]:
    """A text in pieces that end at white space, so that no word is cut."""
    at = 0
    while len(raw) - at > piece:
        to = at + piece
        while to < len(raw) and raw[to] not in _BLANKS:
            to += 1
        yield raw[at:to]
        at = to
    yield raw[at:]


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few at a time so that long texts aren't all decoded at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(column.to_pylist() for column in part.columns))


def slices(batch: pa.RecordBatch, column: int, rows: int = 128, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few rows and, unless it is a single one, few bytes of text, so that long texts that fall together need no more memory."""
    at, held = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if k > at and (k - at == rows or held + (n or 0) > size):
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n or 0
    if at < batch.num_rows:
        yield batch.slice(at)
