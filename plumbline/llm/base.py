"""What the operators of this package share: text columns, row batches, registered queries."""

from __future__ import annotations

import functools
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Byte table that lower-cases A-Z and nothing else.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def small_batches(fn):
    """``fn`` with Arrow batches of at most 1,000 rows, as a row holds a whole text; a smaller setting stays."""
    @functools.wraps(fn)
    def run(spark, *rest):
        setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
        spark.conf.set(setting, str(min(int(spark.conf.get(setting)), 1_000)))
        return fn(spark, *rest)
    return run


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its statement for the comparison engine."""
    def add(fn):
        QUERIES[name] = small_batches(fn)
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return add


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_of(col: str) -> Column:
    return F.col(col).cast("long")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Text of ASCII alone takes the quick way, which gives the same."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_RESIDENT: dict[object, object] = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: the last operator's tables only, so that those of several never add up."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def rows(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[list[list]]:
    """Column lists of at most ``step`` rows, so that Python objects of one slice only are alive."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [c.to_pylist() for c in part.columns]


def out_batch(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
