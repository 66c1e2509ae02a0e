"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_dir, work_path

__all__ = ["bind", "every_salt", "filesystem", "fresh_name", "map_batches", "materialise", "running", "salt", "shared_dir", "table", "with_group", "work_path", "write_atomically"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that goes to a Python worker; Spark's own number would put many megabytes of texts into one.
BATCH_ROWS = 512


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over small batches, whose worker gives its free memory back after each task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(go, schema)


def release_memory() -> None:
    """Return what Python, Arrow and the C library hold without need to the system; workers stay alive between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI or a plain local path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_atomically(uri: str, write) -> None:
    """Call ``write(stream)`` on a temporary name beside ``uri``, then move it into place.

    A task that runs twice (retry, speculation) replaces the file by the same bytes, and readers never see half a file.
    """
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(temporary) as stream:
        write(stream)
    system.move(temporary, path)


# -- column expressions ----------------------------------------------------------------------------------------------

#: Elements that ``running`` takes at a time.
_RUN = 128


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, add) -> Column:
    """For each element of an array, what ``add`` makes of ``zero`` and all elements before it (``add`` must be associative).

    An array that grows by one in each step costs its length squared, so runs of elements are folded first, then the runs.
    """

    def fold(part: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, begin, lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def runs(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int")), lambda i: F.slice(v, i * _RUN + 1, _RUN))
        sums = lambda p: F.transform(p, lambda part: F.aggregate(part, zero, add))
        return bind(parts, lambda p: F.flatten(F.zip_with(p, fold(sums(p), zero), fold)))

    return bind(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).when(F.size(v) <= _RUN, fold(v, zero)).otherwise(runs(v)))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# -- groups that one task could not hold -----------------------------------------------------------------------------

#: Parts that the rows of a group are dealt over.
SALTS = 32


def salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).alias("salt")


def every_salt() -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))


def with_group(rows: DataFrame, keys: list[str], members: list[str], where: str | None = None, **values: tuple) -> DataFrame:
    """``rows`` with aggregates over their group, each (min or max, column), of groups that pass ``where``.

    Members of a group are dealt over tasks by a salt. Aggregating combines a group's rows before they move, and the same
    aggregation notes, in a bit each, which salts the group has rows with; what the group shares goes once to each of those.
    """
    salted = rows.select("*", salt(*members))
    whole = salted.groupBy(*keys).agg(*(f(c).alias(name) for name, (f, c) in values.items()), F.bit_or(F.expr("shiftleft(1L, CAST(salt AS INT))")).alias("salts"))
    whole = whole.where(where) if where else whole
    spread = F.explode(F.filter(every_salt(), lambda i: F.bit_get("salts", i.cast("int")) == 1)).alias("salt")
    return salted.join(whole.select(*keys, *values, spread), [*keys, "salt"]).drop("salt")
