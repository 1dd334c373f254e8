"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinline.session import scratch_base, ship_package, shuffles_go

MIN_LONG = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` (never null: the least long stands for a null id) and ``_text`` alone, so no other column can clash."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("_id"), F.col(text_col).cast("string").alias("_text"))


def cut(rows: DataFrame, n: int, most: int) -> DataFrame:
    """``most`` rows at most of n (_id, _text and more), by the order of a hash of id and text; before any row moves, a
    bound on that hash leaves little more than ``most``."""
    if n <= most:
        return rows
    bound = MIN_LONG + int(2**64 * min(1, (1.05 * most + 100) / n)) - 1
    return rows.withColumn("_h", F.xxhash64("_id", "_text", F.lit(7))).filter(F.col("_h") <= bound).orderBy("_h", "_id").limit(most).drop("_h")


def bounded_rows(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """Of ``docs`` (_id, _text) rows with an id in ``known`` (_id and more columns, ids not null), joined with it: ``most`` at most.

    ``most`` rows of ``known`` by a hash of the id are broadcast; as an id may have any number of documents, their rows are cut as well.
    """
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(most))
    rows = docs.filter(F.col("_id") != MIN_LONG).join(chosen, "_id")
    return cut(rows, rows.count(), most)


def public_id(col: str = "_id"):
    return F.when(F.col(col) != F.lit(MIN_LONG), F.col(col))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the application's in the shared folder."""
    return f"{scratch_base(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows as a Parquet table in the shared folder and reads them back. The shuffle files of that go at once."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    with shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinline_scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote, once nothing that is still to be read comes from them."""
    for t in tables:
        path = getattr(t, "_kinline_scratch", None)
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


_KEPT: dict[tuple, Any] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def lean() -> None:
    """At a task's beginning: what earlier tasks have left in this Python worker goes, the memory that another operator
    keeps and what Arrow and the C library hold of freed memory. Workers live on from one operator to the next."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps for later tasks of one operator; another operator's is dropped for it."""
    if key not in _KEPT:
        lean()
        _KEPT[key] = make()
    return _KEPT[key]


def numpy(batch: pa.RecordBatch, name: str, dtype=None) -> np.ndarray:
    out = batch.column(name).to_numpy(zero_copy_only=False)
    return out if dtype is None else out.view(dtype) if out.dtype.itemsize == np.dtype(dtype).itemsize else out.astype(dtype)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
