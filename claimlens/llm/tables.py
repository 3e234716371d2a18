"""Inputs of the text operators and the storage they share."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.session import scratch_path, shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that the scan reads no others."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def stored(df: DataFrame, name: str = "text") -> DataFrame:
    """The same rows from a Parquet table in the shared folder: computed once, and safe from lost executors.

    The shuffle files behind the table are then of no use. Spark deletes those whose frames the driver has let go, so
    the driver is asked to, rather than to keep them until it happens to run short of memory.
    """
    path = scratch_path(df.sparkSession, name)
    spark, schema = df.sparkSession, df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken, made = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        made.append(name)
    return made


def without_keys(df: DataFrame, gone: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows whose keys are not among those of ``gone`` (its columns in the order of ``keys``); null equals null."""
    left, right = free(df, *(f"_left{k}" for k in range(len(keys)))), free(df, *(f"_right{k}" for k in range(len(keys))))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]
    test = same[0] if len(same) == 1 else same[0] & same[1]
    return df.withColumns(dict(zip(left, keys))).join(gone.toDF(*right), test, "left_anti").drop(*left)


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(column, UPPER, UPPER.lower())


def crc_of(column: Column) -> Column:
    """crc32 of a number written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def pieces(batch, column: str, most_bytes: int) -> Iterable:
    """Slices of an Arrow batch whose text holds at most ``most_bytes``, or one single row."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returned first in this Python process, so that a reused worker need not make it for every task.

    Task functions travel with their code, so their own globals are new in each task.
    """
    store = sys.modules.setdefault("_claimlens_kept", types.ModuleType("_claimlens_kept")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]
