"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riskloom.session import scratch_path

MASK = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15  # step of splitmix64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

Batches = Iterator[pa.RecordBatch]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, for an array of unsigned 64-bit integers."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class Codes(dict):
    """A number for each word, in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


_HELD: dict[str, dict] = {}


def held(owner: str, cache: dict) -> dict:
    """Register what the tasks of one operator keep in a worker between batches and tasks."""
    _HELD[owner] = cache
    return cache


def begin(owner: str) -> None:
    """At the start of a task: forget what other operators have left in this worker, which lives through all of them."""
    others = [cache for name, cache in _HELD.items() if name != owner and cache]
    for cache in others:
        cache.clear()
    if others:
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)  # give the pages back to the system
        except (OSError, AttributeError):
            pass


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and still there when an executor is lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they reach that folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array, empty: str | bytes = "") -> list:
    """The column's texts, or their bytes; null counts as empty."""
    return [text or empty for text in column.to_pylist()]


def in_slices(batches: Batches, max_bytes: int = 8 << 20) -> Batches:
    """Cut batches so that what a task makes of one stays small, however long the texts are."""
    for batch in batches:
        size = max(1, batch.nbytes)
        step = max(1, batch.num_rows * max_bytes // size)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
