"""Dated snapshots: ``{root}/{source}/{YYYY-MM-DD}/``."""

from __future__ import annotations

import datetime as dt
import logging
import re

from pyspark.sql import DataFrame, SparkSession

from riskloom.types import RAW_FIELDS

log = logging.getLogger(__name__)

_DAY = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def _children(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, path) of a folder's entries through Hadoop, so any file system Spark reads will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    return [(s.getPath().getName(), s.getPath().toString()) for s in files.listStatus(path)]


def _holds_rows(spark: SparkSession, folder: str) -> bool:
    """Whether Parquet files stand in the folder or in the batches that a stream landed in it."""
    inside = _children(spark, folder)
    return any(name.endswith(".parquet") for name, _ in inside) or any(
        name.startswith("batch=") and _holds_rows(spark, path) for name, path in inside
    )


def latest_snapshot_path(spark: SparkSession, root: str, source: str) -> str | None:
    """Newest date folder that holds a Parquet file. Only folder names are listed, no data is read."""
    days = sorted((c for c in _children(spark, f"{root}/{source}") if _DAY.match(c[0])), reverse=True)
    for _, path in days:
        if _holds_rows(spark, path):
            return path
    return None


def read_latest(spark: SparkSession, root: str, source: str) -> DataFrame | None:
    """The newest snapshot of a source, or None (with a warning) when there is none."""
    path = latest_snapshot_path(spark, root, source)
    if path is None:
        log.warning("no snapshot of %s below %s", source, root)
        return None
    landed = any(name.startswith("batch=") for name, _ in _children(spark, path))
    rows = spark.read.parquet(path)
    return rows.drop("batch") if landed else rows


def write_snapshot(
    rows: DataFrame, root: str, source: str, day: dt.date | str, fields: list[str] | None = None
) -> str:
    """Write one day's snapshot with the configured fields that exist; the same day is replaced.

    Spark's commit protocol publishes the files of a finished job only.
    """
    wanted = fields if fields is not None else RAW_FIELDS[source]
    kept = [f for f in wanted if f in rows.columns] or rows.columns
    path = f"{root}/{source}/{day}"
    rows.select(*kept).write.mode("overwrite").parquet(path)
    return path
