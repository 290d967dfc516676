"""Publishing the profile: serving projection, versioned swap, history, metrics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.dates import day
from riskloom.operators.history import kept_by_retention, new_history_rows
from riskloom.operators.picks import without_repeats
from riskloom.sources.commits import CommitLog
from riskloom.types import SERVING_COLUMNS, SERVING_COUNTS, SERVING_RENAMES


def serving_rows(profile: DataFrame, snapshot_date: dt.date | str, run_id: str, extra: list[str] | None = None) -> DataFrame:
    """Profile in the layout of the serving table: 27 columns (and ``extra`` ones), one row per employer.

    Absent columns are null and absent counts 0. Should an employer come twice,
    the row with more inspections is kept.
    """
    renamed = profile.withColumnsRenamed(SERVING_RENAMES).withColumns(
        {"snapshot_date": day(snapshot_date), "pipeline_run_id": F.lit(run_id)}
    )
    for name in SERVING_COLUMNS:
        if name not in renamed.columns:
            renamed = renamed.withColumn(name, F.lit(None).cast("string"))
    counts = {c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in SERVING_COUNTS}
    served = renamed.withColumns(counts).select(*SERVING_COLUMNS, *(extra or []))
    return without_repeats(served, "employer_id", ["osha_inspections"])


def materialize(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table once and hand out a DataFrame that reads it."""
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return rows.sparkSession.read.parquet(path)


def as_view(rows: DataFrame, name: str) -> DataFrame:
    rows.createOrReplaceTempView(name)
    return rows


def publish(served: DataFrame, root: str, run_id: str, snapshot_date: dt.date | str) -> str:
    """Write a new version and switch to it; the version before stays readable. The folder of the new version.

    An empty profile is refused before anything is written. The data are complete before
    the version is committed, and readers take the newest version, so they see one or
    the other. Writers that publish at the same time get a version each.
    """
    if served.isEmpty():
        raise ValueError("the profile is empty: nothing is published")
    log = CommitLog(served.sparkSession, root)
    folder, rows = log.write(served, run_id)
    log.commit({"folder": folder, "run_id": run_id, "snapshot_date": str(snapshot_date), "rows": rows})
    return f"{log.root}/{folder}"


def read_published(spark: SparkSession, root: str, back: int = 0) -> DataFrame:
    """The newest published version, or the one ``back`` versions before it."""
    log = CommitLog(spark, root)
    versions = log.entries()
    if len(versions) <= back:
        raise ValueError(f"no version {back} before the newest at the path {root}")
    folder = versions[-1 - back]["folder"]
    if folder not in log.folders():
        raise ValueError(f"version {versions[-1 - back]['version']} at the path {root} has been vacuumed")
    return spark.read.parquet(f"{log.root}/{folder}")


def vacuum_published(spark: SparkSession, root: str, keep: int, before: dt.datetime) -> list[str]:
    """Delete what was written before ``before``, but for the newest ``keep`` versions; also what no version names."""
    log = CommitLog(spark, root)
    return log.vacuum({entry["folder"] for entry in log.entries()[-keep:]}, before)


def _live(entries: list[dict]) -> dict[tuple[str, str], None]:
    """(folder, date) of what a history table holds, in the order it was added."""
    live: dict[tuple[str, str], None] = {}
    for entry in entries:
        for date in entry.get("dates", []):
            live[entry["folder"], date] = None
        gone = set(entry.get("retired", []))
        live = {key: None for key in live if key[1] not in gone}
    return live


def append_snapshots(rows: DataFrame, root: str, label: str = "history") -> int:
    """Add rows to a history table, in partitions by snapshot_date; how many. They must not be there yet."""
    return _append(CommitLog(rows.sparkSession, root), lambda _: rows, label)


def append_history(served: DataFrame, root: str) -> int:
    """Add the newest snapshot's rows that the history at ``root`` does not hold yet; how many.

    A repeated run adds nothing. Should another writer commit rows of the same date in
    between, this one takes back what it has written and compares again.
    """
    return _append(CommitLog(served.sparkSession, root), lambda held: new_history_rows(served, held), "history")


def _append(log: CommitLog, rows_beyond: Callable[[DataFrame | None], DataFrame], label: str) -> int:
    while True:
        rows = rows_beyond(_read_live(log.spark, log.root, _live(log.entries())))
        folder, count = log.write(rows.withColumn("day", F.col("snapshot_date")), label, partition_by="day")
        if not count:
            log.drop(folder)
            return 0
        dates = sorted(name.rpartition("day=")[2] for name in log.folders(folder) if "day=" in name)
        touches = set(dates)
        version = log.commit(
            {"folder": folder, "dates": dates, "rows": count},
            still_valid=lambda newer: not any(touches & {*entry.get("dates", []), *entry.get("retired", [])} for entry in newer),
        )
        if version:
            return count
        log.drop(folder)


def _read_live(spark: SparkSession, root: str, live: dict[tuple[str, str], None]) -> DataFrame | None:
    return spark.read.parquet(*[f"{root}/{folder}/day={date}" for folder, date in live]) if live else None


def read_history(spark: SparkSession, root: str, from_date: str = "", to_date: str = "9999-12-31") -> DataFrame:
    """The history table, or its snapshots from one date to another; only their folders are opened."""
    log = CommitLog(spark, root)
    live = {key: None for key in _live(log.entries()) if from_date <= key[1] <= to_date}
    if not live:
        raise ValueError(f"no snapshots at the path {root}")
    return _read_live(spark, log.root, live)


def apply_retention(spark: SparkSession, root: str, as_of: dt.date | str) -> int:
    """Retire the dates of the history that retention no longer keeps; the number retired.

    A date is kept or retired whole, so nothing is rewritten: one version says which
    dates are gone. ``vacuum_history`` then deletes their files.
    """
    log = CommitLog(spark, root)
    found = sorted({date for _, date in _live(log.entries())})
    if not found:
        return 0
    dates = spark.createDataFrame([(name,) for name in found], "name string").withColumn("day", F.try_to_date("name"))
    gone = sorted(r["name"] for r in dates.filter(F.col("day").isNotNull() & ~kept_by_retention(F.col("day"), as_of)).collect())
    if gone:
        log.commit({"retired": gone})
    return len(gone)


def vacuum_history(spark: SparkSession, root: str, before: dt.datetime) -> list[str]:
    """Delete the files of retired dates and of appends that never were committed, if written before ``before``."""
    log = CommitLog(spark, root)
    live = _live(log.entries())
    keep = {folder for folder, _ in live}
    gone = log.vacuum(keep, before)
    for folder in keep:
        stale = [name for name, changed in log.folders(folder).items() if "day=" in name and changed < before]
        for name in stale:
            if (folder, name.rpartition("day=")[2]) not in live:
                log.drop(name)
                gone.append(name)
    return gone


def write_metrics(checks: DataFrame, path: str, as_of: dt.date | str) -> None:
    """One JSON folder of metric rows per day; the same day is replaced."""
    checks.write.mode("overwrite").json(f"{path}/day={as_of}")


def read_previous_metrics(spark: SparkSession, path: str, as_of: dt.date | str) -> DataFrame | None:
    """Metrics of the newest day before ``as_of``; None when there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.schema("check_name string, severity string, passed boolean, value double, day date").json(path)
    earlier = rows.filter(F.col("day") < day(as_of))
    newest = earlier.agg(F.max("day")).first()[0]
    return None if newest is None else earlier.filter(F.col("day") == F.lit(newest)).drop("day")
