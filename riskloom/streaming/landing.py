"""Resumable landing of record files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def land_json_lines(
    spark: SparkSession,
    inbox: str,
    bronze: str,
    quarantine: str,
    checkpoint: str,
    schema: str,
    required: list[str],
    files_per_batch: int = 100,
    keys: list[str] | None = None,
    loaded_at: str | None = None,
    overlap: str = "1 day",
) -> StreamingQuery:
    """Append new JSON-lines files to ``bronze``; set unreadable rows aside; then stop.

    Progress is in the checkpoint: after a crash the next run goes on where this
    one stopped. Each micro-batch overwrites its own folder, so a batch that is
    repeated leaves no second copy. With a date folder ``{root}/{source}/{YYYY-MM-DD}``
    as ``bronze``, ``read_latest`` reads what has landed.

    A resumed download fetches records again. With ``keys`` a record lands once, however
    often it comes within ``overlap`` of its load time ``loaded_at`` (a timestamp): the
    keys seen are state in the checkpoint, so this holds over restarts, and keys older
    than the watermark are forgotten. A record loaded more than ``overlap`` before the
    newest one of an earlier batch cannot be told from a repeat and is refused;
    ``refused_rows`` counts them. Bad rows, here also those without a key or a load time,
    are set aside by a query of their own that ends before the returned one begins.
    """
    rows = (
        spark.readStream.schema(f"{schema}, _malformed string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_malformed")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(inbox)
    )

    bad = F.col("_malformed").isNotNull()
    for name in [*required, *(keys or []), *([loaded_at] if keys else [])]:
        bad = bad | F.col(name).isNull()
    rows = rows.withColumn("_bad", bad)

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.persist()  # read once for both writes
        marked.filter(~F.col("_bad")).drop("_bad", "_malformed").write.mode("overwrite").parquet(f"{bronze}/batch={batch_id}")
        marked.filter("_bad").drop("_bad").write.mode("overwrite").json(f"{quarantine}/batch={batch_id}")
        marked.unpersist()

    def set_aside(batch: DataFrame, batch_id: int) -> None:
        batch.drop("_bad").write.mode("overwrite").json(f"{quarantine}/batch={batch_id}")

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.drop("_bad", "_malformed").write.mode("overwrite").parquet(f"{bronze}/batch={batch_id}")

    def started(stream: DataFrame, each: Callable[[DataFrame, int], None], progress: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", progress).trigger(availableNow=True).start()

    if not keys:
        return started(rows, write, checkpoint)
    started(rows.filter("_bad"), set_aside, f"{checkpoint}/bad").awaitTermination()
    once = rows.filter(~F.col("_bad")).withWatermark(loaded_at, overlap).dropDuplicatesWithinWatermark(keys)
    return started(once, land, f"{checkpoint}/good")


def refused_rows(query: StreamingQuery) -> int:
    """Rows that a finished landing refused because they were loaded before its watermark."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])
