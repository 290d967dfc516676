"""Tables clustered by a key, for reads of single keys.

Rows lie in files by ranges of the key, sorted inside, and a manifest keeps each file's
least and greatest key. A read of some keys asks the manifest which files may hold them
and opens no other. Inside a file, row groups are skipped by their statistics and by a
Bloom filter on the key. A table that is asked by several keys is written once per key,
as an index would be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 500_000
ROW_GROUP_BYTES = 8 << 20


def write_clustered(rows: DataFrame, root: str, key: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Write ``rows`` to ``root`` by ranges of ``key``; the number of files.

    Ranges are cut by a sample of the keys, with a hash of the row behind the key, so
    that a key with a third of all rows is spread over files of its own. Rows without a
    key stand in front; reads of keys never open them.
    """
    files = max(1, -(-rows.count() // rows_per_file))
    spread = F.xxhash64(*rows.columns)
    placed = rows.repartitionByRange(files, F.col(key), spread).sortWithinPartitions(key)
    bloom = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.block.size": str(ROW_GROUP_BYTES)}
    placed.write.mode("overwrite").options(**bloom).parquet(f"{root}/rows")
    written = rows.sparkSession.read.parquet(f"{root}/rows")
    low, high = F.min(key).alias("low"), F.max(key).alias("high")
    # Only names of files are kept, so that the table may be moved as a whole.
    manifest = written.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(low, high, F.count(F.lit(1)).alias("rows"))
    manifest.repartition(1).sortWithinPartitions("low").write.mode("overwrite").parquet(f"{root}/manifest")
    return files


def read_clustered(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/rows")


def files_of(spark: SparkSession, root: str, keys: list) -> list[str]:
    """Names of the files whose range of keys holds one of ``keys``."""
    asked = F.lit(False)
    for key in keys:
        asked = asked | ((F.col("low") <= F.lit(key)) & (F.col("high") >= F.lit(key)))
    return sorted(row["file"] for row in spark.read.parquet(f"{root}/manifest").filter(asked).select("file").collect())


def read_keys(spark: SparkSession, root: str, key: str, keys: list) -> DataFrame:
    """The rows whose ``key`` is one of ``keys`` (a few values), from the files that may hold them."""
    files = files_of(spark, root, keys)
    if not files:
        return read_clustered(spark, root).limit(0)
    return spark.read.schema(read_clustered(spark, root).schema).parquet(*[f"{root}/rows/{file}" for file in files]).filter(F.col(key).isin(keys))
