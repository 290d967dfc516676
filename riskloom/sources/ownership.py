"""Corporate-ownership feed: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.types import OWNERSHIP_SCHEMA


def read_ownership_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(companies, links) of a feed; lines that are no JSON are skipped."""
    rows = spark.read.schema(OWNERSHIP_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return split_ownership(rows)


def parse_ownership_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """The same for lines that are already in a table."""
    parsed = lines.select(F.from_json(column, OWNERSHIP_SCHEMA, {"mode": "PERMISSIVE"}).alias("o"))
    return split_ownership(parsed.filter(F.col("o.schema").isNotNull()).select("o.*"))


def _first(name: str):
    return F.coalesce(F.try_element_at(F.try_element_at("properties", F.lit(name)), F.lit(1)), F.lit(""))


def split_ownership(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    companies = (
        rows.filter(F.col("schema") == "Company")
        .select(
            "id", _first("name").alias("name"), _first("country").alias("country"), _first("jurisdiction").alias("jurisdiction")
        )
        .filter(F.col("name") != "")
    )
    links = (
        rows.filter(F.col("schema") == "Ownership")
        .select(F.explode(F.try_element_at("properties", F.lit("owner"))).alias("owner_id"), "properties")
        .select("owner_id", F.explode(F.try_element_at("properties", F.lit("asset"))).alias("asset_id"))
    )
    return companies, links
