"""Pipe-delimited bulk files and seed CSVs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(
    spark: SparkSession, path: str, fields: list[str] | None = None, sep: str = "|", encoding: str = "ISO-8859-1"
) -> DataFrame:
    """All-string table of a delimited file with a header line.

    Short lines are filled with nulls. Lines with too many fields are skipped:
    PERMISSIVE mode would cut them and DROPMALFORMED would drop short ones too, so
    the malformed text is kept aside and its field count decides.
    """
    options = {"sep": sep, "encoding": encoding, "header": "true"}
    header = spark.read.options(**options).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in [*header, "_malformed"])
    rows = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed").schema(schema).csv(path)
    unquoted = F.regexp_replace("_malformed", '"[^"]*"', "")
    fields_found = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit(""))) + 1
    fitting = F.col("_malformed").isNull() | (fields_found <= len(header))
    kept = [f for f in (fields or header) if f in header] or header
    return rows.filter(fitting).select(*kept)


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small lookup CSV with a declared schema. Catalyst broadcasts it while its size allows."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Enriched lookups as CSV; nulls become empty fields."""
    rows.write.mode("overwrite").options(header=True, nullValue="", emptyValue="", escape='"').csv(path)


def read_lookups(spark: SparkSession, path: str, quoted_breaks: bool = False) -> DataFrame:
    """An uploaded CSV, all strings; a byte-order mark in the first header is dropped.

    Files that are no valid UTF-8 are read as Latin-1, all of them or none. With
    ``quoted_breaks`` a quoted field may hold line breaks and doubled quotes; each file is
    then read by one task.
    """
    valid = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value"))).first()[0]
    reader = spark.read.options(header="true", encoding="ISO-8859-1" if valid is False else "UTF-8")
    rows = (reader.options(multiLine="true", quote='"', escape='"') if quoted_breaks else reader).csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
