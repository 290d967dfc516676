"""An uploaded table of companies, enriched from the profile and written as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.headers import resolve_headers
from riskloom.operators.lookup import RESULT_COLUMNS, enrich_lookups, match_summary
from riskloom.session import cut_lineage
from riskloom.sources.delimited import read_lookups, write_csv


def enrich_upload(spark: SparkSession, path: str, profile: DataFrame, out: str, prefix: str = "match_") -> DataFrame:
    """Enrich the CSV files at ``path`` into CSV files at ``out``; the match summary.

    The files are UTF-8 (with or without a byte-order mark) or Latin-1; quoted fields may
    hold commas and line breaks. Headers are recognised by their spellings
    (functions.headers); a table without a name or tax-number column, or without rows, is
    refused before anything is written. Every row comes out in the order it came in, with
    all of its columns as they were and the result columns behind them, empty where
    nothing matches; rows with neither name nor tax number pass unmatched. A column of
    the upload that is named like a result column is replaced.
    """
    rows = read_lookups(spark, path, quoted_breaks=True)
    names = rows.columns
    fields = resolve_headers(names)
    # Numbered once and kept: the number is the row's place and joins the result to it.
    numbered = cut_lineage(rows.toDF(*[f"c{k}" for k in range(len(names))]).withColumn("lookup_id", F.monotonically_increasing_id()))
    if numbered.isEmpty():
        raise ValueError(f"no rows in the upload at {path}")
    asked = numbered.select("lookup_id", *[F.col(f"c{names.index(column)}").alias(field) for field, column in fields.items()])
    found = cut_lineage(enrich_lookups(asked, profile).select("lookup_id", *RESULT_COLUMNS))
    results = [f"{prefix}{c}" for c in RESULT_COLUMNS]
    kept = [k for k, name in enumerate(names) if name not in results]
    ordered = numbered.join(found, "lookup_id").orderBy("lookup_id").select(*[f"c{k}" for k in kept], *RESULT_COLUMNS)
    write_csv(ordered.toDF(*[names[k] for k in kept], *results), out)
    return match_summary(found)
