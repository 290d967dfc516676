"""Prefix join: which patterns does a text start with?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_prefixes(texts: DataFrame, wanted: DataFrame, text: str, pattern: str) -> DataFrame:
    """One row per text and prefix that could be a pattern; a text without any keeps one row with null.

    Only prefix lengths that occur among the patterns are tried.
    """
    lengths = wanted.agg(F.collect_set(F.length(pattern))).scalar()
    return (
        texts.withColumn("_lengths", lengths)
        .withColumn("_length", F.explode_outer(F.filter("_lengths", lambda n: n <= F.length(text))))
        .withColumn("_prefix", F.left(F.col(text), F.col("_length")))
        .drop("_lengths", "_length")
    )


def prefix_matches(texts: DataFrame, patterns: DataFrame, text: str, pattern: str) -> DataFrame:
    """All (text, pattern) rows where the text starts with the pattern.

    Each text yields its own prefixes and an equi-join finds those that are
    patterns, so the work is linear in both inputs however many patterns exist.
    ``texts`` should hold distinct values.
    """
    wanted = patterns.filter(F.length(pattern) > 0)
    prefixes = _with_prefixes(texts, wanted, text, pattern)
    return prefixes.join(wanted.withColumn("_prefix", F.col(pattern)), "_prefix").drop("_prefix")


def with_longest_prefix(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, label: str) -> DataFrame:
    """``texts`` with the label of the longest pattern each starts with (ties: least label), or null.

    ``texts`` must hold each text once; its other columns are kept.
    """
    wanted = patterns.filter(F.length(pattern) > 0).groupBy(F.col(pattern).alias("_prefix")).agg(F.min(label).alias(label))
    tried = _with_prefixes(texts, wanted, text, "_prefix").join(wanted, "_prefix", "left")
    others = [F.max(c).alias(c) for c in texts.columns if c != text]
    longest = F.max_by(label, F.when(F.col(label).isNotNull(), F.length("_prefix"))).alias(label)
    return tried.groupBy(text).agg(*others, longest)
