"""Exact percentiles of groups of any size.

Spark's ``percentile`` holds all distinct values of a group in one buffer. Here
a percentile is found digit by digit: each round counts the group's values per
digit (at most 2**21 of them), finds the digit the wanted rank falls into and
keeps the values below it. No task ever holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DIGIT_BITS = 21
_ROUNDS = 3


def exact_percentiles(
    rows: DataFrame, group: str, metrics: dict[str, tuple[Column, int]], fraction: float = 0.5
) -> DataFrame:
    """One row per ``group`` with a double column per metric, interpolated between neighbouring ranks.

    ``metrics`` maps an output name to (column, scale): values are compared as
    ``value * scale`` in whole numbers, so scale 1000 keeps three decimals exact.
    Null groups and values do not take part.
    """
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), (column * scale).cast("long").alias("v"))
            for name, (column, scale) in metrics.items()
        ]
    )
    values = (
        rows.filter(F.col(group).isNotNull())
        .select(F.col(group).alias("g"), F.explode(entries).alias("e"))
        .select("g", "e.metric", "e.v")
        .filter(F.col("v").isNotNull())
        .groupBy("g", "metric", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    position = (F.col("total") - 1) * F.lit(fraction)
    low, high = F.floor(position), F.ceil(position)
    targets = (
        values.groupBy("g", "metric")
        .agg(F.sum("n").alias("total"))
        .select("g", "metric", (position - low).alias("weight"), F.explode(F.array_distinct(F.array(low, high))).alias("at"))
        .select("g", "metric", "weight", "at", F.col("at").alias("rank"), F.lit(None).cast("long").alias("head"))
    )
    for step in range(_ROUNDS):
        targets = _narrow(values, targets, (_ROUNDS - 1 - step) * _DIGIT_BITS, first=step == 0)

    found = targets.groupBy("g", "metric").agg(
        F.min_by("head", "at").alias("low"), F.max_by("head", "at").alias("high"), F.first("weight").alias("weight")
    )
    between = F.col("low") + (F.col("high") - F.col("low")) * F.col("weight")
    return found.groupBy(F.col("g").alias(group)).agg(
        *[F.max(F.when(F.col("metric") == name, between / scale)).alias(name) for name, (_, scale) in metrics.items()]
    )


def _narrow(values: DataFrame, targets: DataFrame, shift: int, first: bool) -> DataFrame:
    """Extend each target's known leading bits by one digit."""
    head = F.shiftright("v", shift)
    inside = F.lit(True) if first else F.shiftright("v", shift + _DIGIT_BITS) == F.col("head")
    per_digit = (
        values.join(targets, ["g", "metric"])
        .filter(inside)
        .groupBy("g", "metric", "weight", "at", "rank", head.alias("next_head"))
        .agg(F.sum("n").alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("g", "metric", "at").orderBy("next_head"))
    return (
        per_digit.withColumn("before", upto - F.col("n"))
        .filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        .select("g", "metric", "weight", "at", (F.col("rank") - F.col("before")).alias("rank"), F.col("next_head").alias("head"))
    )
