"""Snapshots over time: history, retention, change feed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.dates import day, sunday_based_weekday, years_before
from riskloom.operators.reports import top_per_group

HISTORY_COLUMNS = ["employer_id", "snapshot_date", "risk_tier", "risk_score", "confidence_tier", "trend_signal"]


def risk_history(
    history: DataFrame,
    profile: DataFrame,
    limit: int | None = None,
    employer_id: str | None = None,
    from_date: str | None = None,
    to_date: str | None = None,
) -> DataFrame:
    """Snapshots per employer, with ``limit`` the newest so many; employers without history show their profile snapshots."""
    if employer_id:
        history = history.filter(F.col("employer_id") == employer_id)
        profile = profile.filter(F.col("employer_id") == employer_id)
    fallback = profile.join(history.select("employer_id").distinct(), "employer_id", "left_anti")
    rows = history.select(*HISTORY_COLUMNS).unionByName(fallback.select(*HISTORY_COLUMNS))
    if from_date:
        rows = rows.filter(F.col("snapshot_date") >= day(from_date))
    if to_date:
        rows = rows.filter(F.col("snapshot_date") <= day(to_date))
    return rows if limit is None else top_per_group(rows, "employer_id", [F.desc("snapshot_date")], limit).drop("rank")


def new_history_rows(profile: DataFrame, history: DataFrame | None) -> DataFrame:
    """Rows of the newest snapshot that history does not hold yet: appending twice changes nothing."""
    newest = profile.filter(F.col("snapshot_date") == profile.agg(F.max("snapshot_date")).scalar())
    rows = newest.select(*HISTORY_COLUMNS, *[c for c in ["pipeline_run_id"] if c in profile.columns])
    if history is None:
        return rows
    date = newest.agg(F.max("snapshot_date")).first()[0]  # a literal, so that one partition of the history is read
    history = history.filter(F.col("snapshot_date") == F.lit(date))
    return rows.join(history.select("employer_id", "snapshot_date"), ["employer_id", "snapshot_date"], "left_anti")


def kept_by_retention(snapshot_date: Column, as_of: dt.date | str) -> Column:
    """All days for 90 days, Sundays for a year, firsts of a month for three years."""
    first = F.dayofmonth(snapshot_date) == 1
    sunday = sunday_based_weekday(snapshot_date) == 0
    return (
        F.when(first, snapshot_date >= years_before(as_of, 3))
        .when(sunday, snapshot_date >= years_before(as_of, 1))
        .otherwise(snapshot_date >= F.date_sub(day(as_of), 90))
    )


def retained_history(history: DataFrame, as_of: dt.date | str) -> DataFrame:
    """A filter on the partition column: whole partitions are kept or pruned."""
    return history.filter(kept_by_retention(F.col("snapshot_date"), as_of))


def tier_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Employers whose tier differs between two snapshots; a missing tier counts as ''."""
    old = previous.select("employer_id", F.col("risk_tier").alias("old_tier"))
    changed = F.coalesce("risk_tier", F.lit("")) != F.coalesce("old_tier", F.lit(""))
    return (
        current.join(old, "employer_id")
        .filter(changed)
        .select("employer_id", "employer_name", F.col("risk_tier").alias("new_tier"), "old_tier", "snapshot_date")
    )


def change_events(changes: DataFrame, subscriptions: DataFrame, event: str = "risk_tier_change") -> DataFrame:
    """One event per change and active subscription that watches the employer and wants this kind of event."""
    watching = (
        subscriptions.filter((F.col("status") == "active") & F.array_contains("events", event))
        .select(F.col("id").alias("subscription_id"), "customer_id", F.explode(F.array_distinct("employer_ids")).alias("employer_id"))
    )
    payload = F.struct(
        F.lit(event).alias("event"), F.col("employer_id"), F.col("employer_name"),
        F.col("old_tier").alias("previous_risk_tier"), F.col("new_tier").alias("new_risk_tier"), F.col("snapshot_date"),
        F.concat(F.lit("/v1/employers/"), F.col("employer_id"), F.lit("/risk-history")).alias("details_url"),
    )
    return changes.join(watching, "employer_id").select("subscription_id", "customer_id", "employer_id", payload.alias("payload"))
