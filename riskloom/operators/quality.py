"""Data-quality metrics and the publishing gate.

Every check is a row ``(check_name, severity, passed, value)``. Severity is
CRITICAL, WARNING or INFO; thresholds are parameters.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.codes import is_uuid
from riskloom.functions.dates import day

# --- Fixed values: thresholds of the production gate ---
MIN_ROWS = {
    "osha_inspections": (2_000_000, "CRITICAL"),
    "osha_violations": (300_000, "CRITICAL"),
    "whd_actions": (100_000, "WARNING"),
    "employer_profile": (500_000, "CRITICAL"),
}
OPTIONAL_TABLES = ["whd_actions"]
MAX_NULL_RATE = {
    "employer_name": 0.0, "employer_id": 0.0, "risk_tier": 0.0, "risk_score": 0.01, "state": 0.15, "zip5": 0.20,
    "naics_code": 0.30,
}
MAX_AGE_DAYS = 180
MIN_JOIN_RATE = 0.95
PROFILE_RATIO = (2.0, 20.0)
MIN_LOW_SHARE = 0.4
MAX_HIGH_SHARE = 0.05
MAX_TIER_CHANGE = 0.5
MAX_TOTAL_DROP = 0.1
MAX_DRIFT = 0.002
TIERS = ["HIGH", "ELEVATED", "MEDIUM", "LOW"]
# --- end of fixed values ---


class GateFailed(RuntimeError):
    """Raised when a CRITICAL check failed."""


def _row(check: str, severity: str, passed: Column, value: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check_name"),
        F.lit(severity).alias("severity"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        value.cast("double").alias("value"),
    )


def _rows(one_row: DataFrame, checks: list[Column]) -> DataFrame:
    """Unfold several checks over one row of aggregates."""
    return one_row.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def row_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(table, rows); a table that is not there counts 0. Each table is counted once, in parallel branches."""
    counted = []
    spark = next(t for t in tables.values() if t is not None).sparkSession
    for name, table in tables.items():
        if table is None:
            one = spark.range(1).select(F.lit(name).alias("table"), F.lit(0).cast("long").alias("rows"))
        else:
            one = table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        counted.append(one)
    return reduce(DataFrame.unionByName, counted)


def minimum_rows(
    tables: dict[str, DataFrame | None],
    limits: dict[str, tuple[int, str]] = MIN_ROWS,
    optional: list[str] = OPTIONAL_TABLES,
) -> DataFrame:
    counts = row_counts({name: tables.get(name) for name in limits})
    limit = reduce(
        lambda col, item: col.when(F.col("table") == item[0], item[1][0]), list(limits.items())[1:],
        F.when(F.col("table") == list(limits)[0], list(limits.values())[0][0]),
    )
    severity = reduce(
        lambda col, item: col.when(F.col("table") == item[0], item[1][1]), list(limits.items())[1:],
        F.when(F.col("table") == list(limits)[0], list(limits.values())[0][1]),
    )
    unused = F.col("table").isin(optional) & (F.col("rows") == 0)
    return counts.select(
        F.concat(F.lit("min_rows_"), F.col("table")).alias("check_name"),
        severity.alias("severity"),
        (unused | (F.col("rows") > limit)).alias("passed"),
        F.col("rows").cast("double").alias("value"),
    )


def freshness(raw_inspections: DataFrame, as_of: dt.date | str, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    newest = raw_inspections.agg(F.max(F.col("open_date").cast("date")).alias("newest"))
    age = F.date_diff(day(as_of), F.col("newest"))
    return _rows(newest, [_row("latest_inspection_age_days", "WARNING", age < max_age_days, age)])


def join_rate(violations: DataFrame, inspections: DataFrame, min_rate: float = MIN_JOIN_RATE) -> DataFrame:
    """Share of violations that find an inspection.

    ``violation_join_rate`` counts joined rows, so a repeated inspection raises it;
    ``violation_match_rate`` counts violations. Both sides are counted per number
    first, so a number with millions of rows joins as one.
    """
    per_violation = violations.groupBy("activity_nr").agg(F.count(F.lit(1)).alias("n"))
    per_inspection = inspections.groupBy("activity_nr").agg(F.count(F.lit(1)).alias("m"))
    totals = per_violation.join(per_inspection, "activity_nr", "left").agg(
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.coalesce("m", F.lit(0))).alias("joined"),
        F.sum(F.when(F.col("m").isNotNull(), F.col("n")).otherwise(0)).alias("matched"),
    )
    joined, matched = F.try_divide("joined", "total"), F.try_divide("matched", "total")
    return _rows(
        totals,
        [
            _row("violation_join_rate", "CRITICAL", joined > min_rate, joined),
            _row("violation_match_rate", "INFO", F.lit(True), matched),
        ],
    )


def profile_ratio(
    raw_inspections: DataFrame, profile: DataFrame, bounds: tuple[float, float] = PROFILE_RATIO
) -> DataFrame:
    counts = profile.agg(F.count(F.lit(1)).alias("profiles")).withColumn(
        "inspections", raw_inspections.agg(F.count(F.lit(1))).scalar()
    )
    ratio = F.try_divide("inspections", "profiles")
    return _rows(counts, [_row("inspections_per_profile", "WARNING", (ratio > bounds[0]) & (ratio < bounds[1]), ratio)])


def null_rates(profile: DataFrame, limits: dict[str, float] = MAX_NULL_RATE) -> DataFrame:
    """One pass over all columns. A limit of 0 is critical."""
    present = {c: limit for c, limit in limits.items() if c in profile.columns}
    rates = profile.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in present])
    checks = [
        _row(f"null_rate_{c}", "CRITICAL" if limit == 0 else "WARNING", F.col(c) <= limit, F.col(c))
        for c, limit in present.items()
    ]
    return _rows(rates, checks)


def tier_distribution(profile: DataFrame) -> DataFrame:
    counts = profile.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("risk_tier") == t).alias(t) for t in TIERS]
    )
    low, high = F.try_divide("LOW", "total"), F.try_divide("HIGH", "total")
    return _rows(
        counts,
        [
            *[_row(f"risk_tier_{t}", "INFO", F.lit(True), F.col(t)) for t in TIERS],
            _row("has_high_risk", "CRITICAL", F.col("HIGH") > 0, F.col("HIGH")),
            _row("low_share", "CRITICAL", low >= MIN_LOW_SHARE, low),
            _row("high_share", "WARNING", high < MAX_HIGH_SHARE, high),
        ],
    )


def run_over_run(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Changes of tier counts and of the total between two metric sets ``(check_name, value)``."""
    now = current.select("check_name", F.col("value").alias("now"))
    before = previous.select("check_name", F.col("value").alias("before")).filter(F.col("before") > 0)
    change = (F.col("now") - F.col("before")) / F.col("before")
    is_total = F.col("check_name") == "employer_profile_count"
    compared = now.join(before, "check_name").filter(F.col("check_name").startswith("risk_tier_") | is_total)
    return compared.select(
        F.concat("check_name", F.lit("_change")).alias("check_name"),
        F.when(is_total, "CRITICAL").otherwise("WARNING").alias("severity"),
        F.when(is_total, change > -MAX_TOTAL_DROP).otherwise(F.abs(change) < MAX_TIER_CHANGE).alias("passed"),
        change.alias("value"),
    )


def profile_metrics(profile: DataFrame) -> DataFrame:
    """(check_name, value) counts that the next run compares itself with."""
    counts = profile.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("risk_tier") == t).alias(t) for t in TIERS]
    )
    checks = [_row("employer_profile_count", "INFO", F.lit(True), F.col("total"))]
    checks += [_row(f"risk_tier_{t}", "INFO", F.lit(True), F.col(t)) for t in TIERS]
    return _rows(counts, checks).select("check_name", "value")


def with_profile_metrics(checks: DataFrame, profile: DataFrame) -> DataFrame:
    """The checks and those metrics of the profile that are not among them, each name once."""
    more = profile_metrics(profile).join(checks.select("check_name"), "check_name", "left_anti")
    return checks.unionByName(more, allowMissingColumns=True)


def id_validity(profile: DataFrame) -> DataFrame:
    bad = profile.agg(F.count_if(~is_uuid(F.col("employer_id"))).alias("bad"))
    return _rows(bad, [_row("invalid_employer_ids", "CRITICAL", F.col("bad") == 0, F.col("bad"))])


def parent_match_rate(profile: DataFrame) -> DataFrame:
    counts = profile.agg(F.count("parent_name").alias("matched"), F.count(F.lit(1)).alias("total"))
    rate = F.round(F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)), 4)
    return _rows(
        counts,
        [
            _row("parent_company_matches", "INFO", F.lit(True), F.col("matched")),
            _row("parent_company_match_rate", "INFO", F.lit(True), rate),
        ],
    )


def publish_drift(source: DataFrame, published: DataFrame, max_drift: float = MAX_DRIFT) -> DataFrame:
    """Row counts before and after publishing; an empty side fails."""
    counts = source.agg(F.count(F.lit(1)).alias("a")).withColumn("b", published.agg(F.count(F.lit(1))).scalar())
    drift = F.try_divide(F.abs(F.col("a") - F.col("b")), F.col("a"))
    passed = (F.col("a") > 0) & (F.col("b") > 0) & (drift <= max_drift)
    return _rows(counts, [_row("publish_drift", "CRITICAL", passed, drift)])


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once and the rows beyond the first."""
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    counts = repeated.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))
    return _rows(
        counts,
        [
            _row(f"repeated_{key}", "INFO", F.lit(True), F.col("keys")),
            _row(f"repeated_{key}_rows", "INFO", F.lit(True), F.col("extra")),
        ],
    )


def gate_checks(
    tables: dict[str, DataFrame | None],
    profile: DataFrame,
    as_of: dt.date | str,
    previous_metrics: DataFrame | None = None,
    limits: dict[str, tuple[int, str]] = MIN_ROWS,
) -> DataFrame:
    """All checks of one run."""
    raw = tables["osha_inspections"]
    parts = [
        minimum_rows({**tables, "employer_profile": profile}, limits),
        freshness(raw, as_of),
        join_rate(tables["osha_violations"], raw),
        profile_ratio(raw, profile),
        null_rates(profile),
        tier_distribution(profile),
        id_validity(profile),
        parent_match_rate(profile),
    ]
    if previous_metrics is not None:
        parts.append(run_over_run(profile_metrics(profile), previous_metrics))
    return reduce(DataFrame.unionByName, parts)


def gate_failures(checks: DataFrame) -> DataFrame:
    return checks.filter((F.col("severity") == "CRITICAL") & ~F.col("passed"))


def enforce_gate(checks: DataFrame) -> None:
    """Raise when a critical check failed. Reads back at most one row per critical check."""
    failed = gate_failures(checks).collect()
    if failed:
        raise GateFailed("; ".join(f"{row['check_name']} = {row['value']}" for row in failed))
