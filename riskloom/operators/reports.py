"""Detail extracts, industry benchmarks, usage and dashboard aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.codes import employer_key, naics4, uuid_from_text
from riskloom.functions.dates import day, month_start, years_before
from riskloom.functions.labels import inspection_label, violation_label
from riskloom.operators.picks import at_latest_snapshot, greatest_row, page
from riskloom.operators.quantiles import exact_percentiles
from riskloom.types import FEEDBACK_TYPES

DETAIL_YEARS = 5


# --- detail extracts ---


def inspection_detail(inspections: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Recent inspections with the id of their employer."""
    key = employer_key(F.col("name_normalized"), F.col("site_state"), F.col("zip5"))
    recent = (F.length("name_normalized") > 1) & (F.col("open_date") >= years_before(as_of, DETAIL_YEARS))
    return inspections.filter(recent).select(
        "activity_nr",
        uuid_from_text(key).alias("employer_id"),
        F.col("estab_name").alias("employer_name"),
        "site_address", "site_city", "site_state", "zip5", "open_date", "close_case_date", "insp_type",
        "violation_count", "serious_count", "willful_count", "repeat_count", "other_count", "total_penalties",
        "avg_gravity",
    )


def violation_detail(violations: DataFrame, inspections: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Violations of recent inspections; missing counts become 0."""
    recent = inspections.filter(F.col("open_date") >= years_before(as_of, DETAIL_YEARS)).select("activity_nr")
    return violations.join(recent, "activity_nr").select(
        "activity_nr", "citation_id", "viol_type",
        F.coalesce("gravity", F.lit(0)).alias("gravity"),
        F.coalesce("nr_instances", F.lit(0)).alias("nr_instances"),
        "initial_penalty", "current_penalty", "abate_date", "issuance_date",
    )


def inspections_of(detail: DataFrame, employer_id: str, limit: int = 20, offset: int = 0) -> DataFrame:
    rows = detail.filter(F.col("employer_id") == employer_id)
    return page(rows, [F.desc_nulls_last("open_date"), F.asc("activity_nr")], limit, offset)


def violations_of(detail: DataFrame, activity_nr: str) -> DataFrame:
    """Violations of one inspection with labels, newest first."""
    return (
        detail.filter(F.col("activity_nr") == activity_nr)
        .withColumn("viol_type_label", violation_label(F.col("viol_type")))
        .orderBy(F.desc_nulls_last("issuance_date"), "citation_id")
    )


def nested_inspections(
    detail: DataFrame,
    violations: DataFrame,
    from_date: str | None = None,
    to_date: str | None = None,
    agency: str = "OSHA",
    page_size: int = 1000,
) -> DataFrame:
    """Inspections with their violations as arrays: one row per inspection and page of ``page_size`` distinct violations.

    Equal violations are counted rather than repeated. Pages number the violations
    in the order of their fields, nulls first; an inspection without any has page 0.
    """
    kept = detail
    if from_date:
        kept = kept.filter(F.col("open_date") >= day(from_date))
    if to_date:
        kept = kept.filter(F.col("open_date") <= day(to_date))
    fields = ["citation_id", "viol_type", "current_penalty", "issuance_date"]
    counted = violations.groupBy("activity_nr", *fields).agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(Window.partitionBy("activity_nr").orderBy(*fields))
    nested = (
        counted.withColumn("page", ((place - 1) / page_size).cast("int"))
        .groupBy("activity_nr", "page")
        .agg(F.array_sort(F.collect_list(F.struct(*fields, "times"))).alias("violations"))
    )
    return kept.join(nested, "activity_nr", "left").select(
        "employer_id", "activity_nr", F.lit(agency).alias("agency"), F.col("open_date").alias("inspection_date"),
        inspection_label(F.col("insp_type")).alias("insp_type_label"),
        F.coalesce("page", F.lit(0)).alias("page"), "violations",
    )


# --- industry ---


def industry_benchmark(profile: DataFrame) -> DataFrame:
    """Per NAICS prefix at the newest snapshot: employers, means, exact median penalty, tiers."""
    rows = at_latest_snapshot(profile).withColumn("naics_4digit", naics4(F.col("naics_code")))
    rows = rows.filter(F.col("naics_4digit").isNotNull())
    totals = rows.groupBy("naics_4digit").agg(
        F.count_distinct("employer_id").alias("employer_count"),
        F.avg("osha_inspections").alias("avg_inspections"),
        F.avg("osha_violations").alias("avg_violations"),
        F.avg(F.col("osha_total_penalties").cast("double")).alias("avg_penalties"),
        *[F.count_if(F.col("risk_tier") == t).alias(f"{t.lower()}_count") for t in ("HIGH", "ELEVATED", "MEDIUM", "LOW")],
    )
    medians = exact_percentiles(rows, "naics_4digit", {"median_penalties": (F.col("osha_total_penalties"), 1000)})
    return totals.join(medians, "naics_4digit", "left")


def industry_benchmark_extras(profile: DataFrame) -> DataFrame:
    """Medians of inspections, violations and penalties, and shares with willful or repeat findings."""
    rows = profile.filter(F.col("naics_4digit").isNotNull())
    shares = rows.groupBy("naics_4digit").agg(
        F.count(F.lit(1)).alias("employer_count"),
        F.avg((F.col("osha_willful_count") > 0).cast("int")).alias("pct_with_willful"),
        F.avg((F.col("osha_repeat_count") > 0).cast("int")).alias("pct_with_repeat"),
    )
    medians = exact_percentiles(
        rows,
        "naics_4digit",
        {
            "median_inspection_count": (F.col("osha_inspections"), 1),
            "median_violation_count": (F.col("osha_violations"), 1),
            "median_penalty_total": (F.col("osha_total_penalties"), 1000),
        },
    )
    return shares.join(medians, "naics_4digit", "left")


def industry_directory(profile: DataFrame) -> DataFrame:
    rows = at_latest_snapshot(profile).filter(F.col("naics_code").isNotNull())
    counted = rows.groupBy(naics4(F.col("naics_code")).alias("naics_4digit")).agg(
        F.count_distinct("employer_id").alias("employer_count")
    )
    return counted.orderBy(F.desc("employer_count"), "naics_4digit")


def industry_search(naics: DataFrame, sector: str | None = None, text: str | None = None) -> DataFrame:
    """Four-digit codes with one title each, by two-digit sector and title text."""
    rows = naics.filter(F.length("naics_code") >= 4)
    if sector:
        rows = rows.filter(F.col("naics_code").startswith(sector))
    if text:
        rows = rows.filter(F.lower("naics_title").contains(text.lower()))
    first_title = F.min_by("naics_title", "naics_code").alias("description")
    return rows.groupBy(naics4(F.col("naics_code")).alias("naics_4digit")).agg(first_title)


# --- usage and feedback ---


def monthly_usage(usage: DataFrame, keys: DataFrame) -> DataFrame:
    """Per key and month: requests, lookups and what the quota leaves by either count."""
    used = usage.groupBy("key_hash", month_start(F.col("queried_at")).cast("date").alias("month")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("lookup_count").alias("lookups")
    )
    limit = F.col("monthly_limit")
    return used.join(keys, "key_hash", "left").select(  # a key without a limit shows its usage all the same
        "key_hash", "month", "requests", "lookups", "monthly_limit",
        F.greatest(F.lit(0), limit - F.col("requests")).alias("remaining"),
        F.greatest(F.lit(0), limit - F.col("lookups")).alias("remaining_by_lookups"),
        (F.col("requests") >= limit).alias("quota_exceeded"),
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Accepted feedback per employer and type."""
    valid = feedback.filter(F.col("type").isin(FEEDBACK_TYPES))
    return valid.groupBy("employer_id", "type").agg(
        F.count(F.lit(1)).alias("reports"), F.count_distinct("customer_id").alias("customers")
    )


# --- windows, provenance, dashboard ---


def window_summary(inspections: DataFrame, as_of: dt.date | str, years: int = 5) -> DataFrame:
    """Per employer key: counts over the last 1 to 5 years."""
    if not 1 <= years <= 5:
        raise ValueError("years must be 1 to 5")
    key = employer_key(F.col("name_normalized"), F.col("site_state"), F.col("zip5"))
    recent = inspections.filter(
        F.col("name_normalized").isNotNull() & (F.col("open_date") >= years_before(as_of, years))
    )
    return recent.groupBy(key.alias("employer_key")).agg(
        F.count_distinct("activity_nr").alias("inspection_count"),
        F.sum("violation_count").alias("violation_count"),
        F.sum("total_penalties").alias("penalty_total"),
        F.sum("willful_count").alias("willful_count"),
        F.sum("repeat_count").alias("repeat_count"),
        F.sum("serious_count").alias("serious_count"),
    )


def provenance(inspections: DataFrame, wages: DataFrame) -> DataFrame:
    """Per employer key: records and date range of each agency, and whether both have records."""
    osha = inspections.select(
        employer_key(F.col("name_normalized"), F.col("site_state"), F.col("zip5")).alias("employer_key"),
        F.lit("OSHA").alias("agency"), F.col("open_date").alias("date"),
    )
    whd = wages.select(
        employer_key(F.col("name_normalized"), F.col("state"), F.col("zip5")).alias("employer_key"),
        F.lit("WHD").alias("agency"), F.col("findings_end_date").alias("date"),
    )
    rows = osha.unionByName(whd).filter(F.col("employer_key").isNotNull())

    def of(agency: str) -> list:
        mine = F.col("agency") == agency
        return [
            F.count_if(mine).alias(f"{agency.lower()}_records"),
            F.min(F.when(mine, F.col("date"))).alias(f"{agency.lower()}_first_date"),
            F.max(F.when(mine, F.col("date"))).alias(f"{agency.lower()}_last_date"),
        ]

    per_employer = rows.groupBy("employer_key").agg(*of("OSHA"), *of("WHD"))
    both = (F.col("osha_records") > 0) & (F.col("whd_records") > 0)
    return per_employer.withColumn("multi_agency_enforcement", both)


def top_violators(profile: DataFrame, k: int = 20) -> DataFrame:
    order = [F.desc("osha_violations"), F.desc("osha_total_penalties"), F.asc("employer_id")]
    return profile.orderBy(*order).limit(k).select(
        "employer_id", "employer_name", "state", "osha_violations", "osha_total_penalties", "risk_tier"
    )


def high_risk_by_industry(profile: DataFrame) -> DataFrame:
    rows = profile.filter(F.col("naics_4digit").isNotNull())
    return rows.groupBy("naics_4digit").agg(
        F.count(F.lit(1)).alias("employers"), F.count_if(F.col("risk_tier") == "HIGH").alias("high_risk")
    )


def risk_by_state(profile: DataFrame) -> DataFrame:
    tiers = ["HIGH", "ELEVATED", "MEDIUM", "LOW"]
    return profile.groupBy("state").agg(
        *[F.count_if(F.col("risk_tier") == t).alias(f"{t.lower()}_count") for t in tiers],
        F.avg("risk_score").alias("avg_risk_score"),
    )


def tier_trend(history: DataFrame) -> DataFrame:
    """Employers per snapshot and tier."""
    return history.groupBy("snapshot_date", "risk_tier").agg(F.count(F.lit(1)).alias("employers"))


def citations_by_month(violations: DataFrame) -> DataFrame:
    """Recently cited: violations and penalties per month of issuance."""
    month = month_start(F.col("issuance_date")).cast("date")
    owed = F.coalesce("current_penalty", "initial_penalty", F.lit(0))
    return violations.filter(F.col("issuance_date").isNotNull()).groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("violations"), F.sum(owed).alias("penalties")
    )


def watched_names(rows: DataFrame, name: str, companies: list[str], anywhere: bool = False) -> DataFrame:
    """One row per watched company that ``name`` starts with (or holds); the list is part of the expression."""
    def test(company: Column) -> Column:
        return F.contains(F.col(name), company) if anywhere else F.startswith(F.col(name), company)

    listed = F.array(*[F.lit(c) for c in companies])
    return rows.withColumn("company", F.explode(F.filter(listed, test)))


def best_per_prefix(profile: DataFrame, companies: list[str]) -> DataFrame:
    """Per watched prefix, the employer with the most inspections whose name starts with it."""
    rows = watched_names(profile, "name_normalized", companies).select(
        "company", "osha_inspections", "employer_id", "employer_name", "risk_tier"
    )
    return greatest_row(rows, ["company"], ["osha_inspections", "employer_id"])


def top_per_group(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """First ``k`` rows of each group; Spark cuts each group to ``k`` before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)
