"""Audit of linkage clusters and review samples.

Clusters meet inspections by sorted joins: Spark would broadcast either of them by the size of files that compress well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.names import first_word
from riskloom.operators.picks import greatest_row, repeatable_sample
from riskloom.operators.reports import watched_names

# --- Fixed values: watched companies and report sizes ---
WATCHED_COMPANIES = [
    "WALMART", "AMAZON", "TARGET", "MCDONALDS", "STARBUCKS", "HOME DEPOT", "LOWES", "COSTCO", "KROGER",
    "DOLLAR GENERAL", "FEDEX", "TYSON", "CARGILL", "WASTE MANAGEMENT", "TESLA",
]
SAMPLED_COMPANIES = [
    "WALMART", "AMAZON", "TARGET", "HOME DEPOT", "MCDONALDS", "FEDEX", "TYSON", "TESLA", "COSTCO", "DOLLAR GENERAL",
]
MAX_FIRST_WORDS = 3
MAX_CLUSTERS_PER_NAME = 5
SAMPLE_COLUMNS = [
    "employer_id", "employer_name", "name_normalized", "state", "zip5", "naics_code", "osha_inspections",
    "osha_violations", "osha_total_penalties", "risk_tier", "risk_score", "osha_last_inspection_date",
]
# --- end of fixed values ---


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))


def cluster_histogram(clusters: DataFrame) -> DataFrame:
    """Clusters and records per size class."""
    n = F.col("members")
    size_class = (
        F.when(n == 1, "1").when(n == 2, "2").when(n <= 10, "3-10").when(n <= 50, "11-50").when(n <= 100, "51-100").otherwise(">100")
    )
    return cluster_sizes(clusters).groupBy(size_class.alias("size_class")).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("members").alias("records"), F.count_if(n > 50).alias("over_50")
    )


def over_merged(clusters: DataFrame, inspections: DataFrame, largest: int | None = None) -> DataFrame:
    """Clusters whose names begin with more than three different words; ``largest`` looks at so many of the largest only."""
    sizes = cluster_sizes(clusters)
    if largest is not None:
        sizes = sizes.orderBy(F.desc("members"), "cluster_id").limit(largest)
    members = clusters.join(sizes.hint("merge"), "cluster_id")
    named = members.join(
        inspections.select(F.col("activity_nr").alias("unique_id"), "estab_name", "site_state").hint("merge"), "unique_id"
    )
    flags = named.groupBy("cluster_id", "members").agg(
        F.count_distinct(first_word(F.col("estab_name"))).alias("first_words"),
        F.count_distinct("estab_name").alias("names"),
        F.count_distinct("site_state").alias("states"),
    )
    return flags.filter(F.col("first_words") > MAX_FIRST_WORDS)


def under_merged(clusters: DataFrame, inspections: DataFrame, k: int | None = None) -> DataFrame:
    """Names spread over more than five clusters; with ``k``, that many of the most spread, in their order."""
    named = inspections.filter(F.length("name_normalized") > 3).select(
        F.col("activity_nr").alias("unique_id"), "name_normalized"
    )
    spread = (
        clusters.join(named.hint("merge"), "unique_id")
        .groupBy("name_normalized")
        .agg(F.count_distinct("cluster_id").alias("cluster_count"), F.count_distinct("unique_id").alias("record_count"))
    )
    spread = spread.filter(F.col("cluster_count") > MAX_CLUSTERS_PER_NAME)
    return spread if k is None else spread.orderBy(F.desc("cluster_count"), "name_normalized").limit(k)


def watch_list(clusters: DataFrame, inspections: DataFrame, companies: list[str] = WATCHED_COMPANIES) -> DataFrame:
    """Per watched company: clusters, inspections and states of the names that hold it."""
    named = watched_names(inspections, "name_normalized", companies, anywhere=True).select(
        "company", F.col("activity_nr").alias("unique_id"), "site_state"
    )
    counted = (
        named.join(clusters.hint("merge"), "unique_id", "left")
        .groupBy("company")
        .agg(
            F.count_distinct("cluster_id").alias("clusters"),
            F.count_distinct("unique_id").alias("inspections"),
            F.count_distinct("site_state").alias("states"),
        )
    )
    return counted.withColumn("split", F.col("clusters") > F.col("inspections") * 0.8)


def coverage(clusters: DataFrame, inspections: DataFrame, profile: DataFrame) -> DataFrame:
    """Share of inspections in clusters and inspections per profile."""
    counts = inspections.agg(F.count(F.lit(1)).alias("inspections")).withColumns(
        {
            "in_clusters": clusters.agg(F.count(F.lit(1))).scalar(),
            "profiles": profile.agg(F.count(F.lit(1))).scalar(),
        }
    )
    return counts.withColumn("coverage", F.try_divide("in_clusters", "inspections")).withColumn(
        "compression_ratio", F.try_divide("inspections", "profiles")
    )


def review_sample(profile: DataFrame, companies: list[str] = SAMPLED_COMPANIES, seed: int = 0) -> DataFrame:
    """Employers to check by hand: watched companies, riskiest HIGH, some MEDIUM, some inspected LOW."""
    rows = profile.select(*SAMPLE_COLUMNS)
    known = greatest_row(
        watched_names(rows, "name_normalized", companies), ["company"], ["osha_inspections", "employer_id"]
    ).withColumn("stratum", F.lit("known")).drop("company")
    high = (
        rows.filter(F.col("risk_tier") == "HIGH").orderBy(F.desc("risk_score"), "employer_id").limit(10)
        .withColumn("stratum", F.lit("high"))
    )
    medium = repeatable_sample(rows.filter(F.col("risk_tier") == "MEDIUM"), "employer_id", 5, seed).withColumn(
        "stratum", F.lit("medium")
    )
    quiet = rows.filter((F.col("risk_tier") == "LOW") & (F.col("osha_inspections") >= 1))
    low = repeatable_sample(quiet, "employer_id", 5, seed).withColumn("stratum", F.lit("low"))
    return known.unionByName(high).unionByName(medium).unionByName(low)
