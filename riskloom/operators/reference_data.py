"""Builders of lookup data: parent companies and industry titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.names import normalize_owner_name, seed_safe
from riskloom.types import PARENT_SEED_SCHEMA


def _first_by_priority(rows: DataFrame) -> DataFrame:
    """One row per pattern: the lowest priority number, then the least parent name."""
    kept = rows.groupBy("name_pattern").agg(F.min(F.struct("priority", "parent_name", "match_type")).alias("kept"))
    return kept.select("name_pattern", "kept.parent_name", "kept.match_type")


def build_parent_map(companies: DataFrame, links: DataFrame) -> DataFrame:
    """Pattern to parent: subsidiaries as exact patterns, then each owner as its own pattern.

    Of several owners of one subsidiary name the least is kept, so the result does
    not depend on the order of the feed.
    """
    named = companies.groupBy("id").agg(F.min("name").alias("name"))
    owner = named.select(F.col("id").alias("owner_id"), F.col("name").alias("parent_name"))
    asset = named.select(F.col("id").alias("asset_id"), F.col("name").alias("asset_name"))
    owned = links.join(owner, "owner_id")
    pattern, own = normalize_owner_name(F.col("asset_name")), normalize_owner_name(F.col("parent_name"))
    subsidiaries = (
        owned.join(asset, "asset_id")
        .select(pattern.alias("name_pattern"), own.alias("own"), "parent_name")
        .filter((F.col("name_pattern") != "") & (F.col("own") != "") & (F.col("name_pattern") != F.col("own")))
        .select("name_pattern", "parent_name", F.lit("exact").alias("match_type"), F.lit(1).alias("priority"))
    )
    owners = (
        owned.select("parent_name").distinct()
        .select(own.alias("name_pattern"), "parent_name", F.lit(None).cast("string").alias("match_type"), F.lit(2).alias("priority"))
        .filter(F.col("name_pattern") != "")
    )
    return _first_by_priority(subsidiaries.unionByName(owners))


def apply_overrides(parents: DataFrame, overrides: DataFrame) -> DataFrame:
    """Curated prefix patterns win over generated ones; characters unsafe in seeds are dropped."""
    curated = overrides.select("name_pattern", "parent_name", F.lit("prefix").alias("match_type"), F.lit(0).alias("priority"))
    generated = parents.select("name_pattern", "parent_name", "match_type", F.lit(1).alias("priority"))
    kept = _first_by_priority(curated.unionByName(generated))
    return kept.select(
        seed_safe(F.col("name_pattern")).alias("name_pattern"), seed_safe(F.col("parent_name")).alias("parent_name"), "match_type"
    )


def overrides_frame(spark: SparkSession, overrides: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(p, n, "prefix") for p, n in overrides], PARENT_SEED_SCHEMA)


def merge_naics(current: DataFrame, older: DataFrame, only_six_digits: bool = True) -> DataFrame:
    """Current titles, plus older codes that are not among them."""
    added = older.filter(F.length("naics_code") == 6) if only_six_digits else older
    added = added.filter(F.col("naics_code").isNotNull()).groupBy("naics_code").agg(F.min("naics_title").alias("naics_title"))
    missing = added.join(current.select("naics_code"), "naics_code", "left_anti")
    return current.select("naics_code", "naics_title").unionByName(missing.select("naics_code", "naics_title"))


def naics_stubs(profile: DataFrame, naics: DataFrame) -> DataFrame:
    """Stand-in titles for codes that profiles use and the list lacks."""
    used = profile.filter(F.col("naics_code").isNotNull()).select("naics_code").distinct()
    missing = used.join(naics.select("naics_code"), "naics_code", "left_anti")
    title = F.concat(F.lit("NAICS "), F.col("naics_code"), F.lit(" (pre-2022 code)"))
    return missing.select("naics_code", title.alias("naics_title"))
