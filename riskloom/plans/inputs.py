"""The layers from raw records to the served profile, built on demand over one data folder.

As in a nightly run, silver, profile and serving table are written once and read
back by whatever needs them; a session writes each of them at most once per folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import history, linkage, profile, silver, staging
from riskloom.plans import fixtures
from riskloom.plans.oracle import AS_OF
from riskloom.session import scratch_path
from riskloom.sources.layout import write_clustered
from riskloom.sources.name_index import add_to_index
from riskloom.sources.publishing import materialize, serving_rows

SNAPSHOTS = {"1999-08-01": "run-1", "2000-08-01": "run-2", AS_OF: "run-3"}

# (application, data folder, table) -> path of the written table
_WRITTEN: dict[tuple[str, str, str], str] = {}


class Inputs:
    """Lazy DataFrames; nothing runs until a caller acts on one."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return fixtures.fixture(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def written(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table ``name``, written on first use."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            path = scratch_path(self.spark, name)
            materialize(build(), path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    @cached_property
    def stg_inspections(self) -> DataFrame:
        return staging.stage_inspections(self.raw("raw_osha_inspections"))

    @cached_property
    def stg_violations(self) -> DataFrame:
        return staging.stage_violations(self.raw("raw_osha_violations"))

    @cached_property
    def stg_wages(self) -> DataFrame:
        return staging.stage_wage_actions(self.raw("raw_whd_actions"))

    @cached_property
    def stg_mines(self) -> DataFrame:
        return staging.stage_mines(self.raw("raw_msha_mines"))

    @cached_property
    def stg_mine_violations(self) -> DataFrame:
        return staging.stage_mine_violations(self.raw("raw_msha_violations"))

    @cached_property
    def stg_contractors(self) -> DataFrame:
        return staging.stage_contractor_evaluations(self.raw("raw_ofccp_evaluations"))

    @cached_property
    def stg_disclosures(self) -> DataFrame:
        return staging.stage_disclosures(self.raw("raw_oflc_disclosure"))

    def build_osha(self) -> DataFrame:
        return silver.normalize_inspections(self.stg_inspections, silver.violation_rollup(self.stg_violations))

    def build_whd(self) -> DataFrame:
        return silver.normalize_wage_actions(self.stg_wages)

    def build_msha(self) -> DataFrame:
        return silver.normalize_mine_violations(self.stg_mine_violations, self.stg_mines)

    @cached_property
    def osha(self) -> DataFrame:
        return self.written("inspection_norm", self.build_osha)

    @cached_property
    def whd(self) -> DataFrame:
        return self.written("whd_norm", self.build_whd)

    @cached_property
    def msha(self) -> DataFrame:
        return self.written("msha_norm", self.build_msha)

    @cached_property
    def parents(self) -> DataFrame:
        return self.raw("parent_companies")

    @cached_property
    def naics(self) -> DataFrame:
        return self.raw("naics_2022")

    @cached_property
    def keys(self) -> DataFrame:
        return profile.employer_keys(self.osha, self.whd)

    @cached_property
    def base(self) -> DataFrame:
        return profile.employer_base(self.osha, self.whd, self.msha, AS_OF)

    def build_profile(self, as_of: str) -> DataFrame:
        return profile.build_profile(self.osha, self.whd, self.msha, self.parents, self.naics, as_of)

    def build_profile_base(self) -> DataFrame:
        return profile.profile_base(self.osha, self.whd, self.msha, self.parents, self.naics, list(SNAPSHOTS))

    def profile_at(self, as_of: str) -> DataFrame:
        """The profile of a snapshot; what needs other rows is written once for all of them."""
        return profile.profile_on(self.written("employer_profile_base", self.build_profile_base), as_of)

    @cached_property
    def profile(self) -> DataFrame:
        return self.profile_at(AS_OF)

    def served_at(self, as_of: str) -> DataFrame:
        return self.written(f"served-{as_of}", lambda: self.build_served(as_of))

    def build_served(self, as_of: str) -> DataFrame:
        with_ein = self.profile_at(as_of).withColumn(
            "ein", F.concat(F.lit("EIN-"), F.left(F.md5("name_normalized"), F.lit(4)))
        )
        return serving_rows(with_ein, as_of, SNAPSHOTS[as_of], extra=["ein"])

    def indexed_at(self, day: str) -> DataFrame:
        """The serving rows of a snapshot for the name index, which reads their names only: older tables are not written just for it."""
        wanted = day == AS_OF or (self.spark.sparkContext.applicationId, self.sf_dir, f"served-{day}") in _WRITTEN
        return self.served_at(day) if wanted else self.build_served(day)

    @cached_property
    def served(self) -> DataFrame:
        return self.served_at(AS_OF)

    def clustered(self, key: str) -> str:
        """Folder of the served profile clustered by ``key``."""
        place = (self.spark.sparkContext.applicationId, self.sf_dir, f"served-by-{key}")
        if place not in _WRITTEN:
            path = scratch_path(self.spark, f"served-by-{key}")
            write_clustered(self.served, path, key, rows_per_file=2_000)
            _WRITTEN[place] = path
        return _WRITTEN[place]

    @cached_property
    def name_index(self) -> str:
        """Folder of the name index of the served profile, one delta per snapshot."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "name_index")
        if key not in _WRITTEN:
            path = scratch_path(self.spark, "name_index")
            for day in SNAPSHOTS:
                add_to_index(self.indexed_at(day), path)
            _WRITTEN[key] = path
        return _WRITTEN[key]

    @cached_property
    def history(self) -> DataFrame:
        parts = [self.served_at(day).select(*history.HISTORY_COLUMNS) for day in SNAPSHOTS]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    @cached_property
    def records(self) -> DataFrame:
        return linkage.linkage_input(self.osha, self.whd)

    @cached_property
    def clusters(self) -> DataFrame:
        return self.written("employer_clusters", lambda: linkage.cluster_records(self.records))
