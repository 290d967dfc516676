"""The nightly build as one driver program: silver once, gold once, gate, publish."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import quality, reports, silver, staging
from riskloom.operators.profile import build_profile
from riskloom.sources.publishing import (
    append_history, materialize, publish, read_previous_metrics, read_published, serving_rows, write_metrics,
)
from riskloom.sources.snapshots import read_latest


@dataclass
class Layout:
    """Folders of one installation, on a file system every executor reaches."""

    bronze: str
    silver: str
    gold: str
    serving: str
    history: str
    metrics: str


REQUIRED = ["osha_inspections", "osha_violations", "whd_actions", "msha_mines", "msha_violations"]
OPTIONAL = ["ofccp_evaluations", "oflc_disclosure"]


def build_silver(spark: SparkSession, layout: Layout, dedupe: bool = True) -> dict[str, DataFrame]:
    """Stage and normalise the newest snapshots and write them once: gate, publishing and extracts re-read them."""
    raw = {source: read_latest(spark, layout.bronze, source) for source in REQUIRED}
    missing = [source for source, rows in raw.items() if rows is None]
    if missing:
        raise FileNotFoundError(f"no snapshot of: {', '.join(missing)}")
    staged = {
        "inspections": (staging.stage_inspections(raw["osha_inspections"]), ["activity_nr"]),
        "violations": (staging.stage_violations(raw["osha_violations"]), ["activity_nr", "citation_id"]),
        "wages": (staging.stage_wage_actions(raw["whd_actions"]), ["case_id"]),
        "mines": (staging.stage_mines(raw["msha_mines"]), ["mine_id"]),
        "mine_violations": (staging.stage_mine_violations(raw["msha_violations"]), ["event_no", "violation_no"]),
    }
    if dedupe:  # a resumed download repeats records of any source
        staged = {name: (staging.drop_repeats(rows, keys), keys) for name, (rows, keys) in staged.items()}
    inspections, violations, wages, mines, mine_violations = (rows for rows, _ in staged.values())
    tables = {
        "inspections": silver.normalize_inspections(inspections, silver.violation_rollup(violations)),
        "wages": silver.normalize_wage_actions(wages),
        "mine_violations": silver.normalize_mine_violations(mine_violations, mines),
        "violations": violations,
    }
    contractors, disclosures = (read_latest(spark, layout.bronze, source) for source in OPTIONAL)
    if contractors is not None:
        tables["contractors"] = silver.normalize_contractor_evaluations(staging.stage_contractor_evaluations(contractors))
    if disclosures is not None:
        tables["disclosures"] = silver.normalize_disclosures(staging.stage_disclosures(disclosures))
    return {name: materialize(rows, f"{layout.silver}/{name}") for name, rows in tables.items()}


def run_nightly(
    spark: SparkSession,
    layout: Layout,
    parents: DataFrame,
    naics: DataFrame,
    as_of: dt.date | str,
    run_id: str,
    limits: dict[str, tuple[int, str]] = quality.MIN_ROWS,
) -> DataFrame:
    """Build, check and publish one snapshot; raises GateFailed before anything is published."""
    tables = build_silver(spark, layout)
    profile = materialize(
        build_profile(tables["inspections"], tables["wages"], tables["mine_violations"], parents, naics, as_of),
        f"{layout.gold}/employer_profile",
    )
    raw = {source: read_latest(spark, layout.bronze, source) for source in REQUIRED}
    checks = materialize(
        quality.gate_checks(raw, profile, as_of, read_previous_metrics(spark, layout.metrics, as_of), limits),
        f"{layout.gold}/gate_checks",
    )
    write_metrics(quality.with_profile_metrics(checks, profile), layout.metrics, as_of)
    quality.enforce_gate(checks)
    served = serving_rows(profile, as_of, run_id)
    publish(served, layout.serving, run_id, as_of)
    published = read_published(spark, layout.serving)
    append_history(published, layout.history)
    materialize(reports.inspection_detail(tables["inspections"], as_of), f"{layout.serving}_details/inspections")
    materialize(reports.violation_detail(tables["violations"], tables["inspections"], as_of), f"{layout.serving}_details/violations")
    quality.enforce_gate(quality.publish_drift(profile, published))
    return published
