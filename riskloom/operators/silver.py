"""Silver: normalised names, codes and per-inspection totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.address import address_key
from riskloom.functions.codes import MONEY, naics4, zip5
from riskloom.functions.labels import violation_severity, violation_type_label
from riskloom.functions.names import normalize_name, normalize_name_variant
from riskloom.session import stored


def _count_types(*codes: str) -> Column:
    return F.count_if(F.col("viol_type").isin(*codes))


def violation_rollup(violations: DataFrame) -> DataFrame:
    """One row per inspection. Every aggregate combines before the shuffle."""
    owed = F.coalesce("current_penalty", "initial_penalty", F.lit(0).cast(MONEY))
    return violations.groupBy("activity_nr").agg(
        F.count(F.lit(1)).alias("violation_count"),
        _count_types("W").alias("willful_count"),
        _count_types("R").alias("repeat_count"),
        _count_types("S").alias("serious_count"),
        _count_types("O", "U").alias("other_count"),
        F.sum(owed).alias("total_penalties"),
        F.avg("gravity").alias("avg_gravity"),
    )


def normalize_inspections(inspections: DataFrame, rollup: DataFrame) -> DataFrame:
    """Inspections with matching name, zip5, NAICS prefix, address key and violation totals.

    The roll-up is shuffled by ``activity_nr`` already; only the inspections
    move for the join. Repeated or missing activity numbers sit on the left
    side, where AQE can split them.
    """
    zip_code = zip5(F.col("site_zip"))
    totals = ["violation_count", "willful_count", "repeat_count", "serious_count", "other_count"]
    return inspections.join(rollup, "activity_nr", "left").select(
        "activity_nr", "estab_name",
        normalize_name(F.col("estab_name")).alias("name_normalized"),
        "site_address", "site_city", "site_state",
        zip_code.alias("zip5"),
        "naics_code",
        naics4(F.col("naics_code")).alias("naics_4digit"),
        "open_date", "close_case_date", "insp_type",
        address_key(F.col("site_address"), zip_code).alias("address_key"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in totals],
        F.coalesce("total_penalties", F.lit(0).cast(MONEY)).alias("total_penalties"),
        "avg_gravity",
    )


def normalize_wage_actions(actions: DataFrame) -> DataFrame:
    name = F.coalesce("trade_nm", "legal_name")
    return actions.filter(name.isNotNull()).select(
        "case_id",
        name.alias("employer_name"),
        normalize_name(name).alias("name_normalized"),
        "legal_name",
        F.col("street_addr_1_txt").alias("address"),
        F.col("city_nm").alias("city"),
        F.col("st_cd").alias("state"),
        zip5(F.col("zip_cd")).alias("zip5"),
        "naics_code_description", "findings_start_date", "findings_end_date",
        F.coalesce("bw_amt", F.lit(0).cast(MONEY)).alias("backwages"),
        F.coalesce("ee_violtd_cnt", F.lit(0)).alias("employees_violated"),
        address_key(F.col("street_addr_1_txt"), zip5(F.col("zip_cd"))).alias("address_key"),
    )


def normalize_mine_violations(violations: DataFrame, mines: DataFrame) -> DataFrame:
    """Violations with their mine. Each distinct name is cleaned once and joined back, however many violations bear it.

    Mines and cleaned names are stored first: their true size is known then, so that short lists
    go to the violations, which are not shuffled for them.
    """
    mines = stored(mines, "mines")
    name = F.coalesce("violator_name", "operator_name")
    names = violations.select(F.col("violator_name").alias("name")).union(mines.select("operator_name")).filter("name IS NOT NULL").distinct()
    # Dealt anew after the distinct: a short list of names would otherwise be cleaned in one task.
    cleaned = names.repartition("name").select("name", normalize_name(F.col("name")).alias("name_normalized"))
    cleaned = stored(cleaned, "mine-names")
    return (
        violations.join(mines, "mine_id", "left")
        .withColumn("name", name)
        .join(cleaned, "name")
        .select(
            "event_no", "mine_id", "violation_no", "violator_name", "name_normalized",
            "violation_date", "issue_date", "section_of_act", "sig_sub", "proposed_penalty", "amount_paid",
            "negligence", "mine_name", "mine_status", "operator_name", "controller_name", "state", "county",
        )
    )


def normalize_contractor_evaluations(evaluations: DataFrame) -> DataFrame:
    return evaluations.filter(F.col("contractor_name").isNotNull()).select(
        "contractor_name",
        normalize_name(F.col("contractor_name")).alias("name_normalized"),
        F.col("street").alias("address"), "city", "state",
        zip5(F.col("zip")).alias("zip5"),
        "naics_code", "date_received", "date_resolved", "resolution_type", "violations_found", "amount_of_relief",
        "class_members",
    )


def normalize_disclosures(disclosures: DataFrame) -> DataFrame:
    return disclosures.filter(F.col("employer_name").isNotNull()).select(
        "employer_name",
        normalize_name(F.col("employer_name")).alias("name_normalized"),
        "address", "city", "state", "zip5", "naics_code", "received_date", "decision_date", "case_status",
        "wage_offered", "prevailing_wage", "total_workers", "full_time_position", "visa_class", "job_title", "soc_code",
    )


def label_violations(violations: DataFrame) -> DataFrame:
    """Violations with label and severity; unknown codes get null, missing amounts 0."""
    code = F.col("viol_type")
    zero = F.lit(0).cast(MONEY)
    return violations.select(
        "activity_nr", "citation_id", "viol_type",
        violation_type_label(code).alias("viol_type_label"),
        violation_severity(code).alias("severity"),
        "issuance_date",
        F.coalesce("current_penalty", zero).alias("current_penalty"),
        F.coalesce("initial_penalty", zero).alias("initial_penalty"),
    )


def normalize_wage_actions_legal_first(actions: DataFrame) -> DataFrame:
    """Variant: legal name first, fuller name cleaning, only records with a tax number or back wages.

    ``actions`` are staged wage actions; an ``ein`` column is used when present.
    """
    ein = F.col("ein") if "ein" in actions.columns else F.lit(None).cast("string")
    name = F.coalesce("legal_name", "trade_nm")
    return (
        actions.withColumn("ein", ein)
        .filter(F.col("ein").isNotNull() | (F.col("bw_amt") > 0))
        .select(
            "case_id", "trade_nm", "legal_name",
            normalize_name_variant(name).alias("name_normalized"),
            "ein",
            F.col("bw_amt").alias("back_wages"),
            F.col("ee_violtd_cnt").alias("employees_owed"),
            F.col("street_addr_1_txt").alias("street_raw"),
            "city_nm",
            F.col("st_cd").alias("state"),
            zip5(F.col("zip_cd")).alias("zip5"),
            address_key(F.col("street_addr_1_txt"), zip5(F.col("zip_cd"))).alias("address_key"),
        )
    )
