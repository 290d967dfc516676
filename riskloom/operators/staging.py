"""Staging: projection, casts and row filters over raw records.

All of it is one narrow projection per source, so filters and columns reach the scan.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.codes import MONEY, zip5
from riskloom.functions.dates import us_date


def _date(name: str, strict: bool = True) -> Column:
    column = F.col(name)
    return (column.cast("date") if strict else column.try_cast("date")).alias(name)


def _whole(name: str) -> Column:
    """Integer text; a fraction is rounded half away from zero, other text fails."""
    return F.round(F.col(name).cast("decimal(18,3)")).cast("int")


def _amount_or_zero(name: str, tolerant: bool = False) -> Column:
    column = F.col(name)
    amount = column.try_cast(MONEY) if tolerant else column.cast(MONEY)
    return F.coalesce(amount, F.lit(0).cast(MONEY))


def stage_inspections(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("estab_name").isNotNull()).select(
        "activity_nr", "estab_name", "site_address", "site_city", "site_state", "site_zip", "naics_code",
        _date("open_date"), _date("close_case_date"), "insp_type", "owner_type",
    )


def stage_violations(raw: DataFrame) -> DataFrame:
    return raw.select(
        "activity_nr", "citation_id", "viol_type",
        _whole("gravity").alias("gravity"),
        _whole("nr_instances").alias("nr_instances"),
        F.col("initial_penalty").cast(MONEY).alias("initial_penalty"),
        F.col("current_penalty").cast(MONEY).alias("current_penalty"),
        _date("abate_date"), _date("issuance_date"),
    )


def stage_wage_actions(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("trade_nm").isNotNull() | F.col("legal_name").isNotNull()).select(
        "case_id", "trade_nm", "legal_name", "street_addr_1_txt", F.col("cty_nm").alias("city_nm"), "st_cd", "zip_cd",
        "naics_code_description", _date("findings_start_date"), _date("findings_end_date"),
        _amount_or_zero("bw_atp_amt").alias("bw_amt"),
        F.coalesce(_whole("ee_violtd_cnt"), F.lit(0)).alias("ee_violtd_cnt"),
    )


def stage_mines(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("MINE_ID").alias("mine_id"),
        F.col("CURRENT_MINE_NAME").alias("mine_name"),
        F.col("CURRENT_MINE_STATUS").alias("mine_status"),
        F.col("CURRENT_OPERATOR_NAME").alias("operator_name"),
        F.col("CURRENT_CONTROLLER_NAME").alias("controller_name"),
        F.col("STATE").alias("state"),
        F.col("FIPS_CNTY_NM").alias("county"),
        F.col("PRIMARY_SIC").alias("sic_code"),
        F.col("LATITUDE").cast("double").alias("latitude"),
        F.col("LONGITUDE").cast("double").alias("longitude"),
    )


def stage_mine_violations(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("EVENT_NO").alias("event_no"),
        F.col("MINE_ID").alias("mine_id"),
        F.col("VIOLATION_NO").alias("violation_no"),
        F.col("VIOLATOR_NAME").alias("violator_name"),
        us_date(F.col("VIOLATION_OCCUR_DT")).alias("violation_date"),
        us_date(F.col("VIOLATION_ISSUE_DT")).alias("issue_date"),
        F.col("SECTION_OF_ACT").alias("section_of_act"),
        F.col("SIG_SUB").alias("sig_sub"),
        _amount_or_zero("PROPOSED_PENALTY", tolerant=True).alias("proposed_penalty"),
        _amount_or_zero("AMOUNT_PAID", tolerant=True).alias("amount_paid"),
        F.col("NEGLIGENCE").alias("negligence"),
    )


def stage_contractor_evaluations(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("contractor_name").isNotNull()).select(
        "contractor_name", "street", "city", "state", "zip", "naics_code",
        _date("date_received"), _date("date_resolved"), "resolution_type", "violations_found",
        _amount_or_zero("amount_of_relief").alias("amount_of_relief"),
        F.coalesce(_whole("number_of_class_members"), F.lit(0)).alias("class_members"),
    )


def stage_disclosures(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("employer_name").isNotNull()).select(
        "employer_name",
        F.col("employer_address1").alias("address"),
        F.col("employer_city").alias("city"),
        F.col("employer_state").alias("state"),
        zip5(F.col("employer_postal_code")).alias("zip5"),
        "naics_code", _date("received_date"), _date("decision_date"), "case_status",
        _amount_or_zero("wage_rate_of_pay_from").alias("wage_offered"),
        _amount_or_zero("prevailing_wage").alias("prevailing_wage"),
        F.coalesce(_whole("total_workers"), F.lit(0)).alias("total_workers"),
        "full_time_position", "visa_class", "job_title", "soc_code", "soc_title",
    )


def drop_repeats(staged: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key for sources that repeat records after a resumed download.

    The greatest row in column order is kept: ``max`` over a struct combines
    map-side, so a key repeated millions of times stays cheap. A row whose key
    holds a null names no record, so it repeats none: all such rows stay.
    """
    rest = [c for c in staged.columns if c not in keys]
    whole = reduce(and_, [F.col(key).isNotNull() for key in keys])
    kept = staged.filter(whole).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("kept"))
    single = kept.select(*keys, *[F.col(f"kept.{c}").alias(c) for c in rest]).select(*staged.columns)
    return single.unionByName(staged.filter(~whole))
