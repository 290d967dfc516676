"""Gold: one risk profile per employer name, state and zip.

Plan of :func:`build_profile`: both sources are aggregated per employer key and
joined on it, which re-uses the partitioning of the aggregates. Everything that
depends on the name (mine totals, parent, size of the company) is worked out on
small tables with one row per name and state, and joined to the wide rows once.
Of all this only the sums over trailing windows depend on the date, so
:func:`profile_base` serves any number of dates in one pass, and
:func:`profile_on` makes the profile of one of them from its rows alone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scoring
from riskloom.functions.codes import MONEY, employer_key, naics4, uuid_from_text
from riskloom.functions.dates import years_before
from riskloom.functions.names import is_valid_name, is_valid_wage_name
from riskloom.operators.picks import counted_once
from riskloom.operators.prefixes import with_longest_prefix
from riskloom.session import stored

COUNT_COLUMNS = [
    "osha_inspections", "osha_violations", "osha_willful_count", "osha_repeat_count", "osha_serious_count",
    "osha_other_count", "whd_cases", "whd_ee_violated_total", "msha_violations", "violations_1yr", "violations_3yr",
]
AMOUNT_COLUMNS = ["osha_total_penalties", "whd_backwages_total", "msha_assessed_penalties"]

PROFILE_COLUMNS = [
    "employer_id", "employer_name", "name_normalized", "address", "city", "state", "zip5", "naics_code",
    "naics_4digit", "osha_inspections", "osha_violations", "osha_willful_count", "osha_repeat_count",
    "osha_serious_count", "osha_other_count", "osha_total_penalties", "osha_last_inspection_date", "osha_avg_gravity",
    "whd_cases", "whd_backwages_total", "whd_ee_violated_total", "msha_violations", "msha_assessed_penalties",
    "parent_name", "location_count", "risk_tier", "risk_score", "trend_signal", "confidence_tier", "svep_flag",
    "naics_description",
]


def valid_inspections(inspections: DataFrame) -> DataFrame:
    return inspections.filter(is_valid_name(F.col("name_normalized")))


def valid_wage_actions(actions: DataFrame) -> DataFrame:
    return actions.filter(is_valid_wage_name(F.col("name_normalized")))


def _key(state: str) -> Column:
    return employer_key(F.col("name_normalized"), F.col(state), F.col("zip5"))


def employer_keys(inspections: DataFrame, wages: DataFrame) -> DataFrame:
    """One row per employer key of either source, with its id.

    State and zip may be null or '' for the same key; the greater one is kept,
    so that a key never yields two rows.
    """
    places = valid_inspections(inspections).select("name_normalized", F.col("site_state").alias("state"), "zip5")
    wage_places = valid_wage_actions(wages).select("name_normalized", "state", "zip5")
    return (
        places.union(wage_places)
        .groupBy(_key("state").alias("employer_key"))
        .agg(
            F.max("name_normalized").alias("name_normalized"),
            F.max("state").alias("state"),
            F.max("zip5").alias("zip5"),
        )
        .withColumn("employer_id", uuid_from_text(F.col("employer_key")))
    )


def _latest(value: Column, order: Column, known: Column) -> Column:
    """Latest non-null value; of several in one place the greatest. Rows without a value or a date do not compete."""
    return F.max(F.when(known & value.isNotNull(), F.struct(order.alias("at"), value.alias("value"))))["value"]


def _window(years: int, as_of: dt.date | str | None) -> str:
    """Column of the violations of the years before ``as_of``; without a date, of the only date there is."""
    return f"violations_{years}yr" if as_of is None else f"violations_{years}yr_{as_of}"


def inspection_totals(
    inspections: DataFrame, as_of: dt.date | str | list[dt.date | str], years: tuple[int, ...] = (1, 3)
) -> DataFrame:
    """Per employer key: latest identity, all-time totals and trailing-window violations, in one pass.

    Activity numbers are counted by ``counted_once``, so that all aggregates combine before the only
    shuffle of the rows. Among equal dates the greater activity number is the latest.
    With a list of dates, each has windows of its own, named by it.
    """
    order = F.struct("open_date", "activity_nr")
    dated = F.col("open_date").isNotNull()
    sums = {
        "osha_violations": "violation_count",
        "osha_willful_count": "willful_count",
        "osha_repeat_count": "repeat_count",
        "osha_serious_count": "serious_count",
        "osha_other_count": "other_count",
        "osha_total_penalties": "total_penalties",
    }
    identity = {
        "employer_name": F.col("estab_name"),
        "address": F.col("site_address"),
        "city": F.col("site_city"),
        "naics_code": F.col("naics_code"),
    }
    named = [(day, day) for day in as_of] if isinstance(as_of, list) else [(as_of, None)]
    windows = [
        F.sum(F.when(F.col("open_date") >= years_before(day, n), F.col("violation_count"))).alias(_window(n, name))
        for day, name in named
        for n in years
    ]
    used = ["open_date", "activity_nr", "name_normalized", "site_state", "zip5", "estab_name", "site_address", "site_city", "naics_code", "avg_gravity"]
    rows = valid_inspections(inspections).select(_key("site_state").alias("employer_key"), *used, *sums.values())
    return (
        counted_once(rows, ["employer_key"], "activity_nr", "counts")
        .groupBy("employer_key")
        .agg(
            F.max("name_normalized").alias("name_normalized"),
            F.max("site_state").alias("state"),
            F.max("zip5").alias("zip5"),
            *[_latest(value, order, dated).alias(name) for name, value in identity.items()],
            F.sum("counts").alias("osha_inspections"),
            *[F.sum(column).alias(name) for name, column in sums.items()],
            F.max("open_date").alias("osha_last_inspection_date"),
            F.avg("avg_gravity").alias("osha_avg_gravity"),
            *windows,
        )
        .withColumn("naics_4digit", naics4(F.col("naics_code")))
    )


def wage_totals(wages: DataFrame) -> DataFrame:
    """Per employer key: latest identity and totals of wage actions."""
    order = F.struct("findings_end_date", "case_id")
    dated = F.col("findings_end_date").isNotNull()
    used = ["findings_end_date", "case_id", "name_normalized", "state", "zip5", "employer_name", "address", "city", "backwages", "employees_violated"]
    rows = valid_wage_actions(wages).select(_key("state").alias("employer_key"), *used)
    return (
        counted_once(rows, ["employer_key"], "case_id", "counts")
        .groupBy("employer_key")
        .agg(
            F.max("name_normalized").alias("name_normalized"),
            F.max("state").alias("state"),
            F.max("zip5").alias("zip5"),
            _latest(F.col("employer_name"), order, dated).alias("whd_employer_name"),
            _latest(F.col("address"), order, dated).alias("whd_address"),
            _latest(F.col("city"), order, dated).alias("whd_city"),
            F.sum("counts").alias("whd_cases"),
            F.sum("backwages").alias("whd_backwages_total"),
            F.sum("employees_violated").alias("whd_ee_violated_total"),
        )
    )


def mine_totals(mine_violations: DataFrame) -> DataFrame:
    """Per name and state: distinct violations and assessed penalties."""
    rows = mine_violations.filter(F.length("name_normalized") > 1).select("name_normalized", "state", "violation_no", "proposed_penalty")
    return (
        counted_once(rows, ["name_normalized", "state"], "violation_no", "counts")
        .groupBy("name_normalized", "state")
        .agg(
            F.sum("counts").alias("msha_violations"),
            F.sum("proposed_penalty").alias("msha_assessed_penalties"),
        )
    )


def employer_places(keys: DataFrame) -> DataFrame:
    """Employers per name and state."""
    return keys.groupBy("name_normalized", "state").agg(F.count(F.lit(1)).alias("employers"))


def with_parent(names: DataFrame, parents: DataFrame, honor_match_type: bool = False) -> DataFrame:
    """Rows of distinct names with their parent: the longest pattern the name starts with, or null.

    With ``honor_match_type``, patterns marked ``exact`` take whole names only, and take them first.
    """
    if not honor_match_type:
        return with_longest_prefix(names, parents, "name_normalized", "name_pattern", "parent_name")
    exact = F.col("match_type") == "exact"
    whole = parents.filter(exact).groupBy(F.col("name_pattern").alias("name_normalized")).agg(
        F.min("parent_name").alias("exact_parent")
    )
    prefixed = with_longest_prefix(names, parents.filter(~exact), "name_normalized", "name_pattern", "parent_name")
    return (
        prefixed.join(whole, "name_normalized", "left")
        .withColumn("parent_name", F.coalesce("exact_parent", "parent_name"))
        .drop("exact_parent")
    )


def parent_matches(keys: DataFrame, parents: DataFrame, honor_match_type: bool = False) -> DataFrame:
    """(name_normalized, parent_name) of the distinct names that have a parent."""
    matched = with_parent(keys.select("name_normalized").distinct(), parents, honor_match_type)
    return matched.filter(F.col("parent_name").isNotNull())


def company_sizes(places: DataFrame, parents: DataFrame, honor_match_type: bool = False) -> DataFrame:
    """Per distinct name: parent and the number of employers under the parent (else under the name).

    Counts are summed per name first and per company second, so a company with a
    third of all employers is a sum of partial counts and never one window.
    """
    per_name = places.groupBy("name_normalized").agg(F.sum("employers").alias("name_employers"))
    matched = with_parent(per_name, parents, honor_match_type).withColumn(
        "company", F.coalesce("parent_name", "name_normalized")
    )
    sizes = matched.groupBy("company").agg(F.sum("name_employers").alias("company_employers"))
    # Both sides carry name_employers, so that Spark shuffles ``matched`` once for both.
    return matched.join(sizes, "company", "left").select(
        "name_normalized", "parent_name", F.coalesce("company_employers", "name_employers").alias("location_count")
    )


def _zero_filled(base: DataFrame) -> DataFrame:
    counts = [c for c in base.columns if c in COUNT_COLUMNS or c.startswith("violations_")]
    return base.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(0)) for c in counts},
            **{c: F.coalesce(F.col(c), F.lit(0).cast(MONEY)) for c in AMOUNT_COLUMNS},
        }
    )


def employer_base(
    inspections: DataFrame, wages: DataFrame, mine_violations: DataFrame, as_of: dt.date | str
) -> DataFrame:
    """Both sources and mine totals side by side, one row per employer key."""
    totals = _join_sources(inspections, wages, as_of)
    mines = mine_totals(mine_violations)
    return _zero_filled(totals.join(mines, ["name_normalized", "state"], "left"))


def _join_sources(inspections: DataFrame, wages: DataFrame, as_of: dt.date | str | list[dt.date | str]) -> DataFrame:
    """Full outer join of the two aggregates: its keys are the union of both key sets."""
    osha, whd = inspection_totals(inspections, as_of).alias("o"), wage_totals(wages).alias("w")

    def pick(column: str) -> Column:
        return F.greatest(F.col(f"o.{column}"), F.col(f"w.{column}")).alias(column)

    inspected = [
        "naics_code", "naics_4digit", "osha_inspections", "osha_violations", "osha_willful_count",
        "osha_repeat_count", "osha_serious_count", "osha_other_count", "osha_total_penalties",
        "osha_last_inspection_date", "osha_avg_gravity", *[c for c in osha.columns if c.startswith("violations_")],
    ]
    return osha.join(whd, "employer_key", "full").select(
        "employer_key",
        uuid_from_text(F.col("employer_key")).alias("employer_id"),
        pick("name_normalized"), pick("state"), pick("zip5"),
        F.coalesce("o.employer_name", "w.whd_employer_name").alias("employer_name"),
        F.coalesce("o.address", "w.whd_address").alias("address"),
        F.coalesce("o.city", "w.whd_city").alias("city"),
        *inspected,
        "whd_cases", "whd_backwages_total", "whd_ee_violated_total",
    )


def with_risk(base: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Tier, score, trend, confidence and severe-violator flag."""
    return base.withColumns(
        {
            "risk_tier": scoring.risk_tier(),
            "risk_score": scoring.risk_score(as_of),
            "trend_signal": scoring.trend_signal(),
            "confidence_tier": scoring.confidence_tier(),
            "svep_flag": scoring.severe_violator(),
        }
    )


def build_profile(
    inspections: DataFrame,
    wages: DataFrame,
    mine_violations: DataFrame,
    parents: DataFrame,
    naics: DataFrame,
    as_of: dt.date | str,
    honor_match_type: bool = False,
) -> DataFrame:
    """The employer profile from silver inputs. See the module text for the plan."""
    return profile_on(profile_base(inspections, wages, mine_violations, parents, naics, [as_of], honor_match_type), as_of)


def profile_base(
    inspections: DataFrame,
    wages: DataFrame,
    mine_violations: DataFrame,
    parents: DataFrame,
    naics: DataFrame,
    as_of: list[dt.date | str],
    honor_match_type: bool = False,
) -> DataFrame:
    """All of the profile that needs other rows, with the trailing windows of each date of ``as_of``."""
    keys = employer_keys(inspections, wages)
    places = employer_places(keys)
    by_place = (
        places.join(mine_totals(mine_violations), ["name_normalized", "state"], "left")
        .join(company_sizes(places, parents, honor_match_type), "name_normalized", "left")
        .withColumn("location_count", F.coalesce("location_count", "employers"))
        .withColumn("state_key", F.coalesce("state", F.lit("\0")))
        .drop("state", "employers")
    )
    by_place = stored(by_place, "places")  # of known size: a short list goes to the wide rows
    titles = naics.groupBy("naics_code").agg(F.min("naics_title").alias("naics_description"))
    wide = (
        _join_sources(inspections, wages, as_of)
        .filter(F.col("employer_name").isNotNull())
        .withColumn("state_key", F.coalesce("state", F.lit("\0")))
        .join(by_place, ["name_normalized", "state_key"], "left")
        .join(titles, "naics_code", "left")
    )
    return _zero_filled(wide).drop("employer_key", "state_key")


def profile_on(base: DataFrame, as_of: dt.date | str) -> DataFrame:
    """The profile of one date of ``profile_base``: each of its rows by itself."""
    windows = {f"violations_{n}yr": F.col(f"`{_window(n, as_of)}`") for n in (1, 3)}
    return with_risk(base.withColumns(windows), as_of).select(*PROFILE_COLUMNS)
