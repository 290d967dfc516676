"""Risk tier, score, trend and confidence as column expressions over profile counts."""

from __future__ import annotations

from collections.abc import Iterable

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.dates import years_before


def _num(name: str) -> Column:
    """A count or amount; missing counts as 0, and division is on doubles."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _first_true(rules: Iterable[tuple[Column, str]], default: str) -> Column:
    rules = list(rules)
    chain = F.when(*rules[0])
    for condition, label in rules[1:]:
        chain = chain.when(condition, label)
    return chain.otherwise(default)


def _capped(points: list[tuple[str, float, float]]) -> Column:
    """Sum over (column, points per unit, cap)."""
    return reduce(lambda a, b: a + b, [F.least(F.lit(float(cap)), _num(c) * F.lit(rate)) for c, rate, cap in points])


def _clamp(score: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


def risk_tier() -> Column:
    inspections, violations = _num("osha_inspections"), _num("osha_violations")
    wages, cases = _num("whd_backwages_total"), _num("whd_cases")
    severe = (
        (_num("osha_willful_count") >= 1)
        | (_num("osha_repeat_count") >= 3)
        | (_num("osha_total_penalties") > 100000)
        | (wages > 100000)
        | (_num("whd_ee_violated_total") > 100)
    )
    systemic = ((inspections >= 5) & (violations >= 10)) | ((cases >= 3) & (wages > 10000))
    moderate = (violations >= 3) | inspections.between(2, 4) | (cases >= 2)
    return _first_true([(severe, "HIGH"), (systemic, "ELEVATED"), (moderate, "MEDIUM")], "LOW")


def recency_factor(as_of: dt.date | str) -> Column:
    """1.0 up to three years after the last inspection, then 0.8, 0.6 and 0.4; 1.0 without inspections."""
    last = F.col("osha_last_inspection_date")
    return (
        F.when(last >= years_before(as_of, 3), 1.0)
        .when(last >= years_before(as_of, 4), 0.8)
        .when(last >= years_before(as_of, 5), 0.6)
        .when(last.isNotNull(), 0.4)
        .otherwise(1.0)
    )


def risk_score(as_of: dt.date | str) -> Column:
    """0..100: capped points per kind of finding, decayed by the age of the last inspection."""
    # A divisor is written as a division (not a rate) where the published score divides.
    money = F.least(F.lit(15.0), _num("osha_total_penalties") / 10000.0)
    wages = F.least(F.lit(8.0), _num("whd_backwages_total") / 10000.0)
    workers = F.least(F.lit(3.0), _num("whd_ee_violated_total") / 25.0)
    counts = _capped(
        [
            ("osha_willful_count", 30.0, 50),
            ("osha_repeat_count", 15.0, 30),
            ("osha_serious_count", 3.0, 20),
            ("osha_other_count", 0.5, 5),
        ]
    )
    cases = _capped([("whd_cases", 1.5, 4)])
    return _clamp((counts + money + wages + cases + workers) * recency_factor(as_of))


def trend_signal() -> Column:
    """Last year against the yearly mean of three, for employers with enough findings."""
    last, three = _num("violations_1yr"), _num("violations_3yr")
    yearly = three / 3.0
    enough = three >= 3
    return _first_true(
        [(enough & (last > yearly * 1.5), "WORSENING"), (enough & (last < yearly * 0.5), "IMPROVING")], "STABLE"
    )


def confidence_tier() -> Column:
    return _first_true(
        [
            (_num("osha_inspections") >= 3, "HIGH"),
            ((_num("osha_inspections") >= 1) | (_num("whd_cases") >= 1), "MEDIUM"),
        ],
        "LOW",
    )


def confidence_rank(tier: Column) -> Column:
    """3 for HIGH, 2 for MEDIUM, 1 for LOW: for 'at least' filters."""
    return F.when(tier == "HIGH", 3).when(tier == "MEDIUM", 2).when(tier == "LOW", 1).otherwise(0)


def severe_violator() -> Column:
    return (
        (_num("osha_willful_count") >= 1)
        | (_num("osha_repeat_count") >= 1)
        | ((_num("osha_serious_count") >= 3) & (_num("osha_total_penalties") > 50000))
    )


def risk_tier_multi_agency() -> Column:
    """Tier variant over five-year counts of all agencies, debarment and an industry outlier rule."""
    inspections, violations = _num("osha_inspections"), _num("osha_violations")
    other_agency = (_num("whd_cases") > 0) | (_num("msha_violations") > 0) | (_num("ofccp_violations") > 0)
    rate, median = F.col("industry_citation_rate"), F.col("industry_median_rate")
    severe = (
        (_num("osha_willful_count") >= 1)
        | (_num("osha_repeat_count") >= 3)
        | (_num("osha_total_penalties") > 100000)
        | F.coalesce(F.col("sam_debarred"), F.lit(False))
    )
    systemic = (
        ((inspections >= 5) & (violations >= 10))
        | ((inspections >= 3) & other_agency)
        | F.coalesce(rate > median * 2.5, F.lit(False))
    )
    moderate = (violations >= 3) | inspections.between(2, 4)
    return _first_true([(severe, "HIGH"), (systemic, "ELEVATED"), (moderate, "MEDIUM")], "LOW")


def risk_score_multi_agency() -> Column:
    points = (
        _num("osha_willful_count") * 25.0
        + _num("osha_repeat_count") * 10.0
        + _num("osha_serious_count") * 5.0
        + _num("osha_other_count")
        + F.when(F.col("sam_debarred"), 30.0).otherwise(0.0)
        + F.least(F.lit(20.0), _num("osha_total_penalties") / 10000.0)
        + F.when(_num("whd_cases") > 0, 5.0).otherwise(0.0)
        + F.when(_num("msha_violations") > 0, 5.0).otherwise(0.0)
    )
    return _clamp(points)


def identity_confidence(ein: Column, address_key: Column, name_similarity: Column) -> Column:
    """HIGH with a tax number, MEDIUM with an address key and names alike beyond 0.90, else LOW."""
    alike = address_key.isNotNull() & F.coalesce(name_similarity > 0.90, F.lit(False))
    return F.when(ein.isNotNull(), "HIGH").when(alike, "MEDIUM").otherwise("LOW")
