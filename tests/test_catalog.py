"""Registered queries against their SQL. RISKLOOM_ALL=1 runs every query; by default one in each family."""

import os

import pytest

import comparing
from riskloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CHOSEN = (
    "name_normalize address_key trigram_similarity stg_mine_violations inspection_norm msha_norm employer_keys osha_agg "
    "parent_match location_counts employer_profile fuzzy_search parent_rollup_fuzzy lookup_by_id bulk_enrich nested_inspections "
    "risk_history_fallback change_events industry_benchmark candidate_pairs scored_pairs clusters precision_recall dq_join_rate "
    "dq_run_over_run parent_map latest_snapshot_scan delimited_scan publish_swap append_history_twice streamed_landing"
).split()


@pytest.fixture(scope="module")
def con():
    return comparing.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("RISKLOOM_ALL") else CHOSEN)
def test_query_equals_sql(spark, con, name):
    count, difference = comparing.differences(spark, con, QUERIES[name], ORACLES[name], SF)
    assert not difference, difference


def test_profile_invariants(spark):
    from riskloom.operators.profile import valid_inspections
    from riskloom.plans.inputs import Inputs

    inputs = Inputs(spark, SF)
    rows = inputs.profile.collect()
    assert len({r.employer_id for r in rows}) == len(rows)
    assert {r.risk_tier for r in rows} == {"HIGH", "ELEVATED", "MEDIUM", "LOW"}
    assert all(0 <= r.risk_score <= 100 for r in rows)
    assert sum(r.osha_inspections for r in rows) == valid_inspections(inputs.osha).count()
