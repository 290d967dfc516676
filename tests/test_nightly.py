import pytest

from riskloom.operators import quality
from riskloom.plans.inputs import Inputs
from riskloom.plans.nightly import REQUIRED, Layout, run_nightly
from riskloom.sources.publishing import read_history, read_previous_metrics, read_published
from riskloom.sources.snapshots import write_snapshot


@pytest.fixture
def layout(spark, tmp_path):
    inputs = Inputs(spark, "/root/testdata/sf0.001")
    made = Layout(*[str(tmp_path / part) for part in ("bronze", "silver", "gold", "serving", "history", "metrics")])
    for source in REQUIRED:
        write_snapshot(inputs.raw(f"raw_{source}"), made.bronze, source, "2001-08-01")
    return inputs, made


def test_gate_blocks_publishing(spark, layout):
    inputs, made = layout
    too_many = {"osha_inspections": (10**9, "CRITICAL")}
    with pytest.raises(quality.GateFailed):
        run_nightly(spark, made, inputs.parents, inputs.naics, "2001-08-01", "run-0", too_many)
    with pytest.raises(Exception, match="(?i)path"):
        read_published(spark, made.serving).collect()


def test_nightly_run_publishes(spark, layout, monkeypatch):
    inputs, made = layout
    monkeypatch.setattr(quality, "MIN_LOW_SHARE", 0.0)  # the fixture has few LOW employers
    limits = {"osha_inspections": (10, "CRITICAL"), "employer_profile": (10, "CRITICAL")}
    for day, run in (("2001-08-01", "run-1"), ("2001-08-02", "run-2"), ("2001-08-02", "run-2b")):
        published = run_nightly(spark, made, inputs.parents, inputs.naics, day, run, limits)
    assert {r[0] for r in published.select("pipeline_run_id").distinct().collect()} == {"run-2b"}
    assert read_published(spark, made.serving, back=2).count() == published.count()
    per_day = read_history(spark, made.history).groupBy("snapshot_date").count().collect()
    assert {str(r[0]): r[1] for r in per_day} == {d: published.count() for d in ("2001-08-01", "2001-08-02")}
    before = read_previous_metrics(spark, made.metrics, "2001-08-02")
    assert before.filter("check_name = 'employer_profile_count'").first().value == published.count()


def test_missing_source_is_reported(spark, tmp_path):
    empty = Layout(*[str(tmp_path / part) for part in "abcdef"])
    with pytest.raises(FileNotFoundError):
        run_nightly(spark, empty, None, None, "2001-08-01", "run-0")
