"""Landing with repeats, counted agreement patterns, learnt agreement chances, uploads."""

import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from riskloom.operators import linkage, linkage_update, silver
from riskloom.operators.components import connected_components
from riskloom.plans import inputs
from riskloom.plans.linkage_run import employers, read_linkage, review_rows, run_linkage
from riskloom.plans.upload import enrich_upload
from riskloom.sources.commits import CommitLog
from riskloom.sources.delimited import read_lookups
from riskloom.streaming.landing import land_json_lines, refused_rows

RECORDS = "unique_id string, source string, name_normalized string, name_prefix string, zip5 string, site_state string, naics_4digit string, address_key string"


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(8)
    pick = lambda values: rng.choice([*values, None])
    rows = []
    for k in range(120):
        name = rng.choice(["ACME CO", "ACME STEEL", "BOLT", "BOLTS"])
        rows.append((f"r{k:03d}", "OSHA", name, name[:4], pick(["1", "2", "3"]), pick(["TX", "OH"]), pick(["2381", "3311"]), pick(["A", "B"])))
    return spark.createDataFrame(rows, RECORDS)


def brute_patterns(records):
    out = {}
    for a, b in combinations(records.collect(), 2):
        gammas = tuple(None if a[f] is None or b[f] is None else int(a[f] == b[f]) for f in [*linkage.FIELDS, "name_prefix"])
        told = dict(zip([*linkage.FIELDS, "name_prefix"], gammas))
        rule = next((k for k, fields in enumerate(linkage.BLOCKING_RULES, 1) if all(told[f] == 1 for f in fields)), None)
        if rule:
            out[(*gammas, rule)] = out.get((*gammas, rule), 0) + 1
    return out


def test_patterns_equal_counting_all_pairs(records):
    got = linkage.pair_patterns(records).collect()
    assert {tuple(r)[:-1]: r["pairs"] for r in got} == brute_patterns(records)
    assert linkage.pair_patterns(records.limit(0)).count() == 0


def test_agreement_chances_are_learnt_where_matches_agree_often(spark):
    rng = random.Random(5)
    rows = []
    for k in range(150):  # 150 employers of two records each; the address differs in a fifth of them
        name, zip5, state = f"N{k:03d} X", f"{k % 40:05d}", rng.choice(["TX", "OH"])
        for copy in range(2):
            rows.append((f"r{k}-{copy}", "OSHA", name, name[:4], zip5, state, f"{k % 30:04d}", f"A{k}" if copy == 0 or k % 5 else f"B{k}"))
    got = {(r["match_rule"], r["field"]): r["m"] for r in linkage.m_values(spark.createDataFrame(rows, RECORDS), rounds=20).collect()}
    assert (1, "zip5") not in got and (2, "site_state") not in got
    assert abs(got[1, "address_key"] - 0.8) < 0.05 and got[1, "name_normalized"] > 0.95


def test_a_stated_prefix_puts_records_without_one_into_blocks(spark):
    schema = "name_normalized string, zip5 string, site_state string, naics_4digit string, address_key string, activity_nr long"
    osha = spark.createDataFrame([("ACME", None, None, None, None, k) for k in range(3)], schema)
    wages = spark.createDataFrame([], "case_id string, name_normalized string, zip5 string, state string")
    pairs = [linkage.candidate_pair_counts(linkage.linkage_input(osha, wages, missing_prefix=p)).collect() for p in (None, "0000")]
    assert [[(r["match_rule"], r["pairs"]) for r in found if r["pairs"]] for found in pairs] == [[], [(3, 3)]]


def test_mine_violations_clean_each_name_once_and_keep_all_rows(spark):
    mines = spark.createDataFrame([("m1", "Coal Op, Inc.", "x", "y", "c", "TX", "k")], "mine_id string, operator_name string, mine_name string, mine_status string, controller_name string, state string, county string")
    columns = "event_no string, mine_id string, violation_no string, violator_name string, violation_date date, issue_date date, section_of_act string, sig_sub string, proposed_penalty double, amount_paid double, negligence string"
    rows = [("e1", "m1", "v1", None), ("e1", "m1", "v1", None), ("e2", "m9", "v2", "Dig LLC"), ("e3", "m9", "v3", None), ("e4", "m1", "v4", "Dig LLC")]
    violations = spark.createDataFrame([(*r, *[None] * 7) for r in rows], columns)
    got = sorted((r["event_no"], r["name_normalized"]) for r in silver.normalize_mine_violations(violations, mines).collect())
    assert got == [("e1", "COAL OP"), ("e1", "COAL OP"), ("e2", "DIG"), ("e4", "DIG")]


# --- landing ---


def put(tmp_path, name, rows):
    inbox = tmp_path / "inbox"
    inbox.mkdir(exist_ok=True)
    (inbox / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def land(spark, tmp_path):
    query = land_json_lines(
        spark, f"{tmp_path}/inbox", f"{tmp_path}/bronze", f"{tmp_path}/bad", f"{tmp_path}/progress",
        "id long, v string, at timestamp", ["v"], keys=["id"], loaded_at="at", overlap="2 hours",
    )
    query.awaitTermination()
    return query


def test_a_record_lands_once_over_restarts_and_bad_rows_are_all_set_aside(spark, tmp_path):
    row = lambda i, hour, v="x": {"id": i, "v": v, "at": f"2001-01-01T{hour:02d}:00:00"}
    put(tmp_path, "a.json", [row(1, 1), row(1, 1), row(2, 1), "{broken", row(3, 1, None), {"v": "no id", "at": "2001-01-01T01:00:00"}])
    land(spark, tmp_path)
    put(tmp_path, "b.json", [row(1, 2), row(2, 2), row(4, 2), "{broken", {"id": 7, "v": "no time"}])
    land(spark, tmp_path)
    put(tmp_path, "c.json", [row(5, 9)])
    land(spark, tmp_path)
    put(tmp_path, "d.json", [row(6, 3), row(8, 9)])  # 6 was loaded long before the newest record
    query = land(spark, tmp_path)
    read = spark.read.option("recursiveFileLookup", True)
    assert sorted((r["id"], r["at"].hour) for r in read.parquet(f"{tmp_path}/bronze").collect()) == [(1, 1), (2, 1), (4, 2), (5, 9), (8, 9)]
    assert read.json(f"{tmp_path}/bad").count() == 5
    assert refused_rows(query) == 1


# --- uploads ---

SERVED = "employer_id string, employer_name string, state string, zip string, city string, address string, risk_tier string, risk_score double, osha_inspections long, osha_violations long, osha_total_penalties double, location_count long, trend_signal string, snapshot_date int"


@pytest.fixture(scope="module")
def served(spark):
    rows = [("e1", "ACME ROOFING", "TX", "70000", "AUSTIN", "1 Main", "LOW", 1.0, 1, 0, 0.0, 1, "STABLE", 1), ("e2", "BOLT STEEL", "OH", "44000", "AKRON", "2 Main", "HIGH", 9.0, 2, 3, 5.0, 1, "STABLE", 1)]
    return spark.createDataFrame(rows, SERVED)


def test_upload_keeps_rows_order_and_columns(spark, tmp_path, served):
    text = '﻿Note,Company,ST,match_risk_tier\n"a, ""b""\nc",Acme Rofing,tx,old\nplain,,,old\nlast,Bolt Steel,OH,\n'
    (tmp_path / "up.csv").write_text(text, encoding="utf-8")
    summary = enrich_upload(spark, f"{tmp_path}/up.csv", served, f"{tmp_path}/out").first()
    assert (summary.total, summary.matched) == (3, 2)
    back = read_lookups(spark, f"{tmp_path}/out", quoted_breaks=True)
    assert back.columns[:4] == ["Note", "Company", "ST", "match_employer_id"] and back.columns.count("match_risk_tier") == 1
    rows = {r["Note"]: (r["match_employer_id"], r["match_risk_tier"]) for r in back.collect()}
    assert rows == {'a, "b"\nc': ("e1", "LOW"), "plain": (None, None), "last": ("e2", "HIGH")}
    parts = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.csv")))
    assert parts.index('"a, ""b""') < parts.index("plain") < parts.index("last")


def test_upload_without_rows_or_known_columns_is_refused(spark, tmp_path, served):
    for name, text in (("none.csv", "Company,State\n"), ("unknown.csv", "colour,size\nred,1\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            enrich_upload(spark, f"{tmp_path}/{name}", served, f"{tmp_path}/refused")
    assert not (tmp_path / "refused").exists()


# --- linkage with memory ---


def many_records(spark, seed, ids):
    """Records of which few agree; the same id has the same fields under the same seed."""
    rows = []
    for k in ids:
        rng = random.Random(f"{seed}-{k}")
        pick = lambda values: rng.choice([*values, None])
        name = f"{rng.choice('ABCDEFGHIJKL') * 4} {rng.choice(['X', 'Y'])}"
        rows.append((f"r{k:03d}", "OSHA", name, name[:4], pick([str(z) for z in range(8)]), pick(["TX", "OH"]), pick(["2381", "3311"]), pick(["A", "B", "C"])))
    return spark.createDataFrame(rows, RECORDS)


U = {"name_normalized": 0.00095, "zip5": 0.002, "naics_4digit": 0.05, "site_state": 0.3, "address_key": 0.0001}


def test_runs_with_memory_equal_whole_runs(spark, tmp_path):
    root = f"{tmp_path}/linkage"
    days = [(1, range(0, 60)), (1, range(0, 110)), (1, range(20, 110)), (2, range(20, 120))]  # added, gone, all changed
    given, retired = set(), set()
    for n, (seed, ids) in enumerate(days):
        records = many_records(spark, seed, ids)
        done = run_linkage(records, root, queue_size=5, u=U)
        assert (done["version"], done["mode"]) == (n + 1, "updated" if n else "whole")
        evidence = linkage.Evidence(U)
        want = linkage.merge_same_names(linkage.cluster_records(records, evidence=evidence), records)
        got = {r["unique_id"]: r["cluster_id"] for r in read_linkage(spark, root, "clusters").collect()}
        assert got == {r["unique_id"]: r["cluster_id"] for r in want.collect()}
        assert 1 < len(set(got.values())) < len(got)
        found = employers(spark, root).collect()
        assert len(found) == len(got) and len({r["employer_id"] for r in found}) == len(set(got.values()))
        active = {r["employer_id"] for r in found}
        given |= active
        table = read_linkage(spark, root, "ids").collect()
        assert len(table) == len({r["employer_id"] for r in table}) and {r["employer_id"] for r in table} == given
        now_retired = {r["employer_id"] for r in table if r["superseded_by"] is not None}
        assert now_retired == given - active and now_retired >= retired  # a retired id never comes back
        retired = now_retired
    queue = [(r["record_id_left"], r["record_id_right"]) for r in review_rows(spark, root).collect()]
    assert len(queue) == len(set(queue)) > 5


def test_a_run_forms_classes_once_and_links_digests_as_bytes(spark, tmp_path, monkeypatch):
    formed, keyed, classes_of, star = [], [], linkage.linkage_classes, linkage_update.star_edges

    def kept(rows, *rest, **named):
        keyed.append(dict(rows.dtypes))
        return star(rows, *rest, **named)

    monkeypatch.setattr(linkage, "linkage_classes", lambda records: formed.append(1) or classes_of(records))
    monkeypatch.setattr(linkage_update, "star_edges", kept)
    root = f"{tmp_path}/linkage"
    run_linkage(many_records(spark, 1, range(60)), root, queue_size=5, u=U)
    assert len(formed) == 1 and keyed[0]["label"] == "binary"
    # What is kept is text as before, and a component bears the least signature of its own.
    kept_rows = read_linkage(spark, root, "components").collect()
    assert {r["component"] for r in kept_rows} <= {r["signature"] for r in kept_rows}
    assert all(r["component"] <= r["signature"] for r in kept_rows)
    assert {r["signature"] for r in kept_rows} == {r["signature"] for r in read_linkage(spark, root, "classes").collect()}


def test_only_groups_of_new_classes_are_linked_again(spark, monkeypatch):
    records, seen = many_records(spark, 1, range(100)), []
    evidence = linkage.Evidence(U)
    classes = linkage.linkage_classes(records)
    whole = linkage_update.update_components(None, classes, evidence)
    kept = spark.createDataFrame(whole.collect(), whole.schema)
    monkeypatch.setattr(linkage_update, "connected_components", lambda edges, a, b: seen.append(edges.count()) or connected_components(edges, a, b))
    again = linkage_update.update_components(kept, classes, evidence)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, kept.collect())) and seen == [0]


def test_a_run_without_records_is_refused_and_a_lost_race_starts_again(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/linkage"
    with pytest.raises(ValueError):
        run_linkage(many_records(spark, 1, range(2)).limit(0), root)
    first, second = many_records(spark, 1, range(30)), many_records(spark, 1, range(40))
    commit, raced = CommitLog.commit, []

    def late(log, entry, **kinds):
        if not raced:  # another run gets in between
            raced.append(True)
            run_linkage(first, root, u=U)
        return commit(log, entry, **kinds)

    monkeypatch.setattr(CommitLog, "commit", late)
    done = run_linkage(second, root, u=U)
    log = CommitLog(spark, root)
    assert done["version"] == 2 and done["mode"] == "updated"
    assert set(log.folders()) == {f for entry in log.entries() for f in entry["folders"].values()}


@pytest.mark.parametrize("k", [1, 7, 500])
def test_the_queue_needs_only_the_patterns_it_opens(spark, records, k):
    evidence = linkage.Evidence(U)
    all_pairs = linkage.scored_pairs(records, evidence=evidence)
    want = linkage.review_queue(all_pairs, k).collect()
    listed = linkage.uncertain_pairs(records, k, evidence)
    assert linkage.review_queue(listed, k).collect() == want and len(want) >= min(k, 7)
    assert listed.count() < all_pairs.count()


def test_a_name_index_writes_no_serving_table_of_an_older_snapshot(spark, monkeypatch):
    """It reads their names only; every snapshot's names are in it all the same."""
    def served(self, day):
        return spark.createDataFrame([("Red Bolt",), (f"Cold {day[:4]}",), (None,)], "employer_name string").withColumn("snapshot_date", F.lit(day).cast("date"))

    monkeypatch.setattr(inputs.Inputs, "build_served", served)
    root = inputs.Inputs(spark, "made-up-folder").name_index
    found = {(str(r.snapshot), r.name) for r in spark.read.parquet(f"{root}/names").collect()}
    first = min(inputs.SNAPSHOTS)
    assert found == {(first, "red bolt")} | {(day, f"cold {day[:4]}") for day in inputs.SNAPSHOTS}
    written = {name for _, folder, name in inputs._WRITTEN if folder == "made-up-folder"}
    assert written == {"name_index", f"served-{inputs.AS_OF}"}
