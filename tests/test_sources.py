"""Commit log, published versions, history, name index and seek paging."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from riskloom.functions.similarity import trigram_similarity
from riskloom.operators import lookup, picks
from riskloom.sources import layout, name_index, publishing
from riskloom.sources.commits import CommitLog

LATER = dt.datetime(2100, 1, 1, tzinfo=dt.UTC)
HISTORY = "employer_id string, snapshot_date date, risk_tier string, risk_score double, confidence_tier string, trend_signal string"


def history_rows(spark, day, ids):
    return spark.createDataFrame([(i, dt.date.fromisoformat(day), "LOW", 1.0, "HIGH", "STABLE") for i in ids], HISTORY)


def test_versions_are_put_once_and_conflicts_go_behind_the_other(spark, tmp_path):
    one, two = CommitLog(spark, str(tmp_path)), CommitLog(spark, str(tmp_path))
    assert one.entries() == two.entries() == []
    assert one.put({"by": "one"}, 1) and not two.put({"by": "two"}, 1)
    assert two.commit({"by": "two"}) == 2
    assert [e["by"] for e in one.entries()] == ["one", "two"]
    assert one.commit({"by": "one again"}, still_valid=lambda newer: False) == 3  # nothing came in between
    two.put({"by": "late"}, 4)
    assert one.commit({"by": "refused"}, still_valid=lambda newer: [e["by"] for e in newer] != ["late"]) is None
    assert not [name for name in (tmp_path / "_log").iterdir() if name.suffix == ".draft"]


def test_many_writers_lose_no_version(spark, tmp_path):
    barrier = threading.Barrier(6)

    def writer(name):
        log = CommitLog(spark, str(tmp_path))
        log.entries()
        barrier.wait()
        for k in range(4):
            log.commit({"by": f"{name}-{k}"})

    threads = [threading.Thread(target=writer, args=(n,)) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    entries = CommitLog(spark, str(tmp_path)).entries()
    assert [e["version"] for e in entries] == list(range(1, 25))
    assert sorted(e["by"] for e in entries) == sorted(f"{n}-{k}" for n in range(6) for k in range(4))


def test_publish_refuses_empty_profiles_and_vacuum_keeps_newest_versions(spark, tmp_path):
    root = str(tmp_path / "serving")
    with pytest.raises(ValueError, match="empty"):
        publishing.publish(history_rows(spark, "2001-01-01", []), root, "run-0", "2001-01-01")
    assert not (tmp_path / "serving").exists()
    for n in range(3):
        publishing.publish(history_rows(spark, "2001-01-01", [f"e{n}"]), root, f"run-{n}", "2001-01-01")
    log = CommitLog(spark, root)
    orphan, _ = log.write(history_rows(spark, "2001-01-01", ["x"]), "broken")
    assert publishing.vacuum_published(spark, root, 2, before=dt.datetime(2000, 1, 1, tzinfo=dt.UTC)) == []
    gone = publishing.vacuum_published(spark, root, 2, before=LATER)
    assert sorted(gone) == sorted([orphan, log.entries()[0]["folder"]])
    assert [publishing.read_published(spark, root, back).first().employer_id for back in (0, 1)] == ["e2", "e1"]
    with pytest.raises(ValueError, match="vacuumed"):
        publishing.read_published(spark, root, 2)


def test_history_appends_what_is_new_and_retires_whole_dates(spark, tmp_path):
    root = str(tmp_path / "history")
    assert publishing.append_history(history_rows(spark, "2001-08-01", ["a", "b"]), root) == 2
    assert publishing.append_history(history_rows(spark, "2001-08-01", ["a", "b"]), root) == 0
    assert publishing.append_history(history_rows(spark, "2001-08-01", ["b", "c"]), root) == 1
    publishing.append_snapshots(history_rows(spark, "1990-03-03", ["a"]).union(history_rows(spark, "1990-03-04", ["a"])), root)
    assert publishing.read_history(spark, root).count() == 5
    assert publishing.read_history(spark, root, to_date="1990-03-03").count() == 1
    assert publishing.apply_retention(spark, root, "2001-08-01") == 2
    assert publishing.apply_retention(spark, root, "2001-08-01") == 0
    assert sorted(r.employer_id for r in publishing.read_history(spark, root).collect()) == ["a", "b", "c"]
    assert len(publishing.vacuum_history(spark, root, LATER)) == 1
    assert publishing.read_history(spark, root).count() == 3


def test_an_append_that_another_overtakes_compares_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "history")
    write, overtaken = CommitLog.write, []

    def slow_write(self, rows, label, partition_by=None):
        result = write(self, rows, label, partition_by)
        if not overtaken:
            overtaken.append(True)
            publishing.append_history(history_rows(spark, "2001-08-01", ["a", "b"]), root)
        return result

    monkeypatch.setattr(CommitLog, "write", slow_write)
    assert publishing.append_history(history_rows(spark, "2001-08-01", ["b", "c"]), root) == 1
    assert sorted(r.employer_id for r in publishing.read_history(spark, root).collect()) == ["a", "b", "c"]
    assert len(CommitLog(spark, root).folders()) == 2


# --- name index ---

PROFILE = "employer_id string, snapshot_date date, employer_name string, ein string"


@pytest.fixture
def indexed(spark, tmp_path):
    rng = random.Random(4)
    words = ["ACME", "Roofing", "co", "steel", "Works", "north", "bolt", "ÉTÉ", "x"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(120)] + [None, "", "--"]
    rows = [(f"e{k}", dt.date(2001, 1 + k % 2, 1), name, f"t{k % 7}") for k, name in enumerate(names)]
    profile = spark.createDataFrame(rows, PROFILE)
    root = str(tmp_path / "index")
    return profile, root, name_index.add_to_index(profile, root)


@pytest.mark.parametrize(("name", "threshold"), [("acme rofing", 0.25), ("bolt", 0.15), ("STEEL WORKS NORTH", 0.6), ("été", 0.3), ("--", 0.25), ("zzz", 0.2)])
def test_index_finds_all_similar_names(indexed, name, threshold):
    profile, root, _ = indexed
    scored = profile.withColumn("sim_score", trigram_similarity(F.col("employer_name"), F.lit(name)))
    want = scored.filter(F.col("sim_score") > threshold).collect()
    assert sorted(name_index.similar_rows(profile, root, name, threshold).collect()) == sorted(want)
    same = F.col("ein") == "t3"
    want = scored.filter((F.col("sim_score") > threshold) | same)
    got = name_index.similar_rows(profile, root, name, threshold, also=same)
    assert sorted((r.employer_id, r.sim_score or 0.0) for r in got.collect()) == sorted((r.employer_id, r.sim_score or 0.0) for r in want.collect())


def test_index_grows_by_the_names_of_new_snapshots_only(spark, indexed):
    profile, root, added = indexed
    assert added == profile.filter("employer_name IS NOT NULL").select(F.lower("employer_name")).distinct().count()
    assert name_index.add_to_index(profile, root) == 0
    newer = spark.createDataFrame([("n1", dt.date(2002, 1, 1), "acme", "t1"), ("n2", dt.date(2002, 1, 1), "Quite New", "t1")], PROFILE)
    assert name_index.add_to_index(newer, root) == (1 if profile.filter("lower(employer_name) = 'acme'").count() else 2)
    assert [r.employer_id for r in name_index.similar_rows(newer, root, "quite new", 0.3).collect()] == ["n2"]


def test_search_reads_only_the_slots_of_the_rarest_grams(spark, indexed):
    _, root, _ = indexed
    grams = name_index.query_grams(spark, "STEEL WORKS NORTH")
    chosen = name_index.rarest_lists(spark.read.parquet(f"{root}/postings"), grams, 0.6)
    assert 0 < len(chosen) <= 0.5 * len(grams)
    plan = name_index.candidate_names(spark, root, "STEEL WORKS NORTH", 0.6)._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert scans and all("slot" in line.split("PartitionFilters: [")[1].split("PushedFilters")[0] for line in scans)
    slots = {slot for _, slot in chosen}
    assert all(str(slot) in scans[0] for slot in slots) and len(slots) < len({slot for _, slot in grams})


# --- paging ---


def test_pages_in_sequence_equal_the_whole_order(spark):
    rng = random.Random(6)
    data = [(f"e{k:03d}", rng.choice([None, 0.5, 0.7]), rng.choice([None, 1, 2])) for k in range(97)]
    rows = spark.createDataFrame(data, "id string, score double, n int")
    order = {"score": True, "n": False, "id": True}
    want = [tuple(r) for r in rows.orderBy(*picks.sorting(order)).collect()]
    got, after = [], None
    while True:
        page, total = picks.page_after(rows, order, 10, after)
        found = page.collect()
        assert total.get["total_count"] == 97
        got += [tuple(r) for r in found]
        if len(found) < 10:
            break
        after = found[-1].asDict()
    assert got == want


def test_pages_behind_many_cursors_come_at_once(spark):
    rng = random.Random(7)
    data = [(f"e{k:03d}", rng.choice([None, 0.5, 0.7]), rng.choice([None, 1, 2])) for k in range(90)]
    order = {"score": True, "n": False, "id": True}
    for n in (0, 4, 10, 11, 90):
        rows = spark.createDataFrame(data[:n], "id string, score double, n int").repartition(5)
        want = [(k // 10, k % 10, r["id"]) for k, r in enumerate(rows.orderBy(*picks.sorting(order)).collect())]
        later, total = picks.page_after(rows, order, 10, picks.page_ends(rows, order, 10))
        got = sorted((r["page"], r["place"], r["id"]) for r in later.collect())
        assert got == want[10:]
    assert total.get["total_count"] == 90
    # Any rows may be cursors, also such whose pages overlap.
    cursors = rows.filter("id IN ('e003', 'e050')").withColumn("page", F.col("id"))
    ids = [x for _, _, x in want]
    got = picks.page_after(rows, order, 10, cursors)[0].orderBy("page", "place").collect()
    assert [(r["page"], r["id"]) for r in got] == [(c, x) for c in ("e003", "e050") for x in ids[ids.index(c) + 1:ids.index(c) + 11]]


def test_a_page_neither_stores_nor_sorts_all_rows(spark, monkeypatch):
    rows = spark.range(100).withColumn("score", F.col("id") % 7)
    plan = picks.page_after(rows, {"score": True, "id": False}, 5, {"score": 3, "id": 10})[0]._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Scan ExistingRDD" not in plan
    order = [F.desc("score"), F.asc("id")]
    monkeypatch.setattr(picks, "PAGE_ROWS", 0)
    plan = picks.page(rows, order, 5, 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Scan ExistingRDD" not in plan


def test_short_and_long_pages_agree(spark, monkeypatch):
    rows = spark.range(100).withColumn("score", F.col("id") % 7).withColumn("amount", F.lit(1.5).cast("decimal(18,3)"))
    order = [F.desc("score"), F.asc("id")]
    short = picks.page(rows, order, 9, 5)
    monkeypatch.setattr(picks, "PAGE_ROWS", 0)
    long = picks.page(rows, order, 9, 5)
    assert short.collect() == long.collect() and short.schema.names == long.schema.names
    assert short.schema["amount"].dataType == long.schema["amount"].dataType


def test_search_with_index_equals_search_without(spark, indexed, tmp_path):
    profile, root, _ = indexed
    full = profile.withColumns({"risk_score": F.lit(1.0), "osha_inspections": F.lit(1).cast("long")})
    for name in ("acme co", "bolt x"):
        plain, fast = (lookup.search_by_name(full, name, limit=50, index=i).collect() for i in (None, root))
        assert plain == fast and plain


# --- clustered layout ---


def test_a_read_of_a_key_opens_at_most_two_files(spark, tmp_path):
    root = str(tmp_path / "by_ein")
    rows = spark.range(5000).select(F.concat(F.lit("k"), F.lpad((F.col("id") % 1000).cast("string"), 4, "0")).alias("ein"), "id", F.lit(None).cast("string").alias("note"))
    assert layout.write_clustered(rows.union(rows.limit(7).withColumn("ein", F.lit(None).cast("string"))), root, "ein", rows_per_file=400) == 13
    assert layout.read_clustered(spark, root).count() == 5007
    for key in ("k0000", "k0123", "k0999"):
        found = layout.read_keys(spark, root, "ein", [key])
        assert 1 <= len(found.inputFiles()) <= 2
        assert sorted(r["id"] for r in found.collect()) == [int(key[1:]) + 1000 * n for n in range(5)]
    assert layout.read_keys(spark, root, "ein", ["absent", "zzz"]).count() == 0
    both = layout.read_keys(spark, root, "ein", ["k0001", "k0998"])
    assert both.count() == 10 and len(both.inputFiles()) <= 4


def test_a_key_with_most_rows_is_spread_over_files_and_found_whole(spark, tmp_path):
    root = str(tmp_path / "hot")
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id")
    layout.write_clustered(rows, root, "key", rows_per_file=300)
    found = layout.read_keys(spark, root, "key", ["hot"])
    assert found.count() == 2000 and len(found.inputFiles()) >= 5
    assert layout.write_clustered(rows.limit(0), str(tmp_path / "none"), "key") == 1
    assert layout.read_keys(spark, str(tmp_path / "none"), "key", ["hot"]).count() == 0
