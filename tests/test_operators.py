import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import audit, history, linkage, lookup, picks, prefixes, profile, quality, reports, stable_ids, staging
from riskloom.operators.components import connected_components
from riskloom.operators.matching import best_matches, similar_pairs
from riskloom.operators.quantiles import exact_percentiles
from riskloom.sources import delimited
from test_functions import grams


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- profile ---

SILVER = (
    "activity_nr string, estab_name string, name_normalized string, site_address string, site_city string, site_state string, "
    "zip5 string, naics_code string, naics_4digit string, open_date date, violation_count long, willful_count long, "
    "repeat_count long, serious_count long, other_count long, total_penalties decimal(18,3), avg_gravity double"
)
WAGES = (
    "case_id string, employer_name string, name_normalized string, address string, city string, state string, zip5 string, "
    "findings_end_date date, backwages decimal(18,3), employees_violated int"
)


@pytest.fixture(scope="module")
def small_profile(spark):
    osha = spark.createDataFrame([], SILVER).union(
        spark.sql(
            """SELECT * FROM VALUES
  ('1', 'Acme Old', 'ACME', 'a1', 'c1', 'ID', '83702', '2381', '2381', DATE'2020-01-01', 2L, 0L, 0L, 1L, 1L, 10.5BD, 2.0D),
  ('2', 'Acme New', 'ACME', NULL, 'c2', 'ID', '83702', NULL, NULL, DATE'2023-06-01', 4L, 0L, 1L, 1L, 2L, 20BD, 4.0D),
  ('2', 'Acme New', 'ACME', NULL, 'c2', 'ID', '83702', NULL, NULL, DATE'2023-06-01', 4L, 0L, 1L, 1L, 2L, 20BD, 4.0D),
  ('3', 'Acme No Zip', 'ACME', 'a3', 'c3', 'ID', NULL, '2382', '2382', DATE'2023-01-01', 0L, 0L, 0L, 0L, 0L, 0BD, NULL),
  ('4', 'Acme Blank Zip', 'ACME', 'a4', 'c4', 'ID', '', '2383', '2383', DATE'2022-01-01', 0L, 0L, 0L, 0L, 0L, 0BD, NULL),
  ('5', 'N/A', 'NA', 'a5', 'c5', 'ID', '1', '2383', '2383', DATE'2022-01-01', 0L, 0L, 0L, 0L, 0L, 0BD, NULL)"""
        )
    )
    whd = spark.createDataFrame([], WAGES).union(
        spark.sql("SELECT '9', 'Beta Wage', 'BETA', 'b', 'bc', 'WA', '98101', DATE'2021-01-01', 5BD, 3")
    )
    mines = spark.sql("SELECT 'ACME' AS name_normalized, 'ID' AS state, 'v1' AS violation_no, 7BD AS proposed_penalty")
    parents = spark.sql("SELECT * FROM VALUES ('AC', 'Short', 'prefix'), ('ACME', 'Long', 'exact') t(name_pattern, parent_name, match_type)")
    naics = spark.sql("SELECT '2382' AS naics_code, 'Building' AS naics_title")
    built = profile.build_profile(osha, whd, mines, parents, naics, "2024-01-01")
    return {(r.name_normalized, r.zip5): r for r in built.collect()}


def test_one_base_serves_the_profiles_of_many_dates(spark):
    osha = spark.createDataFrame([], SILVER).union(
        spark.sql(
            """SELECT * FROM VALUES
  ('1', 'Acme', 'ACME', 'a1', 'c1', 'ID', '83702', '2381', '2381', DATE'2020-01-01', 2L, 0L, 0L, 1L, 1L, 10.5BD, 2.0D),
  ('2', 'Acme', 'ACME', NULL, 'c2', 'ID', '83702', NULL, NULL, DATE'2023-06-01', 40L, 0L, 1L, 1L, 2L, 20BD, 4.0D),
  ('2', 'Acme', 'ACME', NULL, 'c2', 'ID', '83702', NULL, NULL, DATE'2023-06-01', 40L, 0L, 1L, 1L, 2L, 20BD, 4.0D),
  (NULL, 'Cold', 'COLD', 'a3', 'c3', NULL, NULL, '2382', '2382', NULL, 1L, 0L, 0L, 0L, 0L, 0BD, NULL)"""
        )
    )
    whd = spark.createDataFrame([], WAGES).union(
        spark.sql("SELECT '9', 'Beta Wage', 'BETA', 'b', 'bc', 'WA', '98101', DATE'2021-01-01', 5BD, 3")
    )
    mines = spark.sql("SELECT 'ACME' AS name_normalized, 'ID' AS state, 'v1' AS violation_no, 7BD AS proposed_penalty")
    parents = spark.sql("SELECT 'ACME' AS name_pattern, 'Acme Group' AS parent_name, 'prefix' AS match_type")
    naics = spark.sql("SELECT '2382' AS naics_code, 'Building' AS naics_title")
    days = ["2020-06-01", "2023-07-01", "2030-01-01"]
    base = profile.profile_base(osha, whd, mines, parents, naics, days)
    told = [rows(profile.profile_on(base, day)) for day in days]
    assert told == [rows(profile.build_profile(osha, whd, mines, parents, naics, day)) for day in days]
    assert told[0] != told[2] and all(len(day) == 2 for day in told)
    windows = base.filter("name_normalized = 'ACME'").first()
    assert [windows[f"violations_1yr_{day}"] for day in days] == [82, 80, 0]


def test_one_row_per_employer_even_for_null_and_blank_zip(small_profile):
    assert set(small_profile) == {("ACME", "83702"), ("ACME", ""), ("BETA", "98101")}


def test_latest_known_values_win(small_profile):
    acme = small_profile["ACME", "83702"]
    assert (acme.employer_name, acme.address, acme.city, acme.naics_code) == ("Acme New", "a1", "c2", "2381")


def test_repeated_rows_count_once_as_inspection_and_fully_in_sums(small_profile):
    acme = small_profile["ACME", "83702"]
    assert (acme.osha_inspections, acme.osha_violations, float(acme.osha_total_penalties)) == (2, 10, 50.5)


def test_parent_mines_locations_and_wages(small_profile):
    acme, blank, beta = (small_profile[k] for k in [("ACME", "83702"), ("ACME", ""), ("BETA", "98101")])
    assert (acme.parent_name, acme.location_count, acme.msha_violations) == ("Long", 2, 1)
    assert (blank.naics_description, blank.msha_violations) == ("Building", 1)
    assert (beta.parent_name, beta.location_count, beta.osha_inspections, beta.whd_cases) == (None, 1, 0, 1)


def test_fractional_and_bad_numbers_in_staging(spark):
    raw = spark.sql(
        "SELECT 'a' AS activity_nr, 'c' AS citation_id, 'S' AS viol_type, '3.7' AS gravity, '2' AS nr_instances, '1.2345' AS initial_penalty, "
        "NULL AS current_penalty, NULL AS abate_date, '2020-01-05' AS issuance_date"
    )
    row = staging.stage_violations(raw).first()
    assert (row.gravity, row.nr_instances, str(row.initial_penalty)) == (4, 2, "1.235")


# --- joins and picks ---


def test_prefix_matches_equal_startswith(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("AB") for _ in range(n))
    texts, patterns = {word(rng.randint(1, 6)) for _ in range(40)}, {word(rng.randint(1, 4)) for _ in range(12)}
    got = prefixes.prefix_matches(
        spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(p,) for p in patterns], "p string"), "t", "p"
    )
    assert rows(got.select("t", "p")) == sorted((t, p) for t in texts for p in patterns if t.startswith(p))


@pytest.mark.parametrize("threshold, rows_per_salt", [(0.3, 50_000), (0.5, 2), (0.15, 3)])
def test_similar_pairs_equal_brute_force(spark, threshold, rows_per_salt):
    rng = random.Random(7)
    words = ["acme", "roofing", "co", "steel", "works", "north", "a", "bolt"]
    name = lambda: " ".join(rng.choice(words) + rng.choice(["", "s", "x"]) for _ in range(rng.randint(1, 4)))
    left, right = {name() for _ in range(60)} | {"", "--"}, {name() for _ in range(80)}
    got = similar_pairs(
        spark.createDataFrame([(t,) for t in left], "a string"), spark.createDataFrame([(t,) for t in right], "b string"),
        "a", "b", threshold, rows_per_salt=rows_per_salt,
    )
    want = {}
    for a, b in itertools.product(left, right):
        x, y = grams(a), grams(b)
        if x | y and len(x & y) / len(x | y) > threshold:
            want[a, b] = len(x & y) / len(x | y)
    found = [(r.a, r.b) for r in got.collect()]
    assert len(found) == len(set(found))
    assert {(r.a, r.b): round(r.similarity, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_similar_pairs_within_blocks_only(spark):
    q = spark.createDataFrame([("x", "acme"), ("y", "acme")], "block string, a string")
    t = spark.createDataFrame([("x", "acme"), ("z", "acme")], "block string, b string")
    assert rows(similar_pairs(q, t, "a", "b", 0.3, block="block")) == [("x", "acme", "acme", 1.0)]


@pytest.mark.parametrize("rows_per_salt", [2, 50_000])
def test_best_matches_equal_brute_force_with_a_gram_that_all_texts_hold(spark, rows_per_salt):
    rng = random.Random(11)
    words = ["acme", "roofing", "steel", "works", "north", "bolt", "x"]
    name = lambda: " ".join(["inc"] + [rng.choice(words) + rng.choice(["", "s", "x"]) for _ in range(rng.randint(0, 3))])
    asked = [(rng.choice("ab"), name(), f"q{k % 50}") for k in range(90)]
    held = [(rng.choice("abc"), name(), f"t{rng.randrange(60):02d}") for _ in range(120)]
    got = best_matches(
        spark.createDataFrame(asked, "block string, q string, query string"), spark.createDataFrame(held, "block string, t string, target string"),
        "q", "t", "query", "target", 0.3, "block", rows_per_salt=rows_per_salt,
    )
    want = {}
    for block, q, query in asked:
        for other, t, target in held:
            x, y = grams(q), grams(t)
            score = len(x & y) / len(x | y)
            if block == other and score > 0.3:
                want[query] = min(want.get(query, (0.0, "")), (-score, target))
    assert {r.query: (r.target, round(r.similarity, 9)) for r in got.collect()} == {k: (t, round(-s, 9)) for k, (s, t) in want.items()}


def test_a_name_asked_and_held_in_a_thousand_cities_meets_each_city_once(spark, monkeypatch):
    cities = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=12)) for k in range(1000)]
    served = spark.createDataFrame(
        [(f"e{k:04d}", "ACME ROOFING", "TX", "70000", city.upper(), 1) for k, city in enumerate(cities)],
        "employer_id string, employer_name string, state string, zip string, city string, snapshot_date int",
    )
    asked = spark.createDataFrame([(k, "acme roofng", city) for k, city in enumerate(cities)], "lookup_id long, name string, city string")
    seen = []
    best = lookup.best_matches

    def counted(asked, held, *rest):
        seen.extend([asked.count(), held.count()])
        return best(asked, held, *rest)

    monkeypatch.setattr(lookup, "best_matches", counted)
    got = {r.lookup_id: r.employer_id for r in lookup.resolve_lookups(asked, served).collect()}
    assert got == {k: f"e{k:04d}" for k in range(1000)}
    assert max(seen) < 1100


def test_exact_percentiles(spark):
    rng = random.Random(3)
    data = [("g%d" % (k % 3), rng.choice([0, 1, 5, -3, 10**9, 123456789012]) + rng.randint(0, 9)) for k in range(200)]
    df = spark.createDataFrame(data + [("g0", None), (None, 1)], "g string, v long")
    got = exact_percentiles(df, "g", {"m": (F.col("v"), 1)})
    want = df.filter("g is not null").groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    assert rows(got) == rows(want)


def test_only_rows_of_repeated_keys_are_picked_from(spark, frame):
    data = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "x"), (None, 1, "n"), (None, 3, "m"), ("c", None, None), ("d", 1, "x"), ("d", 1, "x")]
    for chosen in (data, [row for row in data if row[0] in ("b", "c")], [(None, 1, "n")], []):
        held = frame(chosen, "employer_id string, n int, label string")
        got = picks.without_repeats(held, "employer_id", ["n"])
        assert rows(got) == rows(picks.greatest_row(held, ["employer_id"], ["n"])) and got.columns == held.columns


def test_ids_are_counted_once_without_dealing_the_rows(spark, frame):
    data = [("a", "TX", "1", 5), ("a", "TX", "1", 6), ("a", "TX", None, 1), ("a", "TX", None, 1), ("a", None, "1", 2), ("a", None, "2", 2), ("bb", "TX", "1", None), ("bb", "", None, 4)]
    for chosen in (data, data[4:], data[-1:], []):
        held = frame(chosen, "name_normalized string, state string, violation_no string, proposed_penalty int")
        want = held.groupBy("name_normalized", "state").agg(F.count_distinct("violation_no").alias("n"), F.sum("proposed_penalty").alias("total"))
        marked = picks.counted_once(held, ["name_normalized", "state"], "violation_no", "counts")
        got = marked.groupBy("name_normalized", "state").agg(F.sum("counts").alias("n"), F.sum("proposed_penalty").alias("total"))
        assert rows(got) == rows(want)
    totals = profile.mine_totals(held)
    assert "REPARTITION_BY_COL" not in totals._jdf.queryExecution().executedPlan().toString()


def test_bulk_names_meet_by_the_number_of_the_employer(spark, monkeypatch):
    """Ties go to the least id, and an employer of two snapshots counts as of the newest."""
    served = spark.createDataFrame(
        [("e2", "ACME", "TX", "7", "X", 1), ("e1", "ACME", "TX", "8", "Y", 1), ("e0", "ACME", "TX", "9", "Z", 1), ("e0", "OTHER THING", "TX", "9", "Z", 2)],
        "employer_id string, employer_name string, state string, zip string, city string, snapshot_date int",
    )
    asked = spark.createDataFrame([(1, "acme", None), (2, "acme", "7"), (3, "other thing", "9"), (4, "zzz", None)], "lookup_id long, name string, zip string")
    seen, best = [], lookup.best_matches

    def kept(asked, held, *rest):
        seen.append(dict(held.dtypes))
        return best(asked, held, *rest)

    monkeypatch.setattr(lookup, "best_matches", kept)
    assert rows(lookup.resolve_lookups(asked, served)) == [(1, "e1", 1.0), (2, "e2", 1.0), (3, "e0", 1.0), (4, None, None)]
    assert [(sorted(x), x["at"]) for x in seen] == [(["at", "block", "t_name"], "bigint")]


def test_classes_are_linked_by_number_and_named_by_the_least_id(spark, frame, monkeypatch):
    fields = "unique_id string, name_normalized string, name_prefix string, zip5 string, site_state string, naics_4digit string, address_key string"
    one, other, far = (("ACME STEEL", "ACME", z, "TX", "2301", a) for z, a in (("1", "x"), ("1", "y"), ("9", "z")))
    near = [("b", *one), ("c", *other), ("c", *far), ("d", *one), ("e", *far), (None, *other)]
    noise = [(f"n{k:03d}", f"N{k} WORKS", f"N{k}"[:4], str(100 + k), f"S{k}", str(4000 + k), f"p{k}") for k in range(60)]
    held = frame(near + noise, fields)
    seen, star = [], linkage.star_edges

    def kept(keyed, *rest):
        seen.append(dict(keyed.dtypes))
        return star(keyed, *rest)

    monkeypatch.setattr(linkage, "star_edges", kept)
    got = sorted({(r.unique_id or "", r.cluster_id) for r in linkage.cluster_records(held).collect()})
    # Nothing but the id "c" links the records that are far from the others.
    assert got == sorted({(u or "", "b") for u, *_ in near} | {(u, u) for u, *_ in noise})
    assert seen[0]["at"] == "bigint" and seen[0]["key"] == "binary"


def broadcast(df):
    """Whether Spark plans to broadcast files of some KB. What comes from a join is taken for larger."""
    conf, name = df.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
    usual = conf.get(name)
    conf.set(name, "50k")
    try:
        return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set(name, usual)


def written(folder, **tables):
    """The tables as short Parquet files, which Spark would broadcast."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    return [df.sparkSession.read.parquet(f"{folder}/{name}") for name, df in tables.items()]


def test_link_keys_and_records_are_never_broadcast_for_clusters(frame, tmp_path):
    fields = "unique_id string, name_normalized string, name_prefix string, zip5 string, site_state string, naics_4digit string, address_key string"
    (records,) = written(tmp_path, records=frame([(f"r{k}", f"N{k % 5} WORKS", f"N{k % 5} W", "1", "TX", "2301", "a") for k in range(40)], fields))
    evidence = linkage.evidence_of(records)
    (classes,) = written(tmp_path, classes=linkage.linkage_classes(records))
    keyed = linkage.link_keys(classes, evidence, linkage.CLUSTER_THRESHOLD, "rep")
    assert broadcast(keyed.join(records, keyed.rep == records.unique_id))  # files as short as this are, unless told otherwise
    assert not broadcast(linkage.star_edges(keyed, "rep"))
    (labelled,) = written(tmp_path, labelled=classes.select("signature", F.col("rep").alias("class_cluster")))
    found = linkage.records_in_classes(records, labelled, evidence, linkage.CLUSTER_THRESHOLD)
    assert not broadcast(found) and found.count() == 40


def test_records_are_never_broadcast_when_names_merge(frame, tmp_path):
    clusters, records = written(
        tmp_path,
        clusters=frame([("1", "x"), ("2", "x"), ("3", "y")], "unique_id string, cluster_id string"),
        records=frame([("1", "ACME"), ("2", "ACME"), ("3", "ACME")], "unique_id string, name_normalized string"),
    )
    merged = linkage.merge_same_names(clusters, records)
    assert not broadcast(merged) and rows(merged) == [("1", "x"), ("2", "x"), ("3", "x")]


def test_members_and_ids_are_never_broadcast_for_stable_ids(frame, tmp_path, monkeypatch):
    ids, before, after = written(
        tmp_path,
        ids=frame([("e1", "x"), ("e2", "y")], "employer_id string, cluster_id string"),
        before=frame([("1", "x"), ("2", "x"), ("3", "y")], "unique_id string, cluster_id string"),
        after=frame([("1", "x"), ("2", "x"), ("3", "x")], "unique_id string, cluster_id string"),
    )
    seen, cut = [], stable_ids.cut_lineage

    def kept(df):
        seen.append(broadcast(df))
        return cut(df)

    monkeypatch.setattr(stable_ids, "cut_lineage", kept)
    new = stable_ids.assign_stable_ids(ids, before, after)
    assert rows(new) == [("e1", "x")] and not seen[0]
    (active,) = written(tmp_path, active=new)
    retired = stable_ids.retire_ids(ids, before, active, after)
    assert not broadcast(retired) and rows(retired) == [("e2", "y", "e1")]


def test_clusters_and_inspections_are_never_broadcast_for_audits(frame, tmp_path):
    clusters, held = written(
        tmp_path,
        clusters=frame([(f"r{k}", f"c{k}") for k in range(6)], "unique_id string, cluster_id string"),
        held=frame([(f"r{k}", "Acme", "ACME STEEL", "TX") for k in range(6)], "activity_nr string, estab_name string, name_normalized string, site_state string"),
    )
    spread, watched, merged = audit.under_merged(clusters, held), audit.watch_list(clusters, held, ["ACME"]), audit.over_merged(clusters, held)
    assert not broadcast(spread) and not broadcast(watched) and not broadcast(merged)
    assert rows(spread) == [("ACME STEEL", 6, 6)] and rows(watched) == [("ACME", 6, 6, 1, True)] and rows(merged) == []


def test_blocking_values_are_counted_once_and_never_glued(spark, frame):
    """Columns group as they are: values that read alike side by side make no pair, and null differs from ''."""
    record = "unique_id string, name_normalized string, name_prefix string, zip5 string, site_state string, naics_4digit string, address_key string"
    glued = [("1", "x", "A\u0001B", None, "C", None, None), ("2", "x", "A", None, "B\u0001C", None, None)]
    assert [r.pairs for r in linkage.candidate_pair_counts(frame(glued, record)).collect() if r.pairs] == []
    rows = [(str(i), "x", "ABCD", z, s, n, None) for i, (z, s, n) in enumerate(itertools.product(["1", "", None], ["S", "", None], ["2", "", None]))] * 3
    equal = lambda l, r, k: l[k] is not None and l[k] == r[k]
    counts = {}
    for l, r in itertools.combinations(rows, 2):
        rule = 1 if equal(l, r, 3) else 2 if equal(l, r, 4) else 3 if equal(l, r, 5) else None
        counts[rule] = counts.get(rule, 0) + 1
    counts.pop(None)
    counted = linkage.candidate_pair_counts(frame(rows, record))
    assert {r.match_rule: r.pairs for r in counted.collect()} == counts
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Expand"):]  # what is spread over the terms has been counted before
    assert "Aggregate" in below and "Generate" not in below


def test_latest_per_employer_and_page(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 1, 7.0)], "employer_id string, snapshot_date int, risk_score double")
    assert rows(picks.latest_per_employer(df)) == [("a", 2, None), ("b", 1, 7.0)]
    got = picks.page(df, [F.desc_nulls_last("risk_score"), F.asc("employer_id")], limit=1, offset=1)
    assert [tuple(r) for r in got.collect()] == [("a", 1, 5.0, 3)]


def test_components_do_not_depend_on_order_or_partitions(spark):
    rng = random.Random(5)
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in ((rng.randint(0, 119), rng.randint(0, 119)) for _ in range(70))]
    edges += [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(40)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    want = {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in edges)}
    for parts in (1, 7):
        rng.shuffle(edges)
        df = spark.createDataFrame(edges, "a string, b string").repartition(parts)
        got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
        assert got == want


# --- linkage ---

RECORD = "unique_id string, source string, name_normalized string, name_prefix string, zip5 string, site_state string, naics_4digit string, address_key string"


def random_records(seed, n=150):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        name = rng.choice(["ACME", "ACME ROOFING", "BOLT", "BOLTON", "ZED", "ACMEX"])
        pick = lambda values, missing: None if rng.random() < missing else rng.choice(values)
        out.append(
            (f"r{k:03d}", "OSHA", name, name[:4], pick(["1", "2", "3", ""], 0.2), pick(["ID", "WA", "OR"], 0.1),
             pick(["2381", "2382"], 0.4), pick(["k1", "k2", "k3", "k4"], 0.5))
        )
    return out


def brute_force(records, evidence):
    """All blocked pairs with their probability."""
    at = {"name_normalized": 2, "name_prefix": 3, "zip5": 4, "site_state": 5, "naics_4digit": 6, "address_key": 7}
    same = lambda l, r, f: l[at[f]] is not None and l[at[f]] == r[at[f]]
    found = {}
    for l, r in itertools.combinations(records, 2):
        rule = next((k for k, fs in enumerate(linkage.BLOCKING_RULES, 1) if all(same(l, r, f) for f in fs)), None)
        if rule:
            agree = frozenset(f for f in linkage.FIELDS if same(l, r, f))
            differ = frozenset(
                f for f in linkage.FIELDS if l[at[f]] is not None and r[at[f]] is not None and not same(l, r, f)
            )
            found[l[0], r[0]] = (rule, 1 / (1 + 2 ** -evidence.score(agree, differ)))
    return found


@pytest.mark.parametrize("seed, prior", [(1, 0.05), (2, 0.2), (3, 0.01), (4, 0.002)])
def test_pairs_and_clusters_equal_brute_force(spark, seed, prior):
    records = random_records(seed)
    df = spark.createDataFrame(records, RECORD)
    evidence = linkage.evidence_of(df, prior=prior)
    pairs = brute_force(records, evidence)

    counts = {}
    for rule, _ in pairs.values():
        counts[rule] = counts.get(rule, 0) + 1
    assert {r.match_rule: r.pairs for r in linkage.candidate_pair_counts(df).collect()} == counts

    rep = {}
    for r in records:
        rep.setdefault(r[2:], r[0])
    of = {r[0]: rep[r[2:]] for r in records}
    want = {}
    for (a, b), (rule, p) in pairs.items():
        if p >= 0.8 - 1e-12:
            key = tuple(sorted((of[a], of[b])))
            want[key] = (want.get(key, (0, 0, 0))[0] + 1, rule, round(p, 9))
    got = linkage.scored_pairs(df, evidence=evidence, rows_per_cell=3)
    assert {(r.rep_l, r.rep_r): (r.pairs, r.match_rule, round(r.match_probability, 9)) for r in got.collect()} == want

    label = {r[0]: r[0] for r in records}
    links = [k for k, (_, p) in pairs.items() if p >= 0.85]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    assert {r.unique_id: r.cluster_id for r in linkage.cluster_records(df, evidence=evidence).collect()} == label


def test_review_queue_takes_the_least_certain_below_the_cluster_threshold(spark):
    pairs = spark.sql(
        "SELECT * FROM VALUES ('a', 'b', 2L, 0.84D), ('a', 'c', 1L, 0.80D), ('b', 'c', 1L, 0.85D), ('c', 'd', 1L, 0.80D) "
        "t(rep_l, rep_r, pairs, match_probability)"
    )
    got = [(r.record_id_left, r.record_id_right) for r in linkage.review_queue(pairs, k=2).collect()]
    assert got == [("a", "c"), ("c", "d")]
    assert linkage.review_queue(pairs).count() == 3


def test_stars_of_touched_groups_only(frame):
    members = [(0, "p", "a", 0, False, False), (0, "p", "b", 0, False, True), (0, "q", "c", 0, False, False), (0, "q", "d", 0, False, False),
               (1, "r", "e", 0, True, True), (2, "s", "f", 0, True, False), (2, "s", "g", 1, True, True)]
    keyed = frame(members, "rule int, key string, node string, side int, crosses boolean, loose boolean")
    assert rows(linkage.star_edges(keyed, "node", touched="loose")) == [("b", "a"), ("f", "g"), ("g", "f")]
    assert rows(linkage.star_edges(keyed, "node")) == [("b", "a"), ("d", "c"), ("f", "g"), ("g", "f")]


def test_merge_same_names_moves_to_the_largest(spark):
    records = spark.createDataFrame([(str(k), n) for k, n in enumerate(["A", "A", "A", "B", "A", "B"])], "unique_id string, name_normalized string")
    clusters = spark.createDataFrame([("0", "x"), ("1", "x"), ("2", "y"), ("3", "y"), ("4", "z"), ("5", "w")], "unique_id string, cluster_id string")
    got = {r.unique_id: r.cluster_id for r in linkage.merge_same_names(clusters, records).collect()}
    # y holds A and B once each: the tie goes to A, so y and z join x.
    assert got == {"0": "x", "1": "x", "2": "x", "3": "x", "4": "x", "5": "w"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stable_ids_equal_one_after_another(spark, seed):
    rng = random.Random(seed)
    members = [f"m{k:02d}" for k in range(60)]
    old = {m: f"c{rng.randint(0, 11)}" for m in members}
    new = {m: (f"c{rng.randint(0, 14)}" if rng.random() < 0.4 else old[m]) for m in members}
    ids = {c: f"id-{c}" for c in sorted(set(old.values()))}
    clusters = {}
    for m, c in new.items():
        clusters.setdefault(c, []).append(m)
    want, claimed = {}, set()
    for c in sorted(clusters, key=lambda c: (-len(clusters[c]), c)):
        shared = {}
        for m in clusters[c]:
            shared[ids[old[m]]] = shared.get(ids[old[m]], 0) + 1
        top = min(shared, key=lambda i: (-shared[i], i))
        wish = next((w for w in [ids.get(c), top] if w and w not in claimed), None)
        want[c] = wish
        claimed.add(wish)
    got = stable_ids.assign_stable_ids(
        spark.createDataFrame([(i, c) for c, i in ids.items()], "employer_id string, cluster_id string"),
        spark.createDataFrame(list(old.items()), "unique_id string, cluster_id string"),
        spark.createDataFrame(list(new.items()), "unique_id string, cluster_id string"),
    )
    found = {r.cluster_id: r.employer_id for r in got.collect()}
    assert len(set(found.values())) == len(found)
    assert {c: (i if i.startswith("id-") else None) for c, i in found.items()} == want


# --- bulk lookup, history, quality ---


def test_lookup_priority_and_unmatched(spark):
    served = spark.sql(
        """SELECT * FROM VALUES ('e1', DATE'2024-01-01', 'Acme Roofing', 'Boise', 'ID', '83702', 'E1', 10D),
  ('e2', DATE'2024-01-01', 'Acme Roofing', 'Seattle', 'WA', '98101', 'E1', 20D),
  ('e3', DATE'2024-01-01', 'Zed Steel', 'Boise', 'ID', '83702', NULL, 5D)
  t(employer_id, snapshot_date, employer_name, city, state, zip, ein, risk_score)"""
    )
    asked = spark.sql(
        """SELECT * FROM VALUES (1, 'anything', 'E1', 'e3', NULL, NULL, NULL), (2, 'Zed', 'E1', '', NULL, NULL, NULL),
  (3, 'Zed', 'E1', NULL, 'id', NULL, NULL), (4, 'acme rofing', NULL, NULL, NULL, NULL, NULL),
  (5, 'acme rofing', ' ', NULL, ' wa', NULL, NULL), (6, 'acme rofing', NULL, NULL, NULL, '83702-1', NULL),
  (7, 'acme rofing', NULL, NULL, NULL, NULL, 'seatle'), (8, 'nobody', NULL, NULL, NULL, NULL, NULL),
  (9, '', NULL, NULL, NULL, NULL, NULL), (10, 'Zed', 'E9', NULL, NULL, NULL, NULL)
  t(lookup_id, name, ein, employer_id, state, zip, city)"""
    )
    got = {r.lookup_id: (r.employer_id, r.similarity is None) for r in lookup.resolve_lookups(asked, served).collect()}
    assert got == {
        1: ("e3", True), 2: ("e2", True), 3: ("e1", True), 4: ("e1", False), 5: ("e2", False), 6: ("e1", False),
        7: ("e2", False), 8: (None, True), 9: (None, True), 10: (None, True),
    }


def test_retention(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2020-12-25', DATE'2024-06-30')) AS snapshot_date")
    kept = {str(r[0]) for r in history.retained_history(days, "2024-06-30").collect()}
    assert "2024-04-01" in kept and "2024-03-31" in kept and "2024-03-30" not in kept
    assert "2023-07-02" in kept and "2023-06-25" not in kept
    assert "2021-07-01" in kept and "2021-06-01" not in kept


def test_change_events_skip_paused_and_uninterested(spark):
    changes = spark.sql("SELECT 'e1' AS employer_id, 'A' AS employer_name, 'HIGH' AS new_tier, 'LOW' AS old_tier, DATE'2024-01-01' AS snapshot_date")
    subscriptions = spark.sql(
        """SELECT * FROM VALUES ('s1', 1, array('e1', 'e1', 'e2'), array('risk_tier_change'), 'active'),
  ('s2', 1, array('e1'), array('risk_tier_change'), 'paused'), ('s3', 1, array('e1'), array('x'), 'active')
  t(id, customer_id, employer_ids, events, status)"""
    )
    assert [r.subscription_id for r in history.change_events(changes, subscriptions).collect()] == ["s1"]


def test_nested_inspections_page_their_violations_and_keep_all(spark):
    detail = spark.sql("SELECT 'e' AS employer_id, 'a' AS activity_nr, 'A' AS insp_type, DATE'2024-01-01' AS open_date")
    violations = spark.range(100).selectExpr(
        "'a' AS activity_nr", "cast(id % 50 as string) AS citation_id", "'S' AS viol_type", "cast(1 as decimal(18,3)) AS current_penalty",
        "DATE'2024-01-01' AS issuance_date",
    )
    got = reports.nested_inspections(detail, violations, page_size=10)
    assert sorted(r.page for r in got.collect()) == [0, 1, 2, 3, 4]
    assert got.selectExpr("explode(violations) v").selectExpr("sum(v.times)").first()[0] == 100


def test_gate(spark):
    checks = spark.sql("SELECT 'a' AS check_name, 'CRITICAL' AS severity, true AS passed, 1D AS value")
    quality.enforce_gate(checks)
    with pytest.raises(quality.GateFailed):
        quality.enforce_gate(checks.withColumn("passed", F.lit(False)))
    quality.enforce_gate(checks.withColumn("passed", F.lit(False)).withColumn("severity", F.lit("WARNING")))


@pytest.mark.parametrize("encoding", ["utf-8-sig", "latin-1"])
def test_uploads_in_either_encoding(spark, tmp_path, encoding):
    (tmp_path / "upload.csv").write_bytes("Name,City\nCafé Müller,Zürich\n".encode(encoding))
    rows = delimited.read_lookups(spark, str(tmp_path / "upload.csv"))
    assert rows.columns == ["Name", "City"] and tuple(rows.first()) == ("Café Müller", "Zürich")


def test_rows_without_key_are_no_repeats(spark, frame):
    rows = frame([(None, "A", 1), (None, "B", 1), ("1", "A", 1), ("1", "B", 2), (None, "B", 1)], "activity_nr string, estab_name string, n int")
    kept = staging.drop_repeats(rows, ["activity_nr"]).collect()
    assert sorted((r.activity_nr or "", r.estab_name) for r in kept) == [("", "A"), ("", "B"), ("", "B"), ("1", "B")]


def test_a_chain_of_displaced_clusters_settles(spark, frame):
    """The largest cluster takes the first id, its holder then the second, and so on: a round for each."""
    count = 12
    ids = frame([(f"c{i:02d}", f"e{i:02d}") for i in range(count + 1)], "cluster_id string, employer_id string")
    before, after = [], []
    for i in range(-1, count):  # cluster c_i shares its members with the former c_(i+1)
        for k in range(2 * (count - i)):
            before.append((f"u{i}_{k}", f"c{i + 1:02d}"))
            after.append((f"u{i}_{k}", f"c{i:02d}" if i >= 0 else "new"))
    clusters = "unique_id string, cluster_id string"
    got = {r.cluster_id: r.employer_id for r in stable_ids.assign_stable_ids(ids, frame(before, clusters), frame(after, clusters)).collect()}
    assert got == {"new": "e00"} | {f"c{i:02d}": f"e{i + 1:02d}" for i in range(count)}


def test_sums_of_a_two_day_run_are_compared_once(spark, frame):
    profile = frame([("HIGH", None), ("LOW", "p")], "risk_tier string, parent_name string")
    checks = quality.tier_distribution(profile)
    written = quality.with_profile_metrics(checks, profile)
    names = [r.check_name for r in quality.run_over_run(quality.profile_metrics(profile), written).collect()]
    assert len(names) == len(set(names)) and "risk_tier_HIGH_change" in names
