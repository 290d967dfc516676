"""Search, direct lookup, parent roll-up and bulk enrichment over the served profile.

``profile`` is the serving table: one row per employer and ``snapshot_date``,
with ``zip`` (see sources.publishing). ``ein`` is optional.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.labels import match_confidence, risk_note
from riskloom.functions.scoring import confidence_rank
from riskloom.functions.similarity import trigram_similarity
from riskloom.operators.matching import best_matches, similar_pairs
from riskloom.operators.picks import at_latest_snapshot, latest_per_employer, newest_rows, page, sorting
from riskloom.session import stored
from riskloom.sources.name_index import similar_rows

# --- Fixed values: similarity thresholds of the served queries ---
SHORT_NAME_LENGTH = 6
SHORT_NAME_THRESHOLD = 0.15
NAME_THRESHOLD = 0.25
PARENT_THRESHOLD = 0.5
BULK_NAME_THRESHOLD = 0.3
BULK_CITY_THRESHOLD = 0.4
ADDRESS_NAME_THRESHOLD = 0.9
# --- end of fixed values ---

RESULT_COLUMNS = [
    "employer_id", "match_confidence", "risk_tier", "risk_score", "osha_inspections", "osha_violations",
    "osha_total_penalties", "location_count", "trend_signal", "matched_name", "matched_address", "matched_city",
    "matched_state", "matched_zip",
]


def _place_filter(profile: DataFrame, state: str | None, zip_code: str | None, naics: str | None = None) -> DataFrame:
    if state:
        profile = profile.filter(F.col("state") == state.upper())
    if zip_code:
        profile = profile.filter(F.col("zip") == zip_code.strip()[:5])
    if naics:
        profile = profile.filter(F.col("naics_code").startswith(naics))
    return profile


def _worst_first() -> list[Column]:
    return [F.desc_nulls_last("risk_score"), F.asc("employer_id")]


def with_risk_note(rows: DataFrame) -> DataFrame:
    return rows.withColumn("risk_note", risk_note(F.col("osha_inspections"), F.col("risk_score")))


def search_by_ein(
    profile: DataFrame, ein: str, state: str | None = None, zip_code: str | None = None, limit: int = 20, offset: int = 0
) -> DataFrame:
    hits = _place_filter(profile.filter(F.col("ein") == ein), state, zip_code)
    return page(with_risk_note(latest_per_employer(hits)), _worst_first(), limit, offset)


def search_by_name(
    profile: DataFrame,
    name: str,
    state: str | None = None,
    zip_code: str | None = None,
    naics: str | None = None,
    limit: int = 20,
    offset: int = 0,
    min_confidence: str | None = None,
    index: str | None = None,
) -> DataFrame:
    """Employers whose name resembles ``name``: most similar first, then riskiest, then most inspected.

    With the folder of a name index (sources.name_index) only names that it lets through are compared.
    """
    hits = name_hits(profile, name, state, zip_code, naics, min_confidence, index)
    return page(hits, sorting(HIT_ORDER), limit, offset)


def name_hits(
    profile: DataFrame, name: str, state: str | None = None, zip_code: str | None = None, naics: str | None = None,
    min_confidence: str | None = None, index: str | None = None,
) -> DataFrame:
    """All rows of a search by name, in no order."""
    threshold = SHORT_NAME_THRESHOLD if len(name) < SHORT_NAME_LENGTH else NAME_THRESHOLD
    placed = _place_filter(profile, state, zip_code, naics)
    if index:
        near = similar_rows(placed, index, name, threshold)
    else:
        near = placed.withColumn("sim_score", trigram_similarity(F.col("employer_name"), F.lit(name))).filter(F.col("sim_score") > threshold)
    hits = latest_per_employer(near)
    if min_confidence:
        hits = hits.filter(confidence_rank(F.col("confidence_tier")) >= confidence_rank(F.lit(min_confidence)))
    return with_risk_note(hits)


# Whether each column of the order of hits descends.
HIT_ORDER = {"sim_score": True, "risk_score": True, "osha_inspections": True, "employer_id": False}


def search_ranked(
    profile: DataFrame, name: str, ein: str | None = None, address_key: str | None = None, limit: int = 20, index: str | None = None
) -> DataFrame:
    """Ranking chain: tax number, then address key with a near-equal name, then similarity, then latest inspection."""
    similarity = trigram_similarity(F.col("employer_name"), F.lit(name))
    same_ein = F.coalesce(F.col("ein") == F.lit(ein), F.lit(False)) if ein else F.lit(False)
    same_place = F.coalesce(F.col("address_key") == F.lit(address_key), F.lit(False)) if address_key else F.lit(False)
    near = similar_rows(profile, index, name, NAME_THRESHOLD, also=same_ein) if index else profile.withColumn("sim_score", similarity)
    ranked = near.withColumn(
        "match_rank",
        F.when(same_ein, 1).when(same_place & (F.col("sim_score") > ADDRESS_NAME_THRESHOLD), 2)
        .when(F.col("sim_score") > NAME_THRESHOLD, 3),
    )
    order = [
        F.asc("match_rank"), F.desc("sim_score"), F.desc_nulls_last("osha_open_date_latest"), F.asc("employer_id")
    ]
    return latest_per_employer(ranked.filter(F.col("match_rank").isNotNull())).orderBy(*order).limit(limit)


# --- parent roll-up ---


def employers_of_parent(profile: DataFrame, parent: str, state: str | None = None) -> DataFrame:
    """Newest rows under a parent name; names alike are taken only when no name is equal."""
    placed = _place_filter(profile, state, None)
    equal = F.col("parent_name") == parent
    exact_hits = at_latest_snapshot(profile)
    exact_hits = _place_filter(exact_hits, state, None).filter(equal).agg(F.count(F.lit(1))).scalar()
    alike = trigram_similarity(F.col("parent_name"), F.lit(parent)) > PARENT_THRESHOLD
    # Two branches: the equality reaches the scan, and the similarity runs only where no name is equal.
    fuzzy = placed.filter(exact_hits == 0).filter(alike & ~equal)
    return latest_per_employer(placed.filter(equal).unionByName(fuzzy))


def _rollup_measures() -> list[Column]:
    def tier(name: str) -> Column:
        return F.count_if(F.col("risk_tier") == name).alias(f"{name.lower()}_count")

    def trend(name: str) -> Column:
        return F.count_if(F.col("trend_signal") == name).alias(f"{name.lower()}_count")

    return [
        F.count(F.lit(1)).alias("total_locations"),
        F.sum("osha_inspections").alias("total_inspections"),
        F.sum("osha_violations").alias("total_violations"),
        F.sum("osha_total_penalties").alias("total_penalties"),
        F.round(F.avg("risk_score"), 1).alias("avg_risk_score"),
        F.max("risk_score").alias("max_risk_score"),
        F.min("risk_score").alias("min_risk_score"),
        tier("HIGH"), tier("ELEVATED"), tier("MEDIUM"), tier("LOW"),
        trend("WORSENING"), trend("IMPROVING"),
    ]


def _with_stable(rollup: DataFrame) -> DataFrame:
    steady = F.col("total_locations") - F.col("worsening_count") - F.col("improving_count")
    return rollup.withColumn("stable_count", steady)


def parent_rollup(profile: DataFrame, parent: str, state: str | None = None) -> DataFrame:
    """One row of totals over a parent's employers."""
    return _with_stable(employers_of_parent(profile, parent, state).agg(*_rollup_measures()))


def parent_rollups(profile: DataFrame) -> DataFrame:
    """The same totals for every parent at once."""
    newest = newest_rows(profile.filter(F.col("parent_name").isNotNull()))
    return _with_stable(newest.groupBy("parent_name").agg(*_rollup_measures()))


def parent_states(profile: DataFrame, parent: str, state: str | None = None) -> DataFrame:
    rows = employers_of_parent(profile, parent, state).filter(F.col("state").isNotNull())
    counted = rows.groupBy("state").agg(F.count(F.lit(1)).alias("location_count"))
    return counted.orderBy(F.desc("location_count"), "state")


def parent_locations(
    profile: DataFrame, parent: str, state: str | None = None, limit: int = 20, offset: int = 0
) -> DataFrame:
    return page(employers_of_parent(profile, parent, state), _worst_first(), limit, offset)


# --- lookup by id ---


def lookup_by_id(profile: DataFrame, mapping: DataFrame, wanted: DataFrame) -> DataFrame:
    """Profile rows for ``wanted`` ids; an id that another one replaced is followed once and flagged."""
    moves = (
        mapping.filter(F.col("superseded_by").isNotNull())
        .groupBy("employer_id")
        .agg(F.min("superseded_by").alias("superseded_by"))
    )
    asked = wanted.select(F.col("employer_id").alias("requested_id")).distinct()
    routed = asked.join(moves, asked.requested_id == moves.employer_id, "left").select(
        "requested_id",
        F.coalesce("superseded_by", "requested_id").alias("employer_id"),
        F.col("superseded_by").isNotNull().alias("redirected"),
    )
    return routed.join(newest_rows(profile), "employer_id", "left")


# --- bulk enrichment ---


def _clean(column: str) -> Column:
    """Trimmed text; blank counts as absent."""
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def _marked(*columns: Column) -> Column:
    """One text out of several nullable ones that keeps null apart from ''."""
    parts = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in columns]
    return F.concat_ws("\u0001", *parts)


def _queries(lookups: DataFrame) -> DataFrame:
    """Lookups in matching form. Optional columns may be missing."""
    given = {c: _clean(c) if c in lookups.columns else F.lit(None).cast("string") for c in ("name", "ein", "employer_id", "state", "zip", "city")}
    return lookups.select(
        "lookup_id",
        given["name"].alias("q_name"),
        given["ein"].alias("q_ein"),
        given["employer_id"].alias("q_employer_id"),
        F.upper(given["state"]).alias("q_state"),
        F.left(given["zip"], F.lit(5)).alias("q_zip"),
        F.upper(given["city"]).alias("q_city"),
    )


def _ein_choices(newest: DataFrame) -> DataFrame:
    """The riskiest employer per tax number, per tax number and state, and so on.

    One row per key stands for all employers that share it, so a tax number held
    by a third of all employers still joins as a single row.
    """
    ein, state, zip_code = F.col("ein"), F.col("state"), F.col("zip")
    nothing = F.lit(None).cast("string")
    keyed = newest.filter(ein.isNotNull()).select(
        F.explode(
            F.array(
                _marked(ein, nothing, nothing), _marked(ein, state, nothing),
                _marked(ein, nothing, zip_code), _marked(ein, state, zip_code),
            )
        ).alias("ein_key"),
        F.struct(F.coalesce("risk_score", F.lit(-1.0)).alias("score"), F.col("employer_id")).alias("candidate"),
    )
    best = F.min_by("candidate.employer_id", F.struct(-F.col("candidate.score"), F.col("candidate.employer_id")))
    return keyed.groupBy("ein_key").agg(best.alias("employer_id"))


def _block(state: Column, zip_code: Column, city: Column) -> Column:
    return _marked(state, zip_code, city)


def _place_blocks(state: Column, zip_code: Column, city: Column) -> Column:
    """Every way to narrow by state, zip and city."""
    nothing = F.lit(None).cast("string")
    return F.array_distinct(F.array(*[_block(s, z, c) for s in (nothing, state) for z in (nothing, zip_code) for c in (nothing, city)]))


def _name_choices(queries: DataFrame, newest: DataFrame) -> DataFrame:
    """Most similar employer per distinct (name, state, zip, city) query.

    A query's state, zip and city form its block; a city stands for all cities like it,
    which are found once per distinct city, so such a query has a block for each of
    them and names never meet the cities of other names. Of the employers that share
    name and block only the least id can win, so only that one is kept. Until they have
    won, employers go by their place in the order of ids, a number much shorter than an id.
    """
    newest = newest.select("employer_id", "employer_name", "state", "zip", "city").orderBy("employer_id")
    newest = stored(newest.withColumn("at", F.when(F.col("employer_id").isNotNull(), F.monotonically_increasing_id())), "newest-employers")
    asked = queries.select("q_name", "q_state", "q_zip", "q_city").distinct().withColumn("query_key", _query_key())
    cities = similar_pairs(
        asked.select("q_city").filter("q_city IS NOT NULL").distinct(), newest.select(F.col("city").alias("t_city")).distinct(),
        "q_city", "t_city", BULK_CITY_THRESHOLD,
    ).select("q_city", "t_city")
    anywhere = asked.filter("q_city IS NULL").withColumn("t_city", F.lit(None).cast("string"))
    somewhere = asked.filter("q_city IS NOT NULL").join(cities, "q_city")
    asked = anywhere.unionByName(somewhere).withColumn("block", _block(F.col("q_state"), F.col("q_zip"), F.col("t_city")))
    held = newest.select(
        F.lower("employer_name").alias("t_name"), "at", F.explode(_place_blocks(F.col("state"), F.col("zip"), F.col("city"))).alias("block")
    )
    held = held.join(asked.select("block").distinct(), "block", "left_semi").groupBy("block", "t_name").agg(F.min("at").alias("at"))
    best = best_matches(asked, held, "q_name", "t_name", "query_key", "at", BULK_NAME_THRESHOLD, "block")
    return best.join(newest.select("at", "employer_id"), "at", "left").select("query_key", "employer_id", "similarity")


def _query_key() -> Column:
    return _marked(*[F.col(c) for c in ("q_name", "q_state", "q_zip", "q_city")])


def resolve_lookups(lookups: DataFrame, profile: DataFrame) -> DataFrame:
    """Best employer per lookup row: (lookup_id, employer_id, similarity), nulls where nothing matches.

    An id decides alone; else the tax number decides alone (highest score within
    state and zip, if given); else the most similar name. Ties go to the least id.
    """
    return _resolved(lookups, newest_rows(profile))


def _resolved(lookups: DataFrame, newest: DataFrame) -> DataFrame:
    """``resolve_lookups`` on a profile of one row per employer."""
    queries = _queries(lookups)
    by_id = F.col("q_employer_id").isNotNull()
    by_ein = ~by_id & F.col("q_ein").isNotNull()
    by_name = ~by_id & ~by_ein & F.col("q_name").isNotNull()

    known = newest.select("employer_id").withColumn("q_employer_id", F.col("employer_id"))
    no_score = F.lit(None).cast("double").alias("similarity")
    hits = [
        queries.filter(by_id).join(known, "q_employer_id").select("lookup_id", "employer_id", no_score),
    ]
    if "ein" in newest.columns:
        keyed = queries.filter(by_ein).withColumn("ein_key", _marked(F.col("q_ein"), F.col("q_state"), F.col("q_zip")))
        hits.append(keyed.join(_ein_choices(newest), "ein_key").select("lookup_id", "employer_id", no_score))
    named = queries.filter(by_name)
    keyed = named.withColumn("query_key", _query_key())
    hits.append(
        keyed.join(_name_choices(named, newest), "query_key").select("lookup_id", "employer_id", "similarity")
    )
    matched = hits[0]
    for more in hits[1:]:
        matched = matched.unionByName(more)
    return queries.select("lookup_id").join(matched, "lookup_id", "left")


def enrich_lookups(lookups: DataFrame, profile: DataFrame) -> DataFrame:
    """All lookup columns plus RESULT_COLUMNS; ``lookup_id`` must be unique."""
    newest = newest_rows(profile)
    shown = newest.select(
        "employer_id", "risk_tier", "risk_score", "osha_inspections", "osha_violations", "osha_total_penalties",
        "location_count", "trend_signal",
        F.col("employer_name").alias("matched_name"), F.col("address").alias("matched_address"),
        F.col("city").alias("matched_city"), F.col("state").alias("matched_state"), F.col("zip").alias("matched_zip"),
    )
    resolved = (
        _resolved(lookups, newest)
        .withColumn("match_confidence", match_confidence(F.col("employer_id").isNotNull(), F.col("similarity")))
        .join(shown, "employer_id", "left")
        .select("lookup_id", F.struct(*RESULT_COLUMNS).alias("result"))
    )
    return lookups.join(resolved, "lookup_id").select(
        *[lookups[c].alias(f"lookup_{c}" if c in RESULT_COLUMNS else c) for c in lookups.columns],
        *[F.col(f"result.{c}").alias(c) for c in RESULT_COLUMNS],
    )


def match_summary(enriched: DataFrame) -> DataFrame:
    confidence = F.col("match_confidence")
    return enriched.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(confidence).alias("matched"),
        F.count_if(confidence.isNull()).alias("unmatched"),
        *[F.count_if(confidence == c).alias(f"{c}_count") for c in ("exact", "high", "medium", "low")],
    )
