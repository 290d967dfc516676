"""Every operator as a query over whole tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import codes, dates, headers, labels, names, scoring, similarity
from riskloom.functions.address import address_key
from riskloom.operators import (
    audit, history, linkage, lookup, picks, prefixes, profile, quality, reference_data, reports, silver, stable_ids,
    staging,
)
from riskloom.operators.matching import similar_pairs
from riskloom.plans import oracle as o
from riskloom.plans.inputs import Inputs
from riskloom.plans.linkage_run import read_linkage, run_linkage
from riskloom.plans.oracle import AS_OF
from riskloom.plans.upload import enrich_upload
from riskloom.session import cut_lineage, scratch_path
from riskloom.sources import delimited, layout, ownership, publishing, snapshots
from riskloom.sources.commits import CommitLog

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, columns: str, sql: str | None = None):
    """Register ``build(inputs)`` under ``name``; both engines return ``columns`` (see oracle.output)."""

    def keep(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: o.output(build(Inputs(spark, sf_dir)), columns)
        if sql is not None:
            ORACLES[name] = o.output_sql(sql, columns)
        return build

    return keep


# --- scalar functions ---

register("name_normalize", "activity_nr:s estab_name:s normalized:s", f"SELECT activity_nr, estab_name, {o.normalized('estab_name')} AS normalized FROM raw_osha_inspections")(
    lambda i: i.raw("raw_osha_inspections").select(
        "activity_nr", "estab_name", names.normalize_name(F.col("estab_name")).alias("normalized")
    )
)
register("document_name_normalize", "doc_id:i normalized:s", f"SELECT doc_id, {o.normalized('text')} AS normalized FROM documents")(
    lambda i: i.table("documents").select("doc_id", names.normalize_name(F.col("text")).alias("normalized"))
)
register("owner_name_normalize", "id:s normalized:s", f"SELECT id, {o.owner_normalized('name')} AS normalized FROM companies")(
    lambda i: i.raw("companies").select("id", names.normalize_owner_name(F.col("name")).alias("normalized"))
)
register(
    "name_normalize_variant", "ck:i normalized:s",
    f"SELECT ck, {o.variant_normalized(chr(39) + 'The ' + chr(39) + ' || base || ' + chr(39) + ' Mfg. Store #' + chr(39) + ' || CAST(ck AS VARCHAR) || ' + chr(39) + ' Svc Co, LLC' + chr(39))} AS normalized FROM emp",
)(
    lambda i: i.raw("emp").select(
        "ck",
        names.normalize_name_variant(
            F.concat(F.lit("The "), "base", F.lit(" Mfg. Store #"), F.col("ck").cast("string"), F.lit(" Svc Co, LLC"))
        ).alias("normalized"),
    )
)
register(
    "name_prefix_and_first_word", "activity_nr:s prefix:s first_word:s",
    """SELECT activity_nr, substr(name_normalized, 1, 4) AS prefix,
  nullif(split_part(trim(upper(estab_name)), ' ', 1), '') AS first_word FROM osha""",
)(
    lambda i: i.osha.select(
        "activity_nr", names.name_prefix(F.col("name_normalized")).alias("prefix"),
        names.first_word(F.col("estab_name")).alias("first_word"),
    )
)
register("zip5", "activity_nr:s zip5:s", f"SELECT activity_nr, {o.zip5('site_zip')} AS zip5 FROM raw_osha_inspections")(
    lambda i: i.raw("raw_osha_inspections").select("activity_nr", codes.zip5(F.col("site_zip")).alias("zip5"))
)
register(
    "naics_prefix", "activity_nr:s naics4:s blocking:s",
    "SELECT activity_nr, left(naics_code, 4) AS naics4, coalesce(left(naics_code, 4), '0000') AS blocking FROM raw_osha_inspections",
)(
    lambda i: i.raw("raw_osha_inspections").select(
        "activity_nr", codes.naics4(F.col("naics_code")).alias("naics4"),
        codes.naics4_for_blocking(codes.naics4(F.col("naics_code"))).alias("blocking"),
    )
)
register(
    "employer_id", "activity_nr:s employer_key:s employer_id:s valid:b",
    f"""SELECT activity_nr, k AS employer_key, {o.uuid('k')} AS employer_id,
  coalesce(TRY_CAST({o.uuid('k')} AS UUID) IS NOT NULL, false) AS valid
FROM (SELECT activity_nr, {o.key('name_normalized', 'site_state', 'zip5')} AS k FROM osha) x""",
)(
    lambda i: i.osha.withColumn(
        "employer_key", codes.employer_key(F.col("name_normalized"), F.col("site_state"), F.col("zip5"))
    )
    .withColumn("employer_id", codes.uuid_from_text(F.col("employer_key")))
    .withColumn("valid", codes.is_uuid(F.col("employer_id")))
)
register(
    "tolerant_dates", "EVENT_NO:s VIOLATION_NO:s occurred:t issued:t amount:d",
    """SELECT EVENT_NO, VIOLATION_NO, try_strptime(VIOLATION_OCCUR_DT, '%m/%d/%Y') AS occurred,
  try_strptime(VIOLATION_ISSUE_DT, '%m/%d/%Y') AS issued, TRY_CAST(PROPOSED_PENALTY AS DECIMAL(18,3)) AS amount
FROM raw_msha_violations""",
)(
    lambda i: i.raw("raw_msha_violations").select(
        "EVENT_NO", "VIOLATION_NO", dates.us_date(F.col("VIOLATION_OCCUR_DT")).alias("occurred"),
        dates.us_date(F.col("VIOLATION_ISSUE_DT")).alias("issued"),
        F.col("PROPOSED_PENALTY").try_cast(codes.MONEY).alias("amount"),
    )
)
register(
    "calendar_parts", "o_orderkey:i weekday:i day:i month_start:t kept:b",
    f"""SELECT o_orderkey, extract(dow FROM d) AS weekday, extract(day FROM d) AS day, date_trunc('month', d) AS month_start,
  NOT ((d < DATE '{AS_OF}' - INTERVAL '90 days' AND extract(dow FROM d) <> 0 AND extract(day FROM d) <> 1)
    OR (d < {o.years_ago(1)} AND extract(dow FROM d) = 0 AND extract(day FROM d) <> 1)
    OR (d < {o.years_ago(3)} AND extract(day FROM d) = 1)) AS kept
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) x""",
)(
    lambda i: i.table("orders").withColumn("d", F.col("o_orderdate").cast("date")).select(
        "o_orderkey", dates.sunday_based_weekday(F.col("d")).alias("weekday"), F.dayofmonth("d").alias("day"),
        dates.month_start(F.col("d")).alias("month_start"), history.kept_by_retention(F.col("d"), AS_OF).alias("kept"),
    )
)
register(
    "trigram_similarity", "ck:i city:s same_market:d to_city:d",
    f"""SELECT ck, city, {o.similarity('base', "c_mktsegment || ' widget, cold & ' || p_name")} AS same_market,
  {o.similarity('base', 'city')} AS to_city
FROM emp JOIN customer ON ck = c_custkey JOIN part ON ck = p_partkey""",
)(
    lambda i: i.raw("emp").join(i.table("customer"), F.col("ck") == F.col("c_custkey"))
    .join(i.table("part"), F.col("ck") == F.col("p_partkey"))
    .select(
        "ck", "city",
        similarity.trigram_similarity(
            F.col("base"), F.concat("c_mktsegment", F.lit(" widget, cold & "), "p_name")
        ).alias("same_market"),
        similarity.trigram_similarity(F.col("base"), F.col("city")).alias("to_city"),
    )
)
register(
    "document_trigrams", "doc_id:i grams:i similarity:d",
    f"""SELECT doc_id, len(g) AS grams, {o.set_similarity('g', 's')} AS similarity
FROM (SELECT doc_id, {o.trigrams('text')} AS g, {o.trigrams("source || ' ' || lang || ' the and for'")} AS s FROM documents) x""",
)(
    lambda i: i.table("documents").select(
        "doc_id", F.size(similarity.trigrams(F.col("text"))).alias("grams"),
        similarity.trigram_similarity(
            F.col("text"), F.concat("source", F.lit(" "), "lang", F.lit(" the and for"))
        ).alias("similarity"),
    )
)
register(
    "jaro_winkler", "a:s b:s similarity:d",
    """SELECT a, b, jaro_winkler_similarity(a, b) AS similarity FROM (SELECT DISTINCT upper(p_name) AS a, base AS b
  FROM emp JOIN part ON ck = p_partkey) x""",
)(
    lambda i: i.raw("emp").join(i.table("part"), F.col("ck") == F.col("p_partkey"))
    .select(F.upper("p_name").alias("a"), F.col("base").alias("b")).distinct()
    .withColumn("similarity", similarity.jaro_winkler(F.col("a"), F.col("b")))
)
register(
    "name_agreement_levels", "level:i pairs:i",
    """SELECT CASE WHEN s >= 0.92 THEN 2 WHEN s >= 0.80 THEN 1 ELSE 0 END AS level, count(*) AS pairs
FROM (SELECT jaro_winkler_similarity(a, b) AS s FROM (SELECT DISTINCT coalesce(trade_nm, legal_name) AS a, legal_name AS b
  FROM stg_wages WHERE legal_name IS NOT NULL) x) y GROUP BY 1""",
)(
    lambda i: i.stg_wages.filter("legal_name IS NOT NULL")
    .select(F.coalesce("trade_nm", "legal_name").alias("a"), F.col("legal_name").alias("b")).distinct()
    .select(similarity.name_agreement_level(similarity.jaro_winkler(F.col("a"), F.col("b"))).alias("level"))
    .groupBy("level").agg(F.count(F.lit(1)).alias("pairs"))
)
register(
    "address_key", "activity_nr:s site_address:s address_key:s",
    f"""SELECT activity_nr, site_address, {o.address_key('site_address', o.zip5('site_zip'))} AS address_key
FROM raw_osha_inspections""",
)(
    lambda i: i.raw("raw_osha_inspections").select(
        "activity_nr", "site_address",
        address_key(F.col("site_address"), codes.zip5(F.col("site_zip"))).alias("address_key"),
    )
)
register(
    "violation_labels", "viol_type:s short_label:s label:s severity:s multiplier:i violations:i",
    """SELECT viol_type, CASE viol_type WHEN 'W' THEN 'Willful' WHEN 'R' THEN 'Repeat' WHEN 'S' THEN 'Serious'
    WHEN 'O' THEN 'Other' WHEN 'U' THEN 'Unclassified' ELSE viol_type END AS short_label, label, severity,
  penalty_multiplier AS multiplier, count(*) AS violations
FROM stg_violations LEFT JOIN (VALUES ('W', 'Willful', 'HIGH', 10), ('R', 'Repeat', 'HIGH', 5), ('S', 'Serious', 'MEDIUM', 1),
  ('O', 'Other-than-Serious', 'LOW', 0), ('U', 'Unclassified', 'LOW', 0)) t (code, label, severity, penalty_multiplier)
  ON viol_type = code GROUP BY ALL""",
)(
    lambda i: i.stg_violations.groupBy("viol_type").agg(F.count(F.lit(1)).alias("violations")).select(
        "viol_type", labels.violation_label(F.col("viol_type")).alias("short_label"),
        labels.violation_type_label(F.col("viol_type")).alias("label"),
        labels.violation_severity(F.col("viol_type")).alias("severity"),
        labels.violation_multiplier(F.col("viol_type")).alias("multiplier"), "violations",
    )
)
_INSPECTION_VALUES = ", ".join(f"('{code}', '{label}')" for code, label, _ in labels.INSPECTION_TYPES)
register(
    "inspection_labels", "activity_nr:s insp_type:s label:s",
    f"""SELECT activity_nr, insp_type, label FROM stg_inspections LEFT JOIN (VALUES {_INSPECTION_VALUES}) t (code, label)
  ON insp_type = code""",
)(
    lambda i: i.stg_inspections.select(
        "activity_nr", "insp_type", labels.inspection_label(F.col("insp_type")).alias("label")
    )
)
register(
    "risk_notes", "employer_id:s quiet:b",
    "SELECT employer_id, osha_inspections = 0 AND risk_score = 0 AS quiet FROM profile",
)(
    lambda i: lookup.with_risk_note(i.profile).select("employer_id", F.col("risk_note").isNotNull().alias("quiet"))
)
register(
    "seed_cleaning", "id:s cleaned:s",
    """SELECT id, replace(replace(replace(replace(replace(name || ' "x" #1\\', ',', ''), '''', ''), '"', ''), '\\', ''), '#', '') AS cleaned
FROM companies""",
)(
    lambda i: i.raw("companies").select(
        "id", names.seed_safe(F.concat("name", F.lit(' "x" #1\\'))).alias("cleaned")
    )
)


@register(
    "header_resolution", "lookup_id:i name:s st:s zip:s",
    "SELECT lookup_id, name, state AS st, zip FROM lookups",
)
def _(i: Inputs) -> DataFrame:
    upload = i.raw("lookups").select(
        "lookup_id", F.col("name").alias(" Company Name "), F.col("state").alias("ST"), F.col("zip").alias("Postal Code")
    )
    found = headers.resolve_headers(upload.columns)
    return upload.select(
        "lookup_id", F.col(f"`{found['name']}`").alias("name"), F.col(f"`{found['state']}`").alias("st"),
        F.col(f"`{found['zip']}`").alias("zip"),
    )


# --- staging ---

_STAGED = {
    "stg_inspections": "activity_nr:s estab_name:s site_address:s site_city:s site_state:s site_zip:s naics_code:s open_date:t close_case_date:t insp_type:s owner_type:s",
    "stg_violations": "activity_nr:s citation_id:s viol_type:s gravity:i nr_instances:i initial_penalty:d current_penalty:d abate_date:t issuance_date:t",
    "stg_wages": "case_id:s trade_nm:s legal_name:s street_addr_1_txt:s city_nm:s st_cd:s zip_cd:s naics_code_description:s findings_start_date:t findings_end_date:t bw_amt:d ee_violtd_cnt:i",
    "stg_mines": "mine_id:s mine_name:s mine_status:s operator_name:s controller_name:s state:s county:s sic_code:s latitude:d longitude:d",
    "stg_mine_violations": "event_no:s mine_id:s violation_no:s violator_name:s violation_date:t issue_date:t section_of_act:s sig_sub:s proposed_penalty:d amount_paid:d negligence:s",
    "stg_contractors": "contractor_name:s street:s city:s state:s zip:s naics_code:s date_received:t date_resolved:t resolution_type:s violations_found:s amount_of_relief:d class_members:i",
    "stg_disclosures": "employer_name:s address:s city:s state:s zip5:s naics_code:s received_date:t decision_date:t case_status:s wage_offered:d prevailing_wage:d total_workers:i full_time_position:s visa_class:s job_title:s soc_code:s soc_title:s",
}
for _name, _columns in _STAGED.items():
    register(_name, _columns, f"SELECT * FROM {_name}")(lambda i, name=_name: getattr(i, name))

# --- silver ---

register(
    "violation_rollup",
    "activity_nr:s violation_count:i willful_count:i repeat_count:i serious_count:i other_count:i total_penalties:d avg_gravity:d",
    "SELECT * FROM rollup",
)(lambda i: silver.violation_rollup(i.stg_violations))
_OSHA = (
    "activity_nr:s estab_name:s name_normalized:s site_address:s site_city:s site_state:s zip5:s naics_code:s naics_4digit:s "
    "open_date:t close_case_date:t insp_type:s address_key:s violation_count:i willful_count:i repeat_count:i "
    "serious_count:i other_count:i total_penalties:d avg_gravity:d"
)
register("inspection_norm", _OSHA, "SELECT * FROM osha")(lambda i: i.build_osha())
register(
    "whd_norm",
    "case_id:s employer_name:s name_normalized:s legal_name:s address:s city:s state:s zip5:s naics_code_description:s findings_start_date:t findings_end_date:t backwages:d employees_violated:i address_key:s",
    "SELECT * FROM whd",
)(lambda i: i.build_whd())
register(
    "msha_norm",
    "event_no:s mine_id:s violation_no:s violator_name:s name_normalized:s violation_date:t issue_date:t section_of_act:s sig_sub:s proposed_penalty:d amount_paid:d negligence:s mine_name:s mine_status:s operator_name:s controller_name:s state:s county:s",
    "SELECT * FROM msha",
)(lambda i: i.build_msha())
register(
    "contractor_norm",
    "contractor_name:s name_normalized:s address:s city:s state:s zip5:s naics_code:s date_received:t date_resolved:t resolution_type:s violations_found:s amount_of_relief:d class_members:i",
    "SELECT * FROM contractors",
)(lambda i: silver.normalize_contractor_evaluations(i.stg_contractors))
register(
    "disclosure_norm",
    "employer_name:s name_normalized:s address:s city:s state:s zip5:s naics_code:s received_date:t decision_date:t case_status:s wage_offered:d prevailing_wage:d total_workers:i full_time_position:s visa_class:s job_title:s soc_code:s",
    "SELECT * FROM disclosures",
)(lambda i: silver.normalize_disclosures(i.stg_disclosures))
register(
    "drop_repeated_violations", "activity_nr:s citation_id:s viol_type:s initial_penalty:d",
    """SELECT activity_nr, citation_id, viol_type, initial_penalty FROM (SELECT *, row_number() OVER (
    PARTITION BY activity_nr, citation_id ORDER BY viol_type DESC, gravity DESC, nr_instances DESC, initial_penalty DESC,
    current_penalty DESC NULLS LAST, issuance_date DESC NULLS LAST) AS rn FROM stg_violations) x WHERE rn = 1""",
)(lambda i: staging.drop_repeats(i.stg_violations, ["activity_nr", "citation_id"]))
register(
    "drop_repeats_null_keys", "activity_nr:s citation_id:s viol_type:s initial_penalty:d",
    """SELECT activity_nr, NULL AS citation_id, viol_type, initial_penalty FROM stg_violations WHERE viol_type = 'S'
UNION ALL SELECT activity_nr, citation_id, viol_type, initial_penalty FROM (SELECT *, row_number() OVER (
    PARTITION BY activity_nr, citation_id ORDER BY viol_type DESC, gravity DESC, nr_instances DESC, initial_penalty DESC,
    current_penalty DESC NULLS LAST, issuance_date DESC NULLS LAST) AS rn FROM stg_violations WHERE viol_type <> 'S') x WHERE rn = 1
UNION ALL SELECT activity_nr, citation_id, viol_type, initial_penalty FROM stg_violations WHERE viol_type IS NULL""",
)(
    lambda i: staging.drop_repeats(
        i.stg_violations.withColumn("citation_id", F.when(F.col("viol_type") != "S", F.col("citation_id"))), ["activity_nr", "citation_id"]
    )
)
register(
    "labelled_violations",
    "activity_nr:s citation_id:s viol_type:s viol_type_label:s severity:s issuance_date:t current_penalty:d initial_penalty:d",
    """SELECT activity_nr, citation_id, viol_type, label AS viol_type_label, severity, issuance_date,
  coalesce(current_penalty, 0) AS current_penalty, coalesce(initial_penalty, 0) AS initial_penalty
FROM stg_violations LEFT JOIN (VALUES ('W', 'Willful', 'HIGH'), ('R', 'Repeat', 'HIGH'), ('S', 'Serious', 'MEDIUM'),
  ('O', 'Other-than-Serious', 'LOW'), ('U', 'Unclassified', 'LOW')) t (code, label, severity) ON viol_type = code""",
)(lambda i: silver.label_violations(i.stg_violations))
register(
    "whd_norm_legal_first",
    "case_id:s name_normalized:s ein:s back_wages:d employees_owed:i street_raw:s state:s zip5:s address_key:s",
    f"""SELECT case_id, {o.variant_normalized('coalesce(legal_name, trade_nm)')} AS name_normalized, NULL AS ein,
  bw_amt AS back_wages, ee_violtd_cnt AS employees_owed, street_addr_1_txt AS street_raw, st_cd AS state,
  {o.zip5('zip_cd')} AS zip5, {o.address_key('street_addr_1_txt', o.zip5('zip_cd'))} AS address_key
FROM stg_wages WHERE bw_amt > 0""",
)(lambda i: silver.normalize_wage_actions_legal_first(i.stg_wages))

# --- gold ---

register(
    "valid_names", "source:s name_normalized:s records:i",
    """SELECT 'OSHA' AS source, name_normalized, count(*) AS records FROM osha_valid GROUP BY 2
UNION ALL SELECT 'WHD', name_normalized, count(*) FROM whd_valid GROUP BY 2""",
)(
    lambda i: profile.valid_inspections(i.osha).select(F.lit("OSHA").alias("source"), "name_normalized")
    .unionByName(profile.valid_wage_actions(i.whd).select(F.lit("WHD").alias("source"), "name_normalized"))
    .groupBy("source", "name_normalized").agg(F.count(F.lit(1)).alias("records"))
)
register(
    "employer_keys", "employer_key:s employer_id:s name_normalized:s state:s zip5:s", "SELECT * FROM keys"
)(lambda i: i.keys)
register(
    "osha_agg",
    "employer_key:s employer_name:s address:s city:s naics_code:s naics_4digit:s osha_inspections:i osha_violations:i osha_willful_count:i osha_repeat_count:i osha_serious_count:i osha_other_count:i osha_total_penalties:d osha_last_inspection_date:t osha_avg_gravity:d",
    "SELECT * FROM osha_agg",
)(lambda i: profile.inspection_totals(i.osha, AS_OF))
register(
    "trailing_windows", "employer_key:s violations_1yr:i violations_3yr:i violations_5yr:i",
    f"""SELECT employer_key, sum(CASE WHEN open_date >= {o.years_ago(1)} THEN violation_count END) AS violations_1yr,
  sum(CASE WHEN open_date >= {o.years_ago(3)} THEN violation_count END) AS violations_3yr,
  sum(CASE WHEN open_date >= {o.years_ago(5)} THEN violation_count END) AS violations_5yr FROM osha_valid GROUP BY employer_key""",
)(lambda i: profile.inspection_totals(i.osha, AS_OF, years=(1, 3, 5)))
register(
    "whd_agg",
    "employer_key:s whd_employer_name:s whd_address:s whd_city:s whd_cases:i whd_backwages_total:d whd_ee_violated_total:i",
    "SELECT * FROM whd_agg",
)(lambda i: profile.wage_totals(i.whd))
register(
    "msha_agg", "name_normalized:s state:s msha_violations:i msha_assessed_penalties:d", "SELECT * FROM msha_agg"
)(lambda i: profile.mine_totals(i.msha))
_BASE = (
    "employer_id:s employer_key:s name_normalized:s employer_name:s address:s city:s state:s zip5:s naics_code:s "
    "naics_4digit:s osha_inspections:i osha_violations:i osha_willful_count:i osha_repeat_count:i osha_serious_count:i "
    "osha_other_count:i osha_total_penalties:d osha_last_inspection_date:t osha_avg_gravity:d whd_cases:i "
    "whd_backwages_total:d whd_ee_violated_total:i msha_violations:i msha_assessed_penalties:d violations_1yr:i violations_3yr:i"
)
register("employer_base", _BASE, "SELECT * FROM base")(lambda i: i.base)
register(
    "parent_match", "employer_id:s parent_name:s", "SELECT * FROM parent_match"
)(
    lambda i: i.keys.join(profile.parent_matches(i.keys, i.parents), "name_normalized").select("employer_id", "parent_name")
)
register(
    "parent_match_honoring_type", "name_normalized:s parent_name:s",
    """SELECT name_normalized, parent_name FROM (SELECT name_normalized, parent_name, row_number() OVER (
    PARTITION BY name_normalized ORDER BY match_type = 'exact' DESC, length(name_pattern) DESC) AS rn
  FROM (SELECT DISTINCT name_normalized FROM keys) k JOIN parent_companies ON (match_type = 'exact' AND name_normalized = name_pattern)
    OR (match_type <> 'exact' AND name_normalized LIKE name_pattern || '%')) x WHERE rn = 1""",
)(lambda i: profile.parent_matches(i.keys, i.parents, honor_match_type=True))
register(
    "prefix_join", "name_normalized:s name_pattern:s",
    """SELECT name_normalized, name_pattern FROM (SELECT DISTINCT name_normalized FROM keys) k
JOIN (SELECT DISTINCT left(upper(p_name), 6) AS name_pattern FROM part UNION SELECT DISTINCT upper(p_name) FROM part) p
ON name_normalized LIKE name_pattern || '%'""",
)(
    lambda i: prefixes.prefix_matches(
        i.keys.select("name_normalized").distinct(),
        i.table("part").select(F.explode(F.array(F.left(F.upper("p_name"), F.lit(6)), F.upper("p_name"))).alias("name_pattern")).distinct(),
        "name_normalized", "name_pattern",
    )
)
register(
    "location_counts", "employer_id:s parent_name:s location_count:i", "SELECT * FROM locations"
)(
    lambda i: i.keys.join(profile.company_sizes(profile.employer_places(i.keys), i.parents), "name_normalized")
)
_RISK = {
    "risk_tier": "risk_tier:s", "risk_score": "risk_score:d", "trend_signal": "trend_signal:s",
    "confidence_tier": "confidence_tier:s", "svep_flag": "svep_flag:b",
}
for _name, _column in _RISK.items():
    register(_name, f"employer_id:s {_column}", o.risk_sql("base", AS_OF))(lambda i: profile.with_risk(i.base, AS_OF))
_PROFILE = (
    "employer_id:s employer_name:s name_normalized:s address:s city:s state:s zip5:s naics_code:s naics_4digit:s "
    "osha_inspections:i osha_violations:i osha_willful_count:i osha_repeat_count:i osha_serious_count:i osha_other_count:i "
    "osha_total_penalties:d osha_last_inspection_date:t osha_avg_gravity:d whd_cases:i whd_backwages_total:d "
    "whd_ee_violated_total:i msha_violations:i msha_assessed_penalties:d parent_name:s location_count:i risk_tier:s "
    "risk_score:d trend_signal:s confidence_tier:s svep_flag:b naics_description:s"
)
register("employer_profile", _PROFILE, "SELECT * FROM profile")(lambda i: i.build_profile(AS_OF))
register(
    "high_risk_employers", "employer_id:s employer_name:s state:s risk_score:d",
    "SELECT * FROM profile WHERE risk_tier = 'HIGH'",
)(lambda i: i.profile.filter("risk_tier = 'HIGH'").orderBy(F.desc("risk_score"), "employer_id"))
register(
    "multi_agency_risk", "employer_id:s risk_tier:s risk_score:d",
    f"""SELECT employer_id, CASE WHEN osha_willful_count >= 1 OR osha_repeat_count >= 3 OR osha_total_penalties > 100000 OR debarred
    THEN 'HIGH' WHEN osha_inspections >= 5 AND osha_violations >= 10 THEN 'ELEVATED'
    WHEN osha_inspections >= 3 AND (whd_cases > 0 OR msha_violations > 0 OR relief > 0) THEN 'ELEVATED'
    WHEN osha_avg_gravity > 2.0 * 2.5 THEN 'ELEVATED' WHEN osha_violations >= 10 THEN 'MEDIUM'
    WHEN osha_inspections BETWEEN 2 AND 4 THEN 'MEDIUM' WHEN osha_violations BETWEEN 3 AND 9 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
  least(100.0, greatest(0.0, CAST(osha_willful_count AS DOUBLE) * 25 + osha_repeat_count * 10 + osha_serious_count * 5 + osha_other_count
    + CASE WHEN debarred THEN 30 ELSE 0 END + least(20.0, CAST(osha_total_penalties AS DOUBLE) / 10000)
    + CASE WHEN whd_cases > 0 THEN 5 ELSE 0 END + CASE WHEN msha_violations > 0 THEN 5 ELSE 0 END)) AS risk_score
FROM (SELECT base.*, coalesce(relief, 0) AS relief, coalesce(debarred, false) AS debarred FROM base LEFT JOIN (
  SELECT name_normalized, state, count(*) AS relief, max(class_members) > 55 AS debarred FROM contractors
  WHERE amount_of_relief > 0 GROUP BY 1, 2) c ON base.name_normalized = c.name_normalized AND base.state = c.state) b""",
)(
    lambda i: i.base.join(
        silver.normalize_contractor_evaluations(i.stg_contractors).filter("amount_of_relief > 0")
        .groupBy("name_normalized", "state")
        .agg(F.count(F.lit(1)).alias("ofccp_violations"), (F.max("class_members") > 55).alias("sam_debarred")),
        ["name_normalized", "state"], "left",
    )
    .withColumns({"industry_citation_rate": F.col("osha_avg_gravity"), "industry_median_rate": F.lit(2.0)})
    .select("employer_id", scoring.risk_tier_multi_agency().alias("risk_tier"), scoring.risk_score_multi_agency().alias("risk_score"))
)
register(
    "identity_confidence", "employer_key:s confidence:s",
    """SELECT employer_key, CASE WHEN substr(md5(employer_key), 1, 1) = '0' THEN 'HIGH'
  WHEN address_key IS NOT NULL AND jaro_winkler_similarity(o_name, w_name) > 0.90 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM (SELECT employer_key, max(address_key) AS address_key, max(upper(estab_name)) AS o_name FROM osha_valid GROUP BY 1) a
JOIN (SELECT employer_key, max(upper(employer_name)) AS w_name FROM whd_valid GROUP BY 1) b USING (employer_key)""",
)(
    lambda i: _confidence(i)
)


def _confidence(i: Inputs) -> DataFrame:
    key_of = lambda state: codes.employer_key(F.col("name_normalized"), F.col(state), F.col("zip5"))
    osha = profile.valid_inspections(i.osha).groupBy(key_of("site_state").alias("employer_key")).agg(
        F.max("address_key").alias("address_key"), F.max(F.upper("estab_name")).alias("o_name")
    )
    whd = profile.valid_wage_actions(i.whd).groupBy(key_of("state").alias("employer_key")).agg(
        F.max(F.upper("employer_name")).alias("w_name")
    )
    ein = F.when(F.left(F.md5("employer_key"), F.lit(1)) == "0", F.col("employer_key"))
    joined = osha.join(whd, "employer_key").withColumn("alike", similarity.jaro_winkler(F.col("o_name"), F.col("w_name")))
    return joined.select(
        "employer_key", scoring.identity_confidence(ein, F.col("address_key"), F.col("alike")).alias("confidence")
    )


# --- search, lookup, roll-up ---

_COUNTED = ", count(*) OVER () AS total_count"
register(
    "search_by_ein", "employer_id:s employer_name:s state:s risk_score:d total_count:i",
    f"""SELECT *{_COUNTED} FROM served WHERE ein = (SELECT min(ein) FROM served) ORDER BY risk_score DESC, employer_id LIMIT 20""",
)(lambda i: _by_ein(i))


def _by_ein(i: Inputs) -> DataFrame:
    ein = i.served.agg(F.min("ein")).first()[0]
    return lookup.search_by_ein(layout.read_keys(i.spark, i.clustered("ein"), "ein", [ein]), ein)


register("published_layout", "employer_id:s ein:s risk_score:d", "SELECT employer_id, ein, risk_score FROM served")(
    lambda i: layout.read_clustered(i.spark, i.clustered("ein"))
)
register(
    "parent_point_read", "parent_name:s employer_id:s risk_score:d",
    "SELECT parent_name, employer_id, risk_score FROM served WHERE parent_name IN ('Red Corp', 'Cold Group')",
)(lambda i: layout.read_keys(i.spark, i.clustered("parent_name"), "parent_name", ["Red Corp", "Cold Group"]))


def _search_sql(name: str, threshold: float, where: str = "") -> str:
    return f"""SELECT *{_COUNTED} FROM (SELECT *, {o.similarity('employer_name', f"'{name}'")} AS sim_score FROM served {where}) s
WHERE sim_score > {threshold} ORDER BY sim_score DESC, risk_score DESC, osha_inspections DESC, employer_id"""


register(
    "fuzzy_search", "employer_id:s employer_name:s sim_score:d risk_score:d total_count:i",
    _search_sql("COLD WIDGT FURNITURE", 0.25) + " LIMIT 50 OFFSET 10",
)(lambda i: lookup.search_by_name(i.served, "COLD WIDGT FURNITURE", limit=50, offset=10, index=i.name_index))
register(
    "fuzzy_search_short_name", "employer_id:s employer_name:s sim_score:d risk_score:d total_count:i",
    _search_sql("rng", 0.15, "WHERE state = 'NATION_3' AND naics_code LIKE '23%'") + " LIMIT 100",
)(lambda i: lookup.search_by_name(i.served, "rng", state="nation_3", naics="23", limit=100, index=i.name_index))
register(
    "search_min_confidence", "employer_id:s sim_score:d confidence_tier:s total_count:i",
    f"""SELECT *{_COUNTED} FROM (SELECT employer_id, confidence_tier, risk_score, osha_inspections,
  {o.similarity('employer_name', "'RED BOLT'")} AS sim_score FROM served) c
WHERE sim_score > 0.25 AND confidence_tier = 'HIGH' ORDER BY sim_score DESC, risk_score DESC, osha_inspections DESC, employer_id LIMIT 100""",
)(lambda i: lookup.search_by_name(i.served, "RED BOLT", limit=100, min_confidence="HIGH", index=i.name_index))
register(
    "page_after", "page:i place:i employer_id:s sim_score:d total_count:i",
    f"""SELECT (rn - 1) // 400 AS page, (rn - 1) % 400 AS place, employer_id, sim_score, total_count FROM (
  SELECT *, row_number() OVER (ORDER BY sim_score DESC, risk_score DESC NULLS LAST, osha_inspections DESC NULLS LAST, employer_id) AS rn{_COUNTED}
  FROM (SELECT *, {o.similarity('employer_name', "'COLD WIDGET FURNITURE'")} AS sim_score FROM served) s WHERE sim_score > 0.4) p""",
)(lambda i: _all_pages(i))


def _all_pages(i: Inputs) -> DataFrame:
    """All hits, page by page, each from the last row of the one before; the hits are found once."""
    hits = lookup.name_hits(i.served, "COLD WIDGET FURNITURE", index=i.name_index).filter("sim_score > 0.4")
    hits = cut_lineage(hits.select(*lookup.HIT_ORDER))
    first, total = picks.page_after(hits, lookup.HIT_ORDER, 400)
    rows = [(0, k, row["employer_id"], row["sim_score"]) for k, row in enumerate(first.collect())]
    pages = i.spark.createDataFrame(rows, "page long, place long, employer_id string, sim_score double")
    later, _ = picks.page_after(hits, lookup.HIT_ORDER, 400, picks.page_ends(hits, lookup.HIT_ORDER, 400))
    pages = pages.unionByName(later.select("page", "place", "employer_id", "sim_score"))
    return pages.withColumn("total_count", F.lit(total.get["total_count"]).cast("long"))


register(
    "ranked_search", "employer_id:s match_rank:i sim_score:d",
    f"""SELECT * FROM (SELECT employer_id, osha_open_date_latest, sim_score, CASE WHEN ein = e THEN 1
    WHEN address_key = k AND sim_score > 0.9 THEN 2 WHEN sim_score > 0.25 THEN 3 END AS match_rank
  FROM (SELECT *, {o.similarity('employer_name', "'COLD WIDGET FURNITURE'")} AS sim_score,
      {o.address_key('address', 'zip')} AS address_key, (SELECT min(ein) FROM served) AS e,
      (SELECT min({o.address_key('address', 'zip')}) FROM served WHERE employer_name LIKE 'COLD WIDGET FURNITURE%') AS k FROM served) s) r
WHERE match_rank IS NOT NULL ORDER BY match_rank, sim_score DESC, osha_open_date_latest DESC NULLS LAST, employer_id LIMIT 200""",
)(lambda i: _ranked(i))


def _ranked(i: Inputs) -> DataFrame:
    keyed = i.served.withColumn("address_key", address_key(F.col("address"), F.col("zip")))
    wanted = keyed.filter(F.col("employer_name").startswith("COLD WIDGET FURNITURE"))
    ein = i.served.agg(F.min("ein")).first()[0]
    place = wanted.agg(F.min("address_key")).first()[0]
    return lookup.search_ranked(keyed, "COLD WIDGET FURNITURE", ein=ein, address_key=place, limit=200, index=i.name_index)


_ROLLUP = """count(DISTINCT employer_id) AS total_locations, sum(osha_inspections) AS total_inspections,
  sum(osha_violations) AS total_violations, sum(osha_total_penalties) AS total_penalties,
  round(avg(risk_score), 1) AS avg_risk_score, max(risk_score) AS max_risk_score, min(risk_score) AS min_risk_score,
  count(*) FILTER (risk_tier = 'HIGH') AS high_count, count(*) FILTER (risk_tier = 'ELEVATED') AS elevated_count,
  count(*) FILTER (risk_tier = 'MEDIUM') AS medium_count, count(*) FILTER (risk_tier = 'LOW') AS low_count,
  count(*) FILTER (trend_signal = 'WORSENING') AS worsening_count,
  count(*) FILTER (trend_signal = 'IMPROVING') AS improving_count,
  count(*) FILTER (trend_signal = 'STABLE') AS stable_count"""
_ROLLUP_COLUMNS = (
    "total_locations:i total_inspections:i total_violations:i total_penalties:d avg_risk_score:d max_risk_score:d "
    "min_risk_score:d high_count:i elevated_count:i medium_count:i low_count:i worsening_count:i improving_count:i stable_count:i"
)
register("parent_rollup", _ROLLUP_COLUMNS, f"SELECT {_ROLLUP} FROM served WHERE parent_name = 'Red Corp'")(
    lambda i: lookup.parent_rollup(i.served, "Red Corp")
)
register(
    "parent_rollup_fuzzy", _ROLLUP_COLUMNS,
    f"""SELECT {_ROLLUP} FROM served WHERE {o.similarity("coalesce(parent_name, '')", "'Cold Widgets Holding'")} > 0.5""",
)(lambda i: lookup.parent_rollup(i.served, "Cold Widgets Holding"))
register(
    "parent_rollups", "parent_name:s " + _ROLLUP_COLUMNS,
    f"SELECT parent_name, {_ROLLUP} FROM served WHERE parent_name IS NOT NULL GROUP BY parent_name",
)(lambda i: lookup.parent_rollups(i.served))
register(
    "parent_states", "state:s location_count:i",
    "SELECT state, count(*) AS location_count FROM served WHERE parent_name = 'Red Corp' AND state IS NOT NULL GROUP BY state",
)(lambda i: lookup.parent_states(i.served, "Red Corp"))
register(
    "parent_locations", "employer_id:s employer_name:s risk_score:d total_count:i",
    f"SELECT *{_COUNTED} FROM served WHERE parent_name = 'Cold Group' ORDER BY risk_score DESC, employer_id LIMIT 25 OFFSET 5",
)(lambda i: lookup.parent_locations(i.served, "Cold Group", limit=25, offset=5))
register(
    "lookup_by_id", "requested_id:s employer_id:s redirected:b risk_tier:s",
    """SELECT k.employer_id AS requested_id, coalesce(m.superseded_by, k.employer_id) AS employer_id,
  m.superseded_by IS NOT NULL AS redirected, risk_tier
FROM keys k LEFT JOIN (SELECT k2.employer_id, w.first_id AS superseded_by FROM keys k2 JOIN (SELECT name_normalized,
    min(employer_id) AS first_id FROM keys GROUP BY 1) w USING (name_normalized) WHERE k2.zip5 = '' ) m
  ON k.employer_id = m.employer_id
LEFT JOIN served s ON s.employer_id = coalesce(m.superseded_by, k.employer_id)""",
)(lambda i: _by_id(i))


def _by_id(i: Inputs) -> DataFrame:
    first = i.keys.groupBy("name_normalized").agg(F.min("employer_id").alias("superseded_by"))
    moved = i.keys.filter("zip5 = ''").join(first, "name_normalized").select("employer_id", "superseded_by")
    return lookup.lookup_by_id(i.served, moved, i.keys.select("employer_id"))


# --- bulk enrichment ---

_LOOKUPS = f"""SELECT lookup_id, nullif(trim(name), '') AS q_name, nullif(trim(ein), '') AS q_ein,
  nullif(trim(employer_id), '') AS q_id, upper(nullif(trim(state), '')) AS q_state,
  left(nullif(trim(zip), ''), 5) AS q_zip, upper(nullif(trim(city), '')) AS q_city
FROM (SELECT l.* REPLACE (CASE WHEN lookup_id % 25 = 4 THEN f.first_id END AS employer_id) FROM lookups l,
  (SELECT min(employer_id) AS first_id FROM served) f) l"""
o.VIEWS |= {
    "asked": _LOOKUPS,
    "target_grams": f"SELECT t_name, {o.trigrams('t_name')} AS tg FROM (SELECT DISTINCT lower(employer_name) AS t_name FROM served) t",
    "query_grams": f"SELECT q_name, {o.trigrams('q_name')} AS qg FROM (SELECT DISTINCT q_name FROM asked WHERE q_name IS NOT NULL) t",
    "name_sims": f"""SELECT * FROM (SELECT q_name, t_name, {o.set_similarity('qg', 'tg')} AS sim FROM query_grams JOIN target_grams ON true) x
WHERE sim > 0.3""",
    "city_sims": f"""SELECT q_city, t_city, {o.similarity('q_city', 't_city')} AS city_sim FROM (SELECT DISTINCT q_city FROM asked
  WHERE q_city IS NOT NULL) a JOIN (SELECT DISTINCT city AS t_city FROM served) b ON true""",
    "name_hits": """SELECT lookup_id, s.employer_id, sim FROM asked JOIN name_sims USING (q_name)
  JOIN served s ON lower(s.employer_name) = t_name AND (q_state IS NULL OR s.state = q_state) AND (q_zip IS NULL OR s.zip = q_zip)
  LEFT JOIN city_sims c ON c.q_city = asked.q_city AND c.t_city = s.city
WHERE q_id IS NULL AND q_ein IS NULL AND (asked.q_city IS NULL OR city_sim > 0.4)""",
    "resolved": """SELECT lookup_id, employer_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY sim DESC, risk DESC, employer_id) AS rn FROM (
    SELECT lookup_id, s.employer_id, CAST(NULL AS DOUBLE) AS sim, 0.0 AS risk FROM asked JOIN served s ON q_id = s.employer_id
    UNION ALL SELECT lookup_id, s.employer_id, NULL, s.risk_score FROM asked JOIN served s ON q_id IS NULL AND q_ein = s.ein
      AND (q_state IS NULL OR s.state = q_state) AND (q_zip IS NULL OR s.zip = q_zip)
    UNION ALL SELECT lookup_id, employer_id, sim, 0.0 FROM name_hits) h) r WHERE rn = 1""",
    "enriched": """SELECT l.*, r.employer_id AS matched_id, CASE WHEN r.employer_id IS NULL THEN NULL WHEN sim IS NULL THEN 'exact'
    WHEN sim > 0.8 THEN 'high' WHEN sim > 0.5 THEN 'medium' ELSE 'low' END AS match_confidence, sim, s.employer_name AS matched_name,
  s.address AS matched_address, s.city AS matched_city, s.state AS matched_state, s.zip AS matched_zip, s.risk_tier, s.risk_score,
  s.osha_inspections, s.osha_violations, s.osha_total_penalties, s.location_count, s.trend_signal
FROM lookups l LEFT JOIN resolved r ON l.lookup_id = r.lookup_id LEFT JOIN served s ON r.employer_id = s.employer_id""",
}


def _lookups(i: Inputs) -> DataFrame:
    first = i.served.agg(F.min("employer_id")).scalar()
    return i.raw("lookups").withColumn("employer_id", F.when(F.col("lookup_id") % 25 == 4, first))


register(
    "bulk_resolve", "lookup_id:i employer_id:s similarity:d",
    "SELECT l.lookup_id, r.employer_id, sim AS similarity FROM lookups l LEFT JOIN resolved r ON l.lookup_id = r.lookup_id",
)(lambda i: lookup.resolve_lookups(_lookups(i), i.served))
register(
    "bulk_enrich",
    "lookup_id:i name:s state:s employer_id:s match_confidence:s risk_tier:s risk_score:d osha_inspections:i osha_violations:i osha_total_penalties:d location_count:i trend_signal:s matched_name:s matched_address:s matched_city:s matched_state:s matched_zip:s",
    "SELECT * REPLACE (matched_id AS employer_id) FROM enriched",
)(lambda i: lookup.enrich_lookups(_lookups(i), i.served))
register(
    "match_summary", "total:i matched:i unmatched:i exact_count:i high_count:i medium_count:i low_count:i",
    """SELECT count(*) AS total, count(match_confidence) AS matched, count(*) - count(match_confidence) AS unmatched,
  count(*) FILTER (match_confidence = 'exact') AS exact_count, count(*) FILTER (match_confidence = 'high') AS high_count,
  count(*) FILTER (match_confidence = 'medium') AS medium_count, count(*) FILTER (match_confidence = 'low') AS low_count FROM enriched""",
)(lambda i: lookup.match_summary(lookup.enrich_lookups(_lookups(i), i.served)))
register(
    "similar_names", "q_name:s t_name:s similarity:d",
    "SELECT q_name, t_name, sim AS similarity FROM name_sims",
)(
    lambda i: similar_pairs(
        _lookups(i).select(F.nullif(F.trim("name"), F.lit("")).alias("q_name")).filter("q_name IS NOT NULL").distinct(),
        i.served.select(F.lower("employer_name").alias("t_name")).distinct(),
        "q_name", "t_name", 0.3,
    )
)

# --- details, history, industry ---

_INSPECTION_DETAIL = (
    "activity_nr:s employer_id:s employer_name:s site_address:s site_city:s site_state:s zip5:s open_date:t close_case_date:t "
    "insp_type:s violation_count:i serious_count:i willful_count:i repeat_count:i other_count:i total_penalties:d avg_gravity:d"
)
register("inspection_detail", _INSPECTION_DETAIL, "SELECT * FROM insp_detail")(
    lambda i: reports.inspection_detail(i.osha, AS_OF)
)
register(
    "violation_detail",
    "activity_nr:s citation_id:s viol_type:s gravity:i nr_instances:i initial_penalty:d current_penalty:d abate_date:t issuance_date:t",
    "SELECT * FROM viol_detail",
)(lambda i: reports.violation_detail(i.stg_violations, i.osha, AS_OF))
register(
    "inspections_of_employer", "activity_nr:s open_date:t violation_count:i total_count:i",
    f"""SELECT *{_COUNTED} FROM insp_detail WHERE employer_id = (SELECT max(employer_id) FROM insp_detail)
ORDER BY open_date DESC, activity_nr LIMIT 20""",
)(lambda i: (lambda d: reports.inspections_of(d, d.agg(F.max("employer_id")).first()[0]))(reports.inspection_detail(i.osha, AS_OF)))
register(
    "violations_of_inspection", "citation_id:s viol_type:s viol_type_label:s issuance_date:t",
    """SELECT citation_id, viol_type, issuance_date, CASE viol_type WHEN 'W' THEN 'Willful' WHEN 'R' THEN 'Repeat'
  WHEN 'S' THEN 'Serious' WHEN 'O' THEN 'Other' WHEN 'U' THEN 'Unclassified' ELSE viol_type END AS viol_type_label
FROM viol_detail WHERE activity_nr = (SELECT max(activity_nr) FROM viol_detail)""",
)(
    lambda i: (lambda d: reports.violations_of(d, d.agg(F.max("activity_nr")).first()[0]))(
        reports.violation_detail(i.stg_violations, i.osha, AS_OF)
    )
)
register(
    "nested_inspections",
    "employer_id:s activity_nr:s agency:s inspection_date:t insp_type_label:s page:i citation_id:s viol_type:s current_penalty:d issuance_date:t times:i",
    f"""SELECT employer_id, i.activity_nr, 'OSHA' AS agency, open_date AS inspection_date, label AS insp_type_label, coalesce(page, 0) AS page, citation_id,
  viol_type, current_penalty, issuance_date, times
FROM insp_detail i LEFT JOIN (VALUES {_INSPECTION_VALUES}) t (code, label) ON insp_type = code
LEFT JOIN (SELECT *, (row_number() OVER (PARTITION BY activity_nr ORDER BY citation_id NULLS FIRST, viol_type NULLS FIRST,
    current_penalty NULLS FIRST, issuance_date NULLS FIRST) - 1) // 2 AS page FROM (SELECT activity_nr, citation_id, viol_type,
    current_penalty, issuance_date, count(*) AS times FROM viol_detail GROUP BY ALL) c) v ON i.activity_nr = v.activity_nr
WHERE open_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'""",
)(
    lambda i: reports.nested_inspections(
        reports.inspection_detail(i.osha, AS_OF), reports.violation_detail(i.stg_violations, i.osha, AS_OF),
        "1998-01-01", "2000-12-31", page_size=2,
    ).select("*", F.explode_outer("violations").alias("v")).select("*", "v.*")
)
_HISTORY = "employer_id:s snapshot_date:t risk_tier:s risk_score:d confidence_tier:s trend_signal:s"
register("risk_history", _HISTORY, "SELECT * FROM history")(lambda i: history.risk_history(i.history, i.served))
register(
    "risk_history_newest_two", _HISTORY,
    "SELECT * FROM history WHERE snapshot_date >= DATE '2000-01-01'",
)(lambda i: history.risk_history(i.history, i.served, limit=2))
register(
    "risk_history_fallback", _HISTORY,
    """SELECT * FROM history WHERE confidence_tier = 'HIGH' UNION ALL SELECT * FROM history h WHERE snapshot_date = DATE '2001-08-01'
  AND NOT EXISTS (SELECT 1 FROM history x WHERE x.confidence_tier = 'HIGH' AND x.employer_id = h.employer_id)""",
)(lambda i: history.risk_history(i.history.filter("confidence_tier = 'HIGH'"), i.served))
register(
    "risk_history_range", _HISTORY, "SELECT * FROM history WHERE snapshot_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'",
)(lambda i: history.risk_history(i.history, i.served, from_date="2000-01-01", to_date="2000-12-31"))
register(
    "history_append", "employer_id:s snapshot_date:t risk_tier:s",
    "SELECT employer_id, snapshot_date, risk_tier FROM history WHERE snapshot_date = DATE '2001-08-01' AND risk_tier <> 'HIGH'",
)(lambda i: history.new_history_rows(i.served, i.history.filter("risk_tier = 'HIGH' OR snapshot_date < DATE '2001-01-01'")))
register(
    "history_retention", _HISTORY, "SELECT * FROM history WHERE snapshot_date >= DATE '1998-08-01'"
)(lambda i: history.retained_history(i.history, AS_OF))


def _aged_history(i: Inputs, read_all: bool) -> DataFrame:
    """The newest snapshot's history at many ages: days, Sundays and firsts of a month, of which retention drops some."""
    ages = F.explode(F.array(*[F.lit(n) for n in (0, 30, 45, 92, 100, 123, 200, 350, 400, 730, 1096, 1127, 1200)])).alias("age")
    newest = i.history.filter("snapshot_date = DATE '2001-08-01'").select("employer_id", "snapshot_date", ages)
    rows = newest.select("employer_id", F.expr("date_sub(snapshot_date, age)").alias("snapshot_date"))
    if not read_all:
        return history.retained_history(rows, AS_OF)
    path = scratch_path(i.spark, "aged-history")
    publishing.append_snapshots(rows, path)
    publishing.apply_retention(i.spark, path, AS_OF)
    return publishing.read_history(i.spark, path)


_AGED = """SELECT employer_id, d AS snapshot_date FROM (SELECT employer_id, CAST(snapshot_date - to_days(CAST(age AS INTEGER)) AS DATE) AS d FROM history,
  (VALUES (0), (30), (45), (92), (100), (123), (200), (350), (400), (730), (1096), (1127), (1200)) a (age) WHERE snapshot_date = DATE '2001-08-01') x
WHERE CASE WHEN day(d) = 1 THEN d >= DATE '1998-08-01' WHEN dayofweek(d) = 0 THEN d >= DATE '2000-08-01' ELSE d >= DATE '2001-05-03' END"""
register("history_retention_ages", "employer_id:s snapshot_date:t", _AGED)(lambda i: _aged_history(i, False))
register("history_retention_applied", "employer_id:s snapshot_date:t", _AGED)(lambda i: _aged_history(i, True))
register(
    "tier_changes", "employer_id:s employer_name:s new_tier:s old_tier:s snapshot_date:t",
    """SELECT s.employer_id, s.employer_name, s.risk_tier AS new_tier, p.risk_tier AS old_tier, s.snapshot_date
FROM served s JOIN (SELECT employer_id, CASE WHEN osha_violations % 5 = 0 THEN NULL ELSE risk_tier END AS risk_tier FROM profile_1999) p
  USING (employer_id) WHERE s.risk_tier IS DISTINCT FROM p.risk_tier""",
)(lambda i: _changes(i))


def _changes(i: Inputs) -> DataFrame:
    before = i.profile_at("1999-08-01").withColumn(
        "risk_tier", F.when(F.col("osha_violations") % 5 != 0, F.col("risk_tier"))
    )
    return history.tier_changes(i.served, before)


_SUBSCRIPTIONS = """SELECT activity_nr AS id, insp_type AS customer_id, {array}({watched}, {other}) AS employer_ids,
  CASE WHEN insp_type = 'Z' THEN {array}('other') ELSE {array}('risk_tier_change', 'other') END AS events,
  CASE WHEN insp_type = 'A' THEN 'paused' ELSE 'active' END AS status FROM {source}"""
o.VIEWS["subscriptions"] = _SUBSCRIPTIONS.format(
    array="list_value", watched=o.uuid(o.key("name_normalized", "site_state", "zip5")),
    other=o.uuid("name_normalized || '|' || coalesce(site_state, '') || '|'"), source="osha",
)
o.VIEWS["changes"] = """SELECT s.employer_id, s.employer_name, s.risk_tier AS new_tier, p.risk_tier AS old_tier
FROM served s JOIN (SELECT employer_id, CASE WHEN osha_violations % 5 = 0 THEN NULL ELSE risk_tier END AS risk_tier FROM profile_1999) p
  USING (employer_id) WHERE s.risk_tier IS DISTINCT FROM p.risk_tier"""


def _subscriptions(i: Inputs) -> DataFrame:
    watched = codes.uuid_from_text(codes.employer_key(F.col("name_normalized"), F.col("site_state"), F.col("zip5")))
    other = codes.uuid_from_text(
        F.concat("name_normalized", F.lit("|"), F.coalesce("site_state", F.lit("")), F.lit("|"))
    )
    kind = F.col("insp_type")
    return i.osha.select(
        F.col("activity_nr").alias("id"), kind.alias("customer_id"), F.array(watched, other).alias("employer_ids"),
        F.when(kind == "Z", F.array(F.lit("other"))).otherwise(F.array(F.lit("risk_tier_change"), F.lit("other"))).alias("events"),
        F.when(kind == "A", "paused").otherwise("active").alias("status"),
    )


register(
    "change_events", "subscription_id:s customer_id:s employer_id:s previous_risk_tier:s new_risk_tier:s details_url:s",
    """SELECT s.id AS subscription_id, s.customer_id, c.employer_id, c.old_tier AS previous_risk_tier, c.new_tier AS new_risk_tier,
  '/v1/employers/' || c.employer_id || '/risk-history' AS details_url
FROM changes c JOIN (SELECT DISTINCT id, customer_id, unnest(employer_ids) AS employer_id FROM subscriptions
  WHERE status = 'active' AND list_contains(events, 'risk_tier_change')) s ON c.employer_id = s.employer_id""",
)(
    lambda i: history.change_events(_changes(i), _subscriptions(i)).select(
        "subscription_id", "customer_id", "employer_id", "payload.previous_risk_tier", "payload.new_risk_tier", "payload.details_url"
    )
)
register(
    "industry_benchmark",
    "naics_4digit:s employer_count:i avg_inspections:d avg_violations:d avg_penalties:d median_penalties:d high_count:i elevated_count:i medium_count:i low_count:i",
    """SELECT left(naics_code, 4) AS naics_4digit, count(DISTINCT employer_id) AS employer_count, avg(osha_inspections) AS avg_inspections,
  avg(osha_violations) AS avg_violations, avg(CAST(osha_total_penalties AS DOUBLE)) AS avg_penalties,
  quantile_cont(CAST(osha_total_penalties AS DOUBLE), 0.5) AS median_penalties, count(*) FILTER (risk_tier = 'HIGH') AS high_count,
  count(*) FILTER (risk_tier = 'ELEVATED') AS elevated_count, count(*) FILTER (risk_tier = 'MEDIUM') AS medium_count,
  count(*) FILTER (risk_tier = 'LOW') AS low_count FROM served WHERE naics_code IS NOT NULL GROUP BY 1""",
)(lambda i: reports.industry_benchmark(i.served))
register(
    "industry_benchmark_extras",
    "naics_4digit:s employer_count:i pct_with_willful:d pct_with_repeat:d median_inspection_count:d median_violation_count:d median_penalty_total:d",
    """SELECT naics_4digit, count(*) AS employer_count, avg(CAST(osha_willful_count > 0 AS INTEGER)) AS pct_with_willful,
  avg(CAST(osha_repeat_count > 0 AS INTEGER)) AS pct_with_repeat, quantile_cont(CAST(osha_inspections AS DOUBLE), 0.5) AS median_inspection_count,
  quantile_cont(CAST(osha_violations AS DOUBLE), 0.5) AS median_violation_count,
  quantile_cont(CAST(osha_total_penalties AS DOUBLE), 0.5) AS median_penalty_total FROM profile WHERE naics_4digit IS NOT NULL GROUP BY 1""",
)(lambda i: reports.industry_benchmark_extras(i.profile))
register(
    "industry_directory", "naics_4digit:s employer_count:i",
    "SELECT left(naics_code, 4) AS naics_4digit, count(DISTINCT employer_id) AS employer_count FROM served WHERE naics_code IS NOT NULL GROUP BY 1",
)(lambda i: reports.industry_directory(i.served))
register(
    "industry_search", "naics_4digit:s description:s",
    """SELECT left(naics_code, 4) AS naics_4digit, arg_min(naics_title, naics_code) AS description FROM naics_2022
WHERE naics_code LIKE '23%' AND lower(naics_title) LIKE '%try 1%' GROUP BY 1""",
)(lambda i: reports.industry_search(i.naics, sector="23", text="TRY 1"))
register(
    "monthly_usage", "key_hash:s month:t requests:i lookups:i monthly_limit:i remaining:i remaining_by_lookups:i quota_exceeded:b",
    """SELECT key_hash, month, requests, lookups, monthly_limit, greatest(0, monthly_limit - requests) AS remaining,
  greatest(0, monthly_limit - lookups) AS remaining_by_lookups, requests >= monthly_limit AS quota_exceeded
FROM (SELECT key_hash, date_trunc('month', queried_at) AS month, count(*) AS requests, sum(lookup_count) AS lookups
  FROM api_usage GROUP BY 1, 2) u JOIN api_keys USING (key_hash)""",
)(lambda i: reports.monthly_usage(i.raw("api_usage"), i.raw("api_keys")))
register(
    "feedback_summary", "employer_id:s type:s reports:i customers:i",
    "SELECT employer_id, type, count(*) AS reports, count(DISTINCT customer_id) AS customers FROM feedback WHERE type <> 'unsupported' GROUP BY 1, 2",
)(lambda i: reports.feedback_summary(i.raw("feedback")))
register(
    "window_summary", "employer_key:s inspection_count:i violation_count:i penalty_total:d willful_count:i repeat_count:i serious_count:i",
    f"""SELECT {o.key('name_normalized', 'site_state', 'zip5')} AS employer_key, count(DISTINCT activity_nr) AS inspection_count,
  sum(violation_count) AS violation_count, sum(total_penalties) AS penalty_total, sum(willful_count) AS willful_count,
  sum(repeat_count) AS repeat_count, sum(serious_count) AS serious_count FROM osha WHERE open_date >= {o.years_ago(2)} GROUP BY 1""",
)(lambda i: reports.window_summary(i.osha, AS_OF, years=2))
register(
    "provenance",
    "employer_key:s osha_records:i osha_first_date:t osha_last_date:t whd_records:i whd_first_date:t whd_last_date:t multi_agency_enforcement:b",
    f"""SELECT coalesce(a.k, b.k) AS employer_key, coalesce(osha_records, 0) AS osha_records, osha_first_date, osha_last_date,
  coalesce(whd_records, 0) AS whd_records, whd_first_date, whd_last_date, a.k IS NOT NULL AND b.k IS NOT NULL AS multi_agency_enforcement
FROM (SELECT {o.key('name_normalized', 'site_state', 'zip5')} AS k, count(*) AS osha_records, min(open_date) AS osha_first_date,
  max(open_date) AS osha_last_date FROM osha GROUP BY 1) a FULL JOIN (SELECT {o.key('name_normalized', 'state', 'zip5')} AS k,
  count(*) AS whd_records, min(findings_end_date) AS whd_first_date, max(findings_end_date) AS whd_last_date FROM whd GROUP BY 1) b ON a.k = b.k""",
)(lambda i: reports.provenance(i.osha, i.whd))
register(
    "top_violators", "employer_id:s osha_violations:i osha_total_penalties:d risk_tier:s",
    "SELECT * FROM profile ORDER BY osha_violations DESC, osha_total_penalties DESC, employer_id LIMIT 20",
)(lambda i: reports.top_violators(i.profile))
register(
    "high_risk_by_industry", "naics_4digit:s employers:i high_risk:i",
    "SELECT naics_4digit, count(*) AS employers, count(*) FILTER (risk_tier = 'HIGH') AS high_risk FROM profile WHERE naics_4digit IS NOT NULL GROUP BY 1",
)(lambda i: reports.high_risk_by_industry(i.profile))
register(
    "risk_by_state", "state:s high_count:i elevated_count:i medium_count:i low_count:i avg_risk_score:d",
    """SELECT state, count(*) FILTER (risk_tier = 'HIGH') AS high_count, count(*) FILTER (risk_tier = 'ELEVATED') AS elevated_count,
  count(*) FILTER (risk_tier = 'MEDIUM') AS medium_count, count(*) FILTER (risk_tier = 'LOW') AS low_count, avg(risk_score) AS avg_risk_score
FROM profile GROUP BY state""",
)(lambda i: reports.risk_by_state(i.profile))
register(
    "tier_trend", "snapshot_date:t risk_tier:s employers:i",
    "SELECT snapshot_date, risk_tier, count(*) AS employers FROM history GROUP BY 1, 2",
)(lambda i: reports.tier_trend(i.history))
register(
    "citations_by_month", "month:t violations:i penalties:d",
    """SELECT date_trunc('month', issuance_date) AS month, count(*) AS violations, sum(coalesce(current_penalty, initial_penalty, 0)) AS penalties
FROM stg_violations WHERE issuance_date IS NOT NULL GROUP BY 1""",
)(lambda i: reports.citations_by_month(i.stg_violations))
register(
    "top_employers_per_state", "state:s employer_id:s risk_score:d rank:i",
    """SELECT state, employer_id, risk_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY risk_score DESC, employer_id)
  AS rank FROM profile WHERE state IS NOT NULL) x WHERE rank <= 3""",
)(lambda i: reports.top_per_group(i.profile.filter("state IS NOT NULL"), "state", [F.desc("risk_score"), F.asc("employer_id")], 3))

# --- linkage ---

register(
    "er_input", "unique_id:s source:s name_normalized:s name_prefix:s zip5:s site_state:s naics_4digit:s address_key:s",
    "SELECT * FROM records",
)(lambda i: i.records)
register(
    "candidate_pairs", "match_rule:i pairs:i", "SELECT match_rule, count(*) AS pairs FROM raw_pairs GROUP BY match_rule"
)(lambda i: linkage.candidate_pair_counts(i.records))
register(
    "candidate_pairs_missing_prefix", "match_rule:i pairs:i",
    """WITH filled AS (SELECT unique_id, zip5, site_state, name_prefix, coalesce(naics_4digit, '0000') AS naics FROM records)
SELECT match_rule, count(*) AS pairs FROM (SELECT l.unique_id AS a, r.unique_id AS b, min(CASE WHEN l.zip5 = r.zip5 THEN 1
  WHEN l.site_state = r.site_state THEN 2 ELSE 3 END) AS match_rule FROM filled l JOIN filled r ON l.unique_id < r.unique_id
  AND l.name_prefix = r.name_prefix AND (l.zip5 = r.zip5 OR l.site_state = r.site_state OR l.naics = r.naics) GROUP BY 1, 2
UNION ALL SELECT l.unique_id, r.unique_id, 1 FROM filled l JOIN filled r ON l.zip5 = r.zip5 AND l.unique_id < r.unique_id AND l.name_prefix <> r.name_prefix) p
GROUP BY match_rule""",
)(lambda i: linkage.candidate_pair_counts(linkage.linkage_input(i.osha, i.whd, missing_prefix="0000")))
_GAMMAS = [*linkage.FIELDS, "name_prefix"]
o.VIEWS |= {
    "pair_patterns": f"""SELECT {', '.join(f'CAST(l.{f} = r.{f} AS INTEGER) AS gamma_{f}' for f in _GAMMAS)}, match_rule, count(*) AS pairs
FROM raw_pairs JOIN records l ON id_l = l.unique_id JOIN records r ON id_r = r.unique_id GROUP BY ALL"""
}
register(
    "pair_patterns", " ".join(f"gamma_{f}:i" for f in _GAMMAS) + " match_rule:i pairs:i", "SELECT * FROM pair_patterns",
)(lambda i: linkage.pair_patterns(i.records))


def _learnt_m(rule: int, rounds: int = 5) -> str:
    """The rounds of expectation and maximisation over the patterns of one blocking rule, one after the other."""
    blocked = linkage.BLOCKING_RULES[rule - 1]
    fields = [f for f in linkage.FIELDS if f not in blocked]
    holds = " AND ".join(f"gamma_{f} = 1" for f in blocked)
    u = {f: f"(SELECT least(greatest(u, 1e-12), 1 - 1e-12) FROM chance WHERE field = '{f}')" for f in fields}
    steps = [f"pat AS (SELECT * FROM pair_patterns WHERE {holds})", "it0 AS (SELECT 0.01::DOUBLE AS share, " + ", ".join(f"0.95::DOUBLE AS m_{f}" for f in fields) + ")"]
    for k in range(rounds):
        match = " * ".join(["share", *[f"CASE gamma_{f} WHEN 1 THEN m_{f} WHEN 0 THEN 1 - m_{f} ELSE 1 END" for f in fields]])
        chance = " * ".join(["(1 - share)", *[f"CASE gamma_{f} WHEN 1 THEN {u[f]} WHEN 0 THEN 1 - {u[f]} ELSE 1 END" for f in fields]])
        told = ", ".join(
            f"""least(greatest(coalesce(sum(w * pairs) FILTER (gamma_{f} = 1) / nullif(sum(w * pairs) FILTER (gamma_{f} IS NOT NULL), 0),
  any_value(m_{f})), 1e-6), 1 - 1e-6) AS m_{f}""" for f in fields
        )
        steps.append(f"""it{k + 1} AS (SELECT sum(w * pairs) / sum(pairs) AS share, {told}
FROM (SELECT *, hit / (hit + accident) AS w FROM (SELECT *, {match} AS hit, {chance} AS accident FROM pat, it{k}) x) y)""")
    rows = " UNION ALL ".join(f"SELECT {rule} AS match_rule, '{f}' AS field, m_{f} AS m FROM it{rounds}" for f in fields)
    return f"SELECT * FROM (WITH {', '.join(steps)} {rows}) rule{rule}"


register("m_values", "match_rule:i field:s m:d", " UNION ALL ".join(_learnt_m(rule) for rule in (1, 2, 3)))(
    lambda i: linkage.m_values(i.records)
)
register("u_values", "field:s known:i u:d", "SELECT * FROM chance")(lambda i: linkage.chance_agreement(i.records))
_PAIR = (
    "rep_l:s rep_r:s pairs:i gamma_name_normalized:i gamma_zip5:i gamma_naics_4digit:i gamma_site_state:i "
    "gamma_address_key:i match_rule:i match_probability:d"
)
register("scored_pairs", _PAIR, "SELECT * FROM class_pairs")(lambda i: linkage.scored_pairs(i.records))
register(
    "review_queue", "record_id_left:s record_id_right:s pairs:i match_probability:d",
    """SELECT rep_l AS record_id_left, rep_r AS record_id_right, pairs, match_probability FROM class_pairs
WHERE match_probability < 0.85 ORDER BY match_probability, rep_l, rep_r LIMIT 500""",
)(lambda i: linkage.review_queue(linkage.uncertain_pairs(i.records)))
register("clusters", "unique_id:s cluster_id:s", "SELECT * FROM clusters")(lambda i: linkage.cluster_records(i.records))
register("name_merge", "unique_id:s cluster_id:s", "SELECT * FROM merged")(
    lambda i: linkage.merge_same_names(i.clusters, i.records)
)
register("deterministic_resolution", "employer_id:s records:i", f"""SELECT {o.uuid('employer_key')} AS employer_id, sum(n) AS records
FROM (SELECT employer_key, count(*) AS n FROM osha_valid GROUP BY 1 UNION ALL SELECT employer_key, count(*) FROM whd_valid GROUP BY 1) x GROUP BY 1""")(
    lambda i: profile.valid_inspections(i.osha).select("name_normalized", F.col("site_state").alias("state"), "zip5")
    .union(profile.valid_wage_actions(i.whd).select("name_normalized", "state", "zip5"))
    .groupBy(codes.uuid_from_text(codes.employer_key(F.col("name_normalized"), F.col("state"), F.col("zip5"))).alias("employer_id"))
    .agg(F.count(F.lit(1)).alias("records"))
)


def _previous(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Clusters and ids of an imagined earlier run: linkage by name, state and zip."""
    key = codes.employer_key(F.col("name_normalized"), F.col("site_state"), F.col("zip5"))
    clusters = i.records.select("unique_id", key.alias("cluster_id"))
    ids = clusters.select("cluster_id").distinct().withColumn("employer_id", codes.uuid_from_text(F.col("cluster_id")))
    return ids, clusters


def _new_ids(i: Inputs) -> tuple[DataFrame, DataFrame]:
    clusters = i.clusters
    return stable_ids.assign_stable_ids(*_previous(i), clusters), clusters


_EARLIER = o.key("name_normalized", "site_state", "zip5")
_TAKEN = """SELECT DISTINCT ON ({0}) {0}, {1} FROM (SELECT {0}, {1}, count(*) AS shared FROM {2} GROUP BY ALL) s ORDER BY {0}, shared DESC, {1}"""
o.VIEWS |= {
    "earlier": f"SELECT unique_id, {_EARLIER} AS old_cluster, {o.uuid(_EARLIER)} AS old_id FROM records",
    "favourites": _TAKEN.format("cluster_id", "old_id", "clusters JOIN earlier USING (unique_id)"),
    "wishing": """SELECT cluster_id, count(*) AS members, min(unique_id) AS first_member, any_value(f.old_id) AS favourite,
  any_value(e.old_id) AS own FROM clusters LEFT JOIN (SELECT DISTINCT old_cluster, old_id FROM earlier) e ON old_cluster = cluster_id
  LEFT JOIN favourites f USING (cluster_id) GROUP BY cluster_id""",
    # Each round, of the clusters that wish for an id all but the largest move on to their next wish.
    "RECURSIVE contest": """SELECT cluster_id, members, first_member, CASE WHEN own IS NULL OR own = favourite THEN [favourite] WHEN favourite IS NULL
  THEN [own] ELSE [own, favourite] END AS wishes, 1 AS wish_no, true AS moved FROM wishing
UNION ALL SELECT cluster_id, members, first_member, wishes, wish_no + CAST(refused AS INTEGER), bool_or(refused) OVER () FROM (
  SELECT *, wishes[wish_no] IS NOT NULL AND row_number() OVER (PARTITION BY wishes[wish_no] ORDER BY members DESC, cluster_id) > 1 AS refused
  FROM contest WHERE moved) r""",
    "settled": f"""SELECT coalesce(wishes[wish_no], {o.uuid("'cluster|' || first_member")}) AS employer_id, cluster_id FROM contest WHERE NOT moved""",
    "heirs": _TAKEN.format("old_id", "employer_id", "earlier JOIN clusters USING (unique_id) JOIN settled USING (cluster_id)"),
}
register("stable_ids", "employer_id:s cluster_id:s", "SELECT * FROM settled")(lambda i: _new_ids(i)[0])
register(
    "retired_ids", "employer_id:s cluster_id:s superseded_by:s",
    """SELECT old_id AS employer_id, old_cluster AS cluster_id, h.employer_id AS superseded_by
FROM (SELECT DISTINCT old_id, old_cluster FROM earlier) e LEFT JOIN heirs h USING (old_id)
WHERE old_id NOT IN (SELECT employer_id FROM settled)""",
)(
    lambda i: stable_ids.retire_ids(*_previous(i), *_new_ids(i))
)


@register("linkage_run", "unique_id:s cluster_id:s", "SELECT * FROM merged")
def _linkage_run(i: Inputs) -> DataFrame:
    """A day of some records, the chances counted over all, and then the rest: clusters as if all had come at once."""
    root = scratch_path(i.spark, "linkage")
    learnt = {r["field"]: r["u"] for r in linkage.chance_agreement(i.records).collect()}
    early = linkage.linkage_input(i.osha.filter(F.col("open_date") < "1997-01-01"), i.whd)
    run_linkage(early, root, u=learnt)
    run_linkage(i.records, root)
    return read_linkage(i.spark, root, "clusters")


register(
    "precision_recall", "tp:i fp:i fn:i labelled_pairs:i precision:d recall:d enough_labels:b alert:b",
    """SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
  labelled_pairs >= 50 AS enough_labels, labelled_pairs >= 50 AND (coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) < 0.85
    OR coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) < 0.80) AS alert
FROM (SELECT count(*) FILTER (hit AND decision = 'match') AS tp, count(*) FILTER (hit AND decision = 'non_match') AS fp,
  count(*) FILTER (NOT hit AND decision = 'match') AS fn, (SELECT count(*) FROM labelled_pairs WHERE decision IS NOT NULL) AS labelled_pairs
FROM (SELECT DISTINCT least(record_id_left, record_id_right) AS a, greatest(record_id_left, record_id_right) AS b, decision,
  EXISTS (SELECT 1 FROM scored WHERE match_probability >= 0.85 AND id_l = least(record_id_left, record_id_right)
    AND id_r = greatest(record_id_left, record_id_right)) AS hit FROM labelled_pairs WHERE decision IS NOT NULL) j) t""",
)(
    lambda i: linkage.precision_recall(
        linkage.same_cluster_pairs(i.raw("labelled_pairs"), i.records, linkage.evidence_of(i.records)), i.raw("labelled_pairs")
    )
)

# --- audit ---

register(
    "cluster_histogram", "size_class:s clusters:i records:i over_50:i",
    """SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 10 THEN '3-10' WHEN n <= 50 THEN '11-50' WHEN n <= 100 THEN '51-100'
  ELSE '>100' END AS size_class, count(*) AS clusters, sum(n) AS records, count(*) FILTER (n > 50) AS over_50
FROM (SELECT cluster_id, count(*) AS n FROM clusters GROUP BY 1) s GROUP BY 1""",
)(lambda i: audit.cluster_histogram(i.clusters))
# Linkage by city puts many companies together, which is what this audit looks for.
register(
    "over_merged", "cluster_id:s members:i first_words:i names:i states:i",
    """SELECT * FROM (SELECT cluster_id, members, count(DISTINCT nullif(split_part(trim(upper(estab_name)), ' ', 1), '')) AS first_words,
  count(DISTINCT estab_name) AS names, count(DISTINCT site_state) AS states
FROM (SELECT site_city AS cluster_id, count(*) AS members FROM osha GROUP BY 1) t
JOIN osha ON site_city = cluster_id GROUP BY 1, 2) f WHERE first_words > 3""",
)(lambda i: audit.over_merged(i.osha.select(F.col("activity_nr").alias("unique_id"), F.col("site_city").alias("cluster_id")), i.osha))
register(
    "under_merged", "name_normalized:s cluster_count:i record_count:i",
    """SELECT name_normalized, count(DISTINCT cluster_id) AS cluster_count, count(DISTINCT activity_nr) AS record_count
FROM clusters JOIN osha ON unique_id = activity_nr WHERE length(name_normalized) > 3 GROUP BY 1
HAVING count(DISTINCT cluster_id) > 5""",
)(lambda i: audit.under_merged(i.clusters, i.osha))
_WATCHED = ["COLD", "WIDGET", "RED BOLT", "NEW", "FURNITURE"]
_WATCHED_SQL = ", ".join(f"('{w}')" for w in _WATCHED)
register(
    "watch_list", "company:s clusters:i inspections:i states:i split:b",
    f"""SELECT *, clusters > inspections * 0.8 AS split FROM (SELECT company, count(DISTINCT cluster_id) AS clusters,
  count(DISTINCT activity_nr) AS inspections, count(DISTINCT site_state) AS states FROM osha
  JOIN (VALUES {_WATCHED_SQL}) w (company) ON contains(name_normalized, company) LEFT JOIN clusters ON activity_nr = unique_id GROUP BY 1) x""",
)(lambda i: audit.watch_list(i.clusters, i.osha, _WATCHED))
register(
    "cluster_coverage", "inspections:i in_clusters:i profiles:i coverage:d compression_ratio:d",
    """SELECT *, CAST(in_clusters AS DOUBLE) / inspections AS coverage, CAST(inspections AS DOUBLE) / profiles AS compression_ratio
FROM (SELECT (SELECT count(*) FROM osha) AS inspections, (SELECT count(*) FROM records) AS in_clusters, (SELECT count(*) FROM profile) AS profiles) x""",
)(lambda i: audit.coverage(i.clusters, i.osha, i.profile))
register(
    "review_sample", "stratum:s employer_id:s risk_tier:s risk_score:d",
    f"""SELECT 'known' AS stratum, employer_id, risk_tier, risk_score FROM (SELECT *, row_number() OVER (PARTITION BY company
    ORDER BY osha_inspections DESC, employer_id DESC) AS rn FROM profile JOIN (VALUES {_WATCHED_SQL}) w (company)
    ON starts_with(name_normalized, company)) k WHERE rn = 1
UNION ALL SELECT 'high', employer_id, risk_tier, risk_score FROM (SELECT * FROM profile WHERE risk_tier = 'HIGH' ORDER BY risk_score DESC, employer_id LIMIT 10) h
UNION ALL SELECT 'medium', employer_id, risk_tier, risk_score FROM (SELECT * FROM profile WHERE risk_tier = 'MEDIUM' ORDER BY md5(employer_id || '#0') LIMIT 5) m
UNION ALL SELECT 'low', employer_id, risk_tier, risk_score FROM (SELECT * FROM profile WHERE risk_tier = 'LOW' AND osha_inspections >= 1
  ORDER BY md5(employer_id || '#0') LIMIT 5) l""",
)(lambda i: audit.review_sample(i.profile, _WATCHED))

# --- quality gate ---

_CHECKS = "check_name:s severity:s passed:b value:d"
_SMALL_LIMITS = {
    "osha_inspections": (1000, "CRITICAL"), "osha_violations": (1_000_000_000, "CRITICAL"), "whd_actions": (10, "WARNING"),
    "employer_profile": (500, "CRITICAL"),
}


def _raw_tables(i: Inputs) -> dict[str, DataFrame | None]:
    return {
        "osha_inspections": i.raw("raw_osha_inspections"), "osha_violations": i.raw("raw_osha_violations"), "whd_actions": None,
        "employer_profile": i.profile,
    }


register(
    "dq_minimum_rows", _CHECKS,
    """SELECT 'min_rows_osha_inspections' AS check_name, 'CRITICAL' AS severity, count(*) > 1000 AS passed, count(*) AS value FROM raw_osha_inspections
UNION ALL SELECT 'min_rows_osha_violations', 'CRITICAL', count(*) > 1000000000, count(*) FROM raw_osha_violations
UNION ALL SELECT 'min_rows_whd_actions', 'WARNING', true, 0
UNION ALL SELECT 'min_rows_employer_profile', 'CRITICAL', count(*) > 500, count(*) FROM profile""",
)(lambda i: quality.minimum_rows(_raw_tables(i), _SMALL_LIMITS))
register(
    "dq_freshness", _CHECKS,
    f"""SELECT 'latest_inspection_age_days' AS check_name, 'WARNING' AS severity, n < 180 AS passed, n AS value
FROM (SELECT DATE '2001-12-31' - max(CAST(open_date AS DATE)) AS n FROM raw_osha_inspections) x""",
)(lambda i: quality.freshness(i.raw("raw_osha_inspections"), "2001-12-31"))
register(
    "dq_join_rate", _CHECKS,
    """SELECT 'violation_join_rate' AS check_name, 'CRITICAL' AS severity, r > 0.95 AS passed, r AS value FROM (
  SELECT (SELECT count(*) FROM raw_osha_violations v JOIN stg_inspections i ON v.activity_nr = i.activity_nr) / CAST(count(*) AS DOUBLE) AS r
  FROM raw_osha_violations) x
UNION ALL SELECT 'violation_match_rate', 'INFO', true, r FROM (SELECT (SELECT count(*) FROM raw_osha_violations WHERE activity_nr IN (
  SELECT activity_nr FROM stg_inspections)) / CAST(count(*) AS DOUBLE) AS r FROM raw_osha_violations) y""",
)(lambda i: quality.join_rate(i.raw("raw_osha_violations"), i.stg_inspections))
register(
    "dq_profile_ratio", _CHECKS,
    """SELECT 'inspections_per_profile' AS check_name, 'WARNING' AS severity, r > 2 AND r < 20 AS passed, r AS value FROM (
  SELECT (SELECT count(*) FROM raw_osha_inspections) / CAST(count(*) AS DOUBLE) AS r FROM profile) x""",
)(lambda i: quality.profile_ratio(i.raw("raw_osha_inspections"), i.profile))
register(
    "dq_null_rates", _CHECKS,
    "\nUNION ALL ".join(
        f"""SELECT 'null_rate_{c}' AS check_name, '{'CRITICAL' if limit == 0 else 'WARNING'}' AS severity,
  avg(CAST({c} IS NULL AS INTEGER)) <= {limit} AS passed, avg(CAST({c} IS NULL AS INTEGER)) AS value FROM profile"""
        for c, limit in quality.MAX_NULL_RATE.items()
    ),
)(lambda i: quality.null_rates(i.profile))
_TIER_COUNTS = "\nUNION ALL ".join(
    f"""SELECT 'risk_tier_{t}' AS check_name, 'INFO' AS severity, true AS passed, count(*) FILTER (risk_tier = '{t}') AS value FROM profile"""
    for t in quality.TIERS
)
register(
    "dq_tier_distribution", _CHECKS,
    _TIER_COUNTS + """
UNION ALL SELECT 'has_high_risk', 'CRITICAL', count(*) > 0, count(*) FROM profile WHERE risk_tier = 'HIGH'
UNION ALL SELECT 'low_share', 'CRITICAL', avg(CAST(risk_tier = 'LOW' AS INTEGER)) >= 0.4, avg(CAST(risk_tier = 'LOW' AS INTEGER)) FROM profile
UNION ALL SELECT 'high_share', 'WARNING', avg(CAST(risk_tier = 'HIGH' AS INTEGER)) < 0.05, avg(CAST(risk_tier = 'HIGH' AS INTEGER)) FROM profile""",
)(lambda i: quality.tier_distribution(i.profile))
register(
    "dq_run_over_run", _CHECKS,
    """SELECT 'risk_tier_' || a.risk_tier || '_change' AS check_name, 'WARNING' AS severity, abs((a.n - b.n) / CAST(b.n AS DOUBLE)) < 0.5 AS passed,
  (a.n - b.n) / CAST(b.n AS DOUBLE) AS value FROM (SELECT risk_tier, count(*) AS n FROM profile GROUP BY 1) a
JOIN (SELECT risk_tier, count(*) AS n FROM profile_1999 WHERE state IS NOT NULL GROUP BY 1) b USING (risk_tier)
UNION ALL SELECT 'employer_profile_count_change', 'CRITICAL', (a.n - b.n) / CAST(b.n AS DOUBLE) > -0.1, (a.n - b.n) / CAST(b.n AS DOUBLE)
FROM (SELECT count(*) AS n FROM profile) a, (SELECT count(*) AS n FROM profile_1999 WHERE state IS NOT NULL) b""",
)(
    lambda i: quality.run_over_run(
        quality.profile_metrics(i.profile), quality.profile_metrics(i.profile_at("1999-08-01").filter("state IS NOT NULL"))
    )
)
register(
    "dq_id_validity", _CHECKS,
    """SELECT 'invalid_employer_ids' AS check_name, 'CRITICAL' AS severity, count(*) = 0 AS passed, count(*) AS value FROM profile
WHERE TRY_CAST(employer_id AS UUID) IS NULL""",
)(lambda i: quality.id_validity(i.profile))
register(
    "dq_parent_match_rate", _CHECKS,
    """SELECT 'parent_company_matches' AS check_name, 'INFO' AS severity, true AS passed, count(parent_name) AS value FROM profile
UNION ALL SELECT 'parent_company_match_rate', 'INFO', true, round(count(parent_name) / CAST(count(*) AS DOUBLE), 4) FROM profile""",
)(lambda i: quality.parent_match_rate(i.profile))
register(
    "dq_publish_drift", _CHECKS,
    """SELECT 'publish_drift' AS check_name, 'CRITICAL' AS severity, d <= 0.002 AS passed, d AS value FROM (
  SELECT abs(count(*) - count(state)) / CAST(count(*) AS DOUBLE) AS d FROM profile) x""",
)(lambda i: quality.publish_drift(i.profile, i.profile.filter("state IS NOT NULL")))
register(
    "dq_repeated_violations", _CHECKS,
    """SELECT 'repeated_activity_nr' AS check_name, 'INFO' AS severity, true AS passed, count(*) AS value FROM (SELECT activity_nr
  FROM stg_violations GROUP BY 1 HAVING count(*) > 1) x UNION ALL SELECT 'repeated_activity_nr_rows', 'INFO', true,
  count(*) - count(DISTINCT activity_nr) FROM stg_violations""",
)(lambda i: quality.repeated_keys(i.stg_violations, "activity_nr"))
_GATED = [
    "dq_minimum_rows", "dq_gate_freshness", "dq_gate_join_rate", "dq_profile_ratio", "dq_null_rates", "dq_tier_distribution",
    "dq_id_validity", "dq_parent_match_rate",
]
register(
    "dq_gate_freshness", _CHECKS,
    f"""SELECT 'latest_inspection_age_days' AS check_name, 'WARNING' AS severity, n < 180 AS passed, n AS value
FROM (SELECT DATE '{AS_OF}' - max(CAST(open_date AS DATE)) AS n FROM raw_osha_inspections) x""",
)(lambda i: quality.freshness(i.raw("raw_osha_inspections"), AS_OF))
register(
    "dq_gate_join_rate", _CHECKS,
    """SELECT 'violation_join_rate' AS check_name, 'CRITICAL' AS severity, r > 0.95 AS passed, r AS value FROM (
  SELECT (SELECT count(*) FROM raw_osha_violations v JOIN raw_osha_inspections i ON v.activity_nr = i.activity_nr) / CAST(count(*) AS DOUBLE) AS r
  FROM raw_osha_violations) x
UNION ALL SELECT 'violation_match_rate', 'INFO', true, r FROM (SELECT (SELECT count(*) FROM raw_osha_violations WHERE activity_nr IN (
  SELECT activity_nr FROM raw_osha_inspections)) / CAST(count(*) AS DOUBLE) AS r FROM raw_osha_violations) y""",
)(lambda i: quality.join_rate(i.raw("raw_osha_violations"), i.raw("raw_osha_inspections")))
_ALL_CHECKS = " UNION ALL ".join(f"SELECT * FROM ({ORACLES[name]}) c{n}" for n, name in enumerate(_GATED))
register("dq_gate_checks", _CHECKS, _ALL_CHECKS)(lambda i: quality.gate_checks(_raw_tables(i), i.profile, AS_OF, limits=_SMALL_LIMITS))
register("dq_gate_failures", _CHECKS, f"SELECT * FROM ({_ALL_CHECKS}) checks WHERE severity = 'CRITICAL' AND NOT passed")(
    lambda i: quality.gate_failures(quality.gate_checks(_raw_tables(i), i.profile, AS_OF, limits=_SMALL_LIMITS))
)

# --- lookup data ---

o.VIEWS |= {
    "parent_map": f"""SELECT name_pattern, parent_name, match_type FROM (SELECT *, row_number() OVER (PARTITION BY name_pattern
  ORDER BY priority, parent_name) AS rn FROM (
  SELECT {o.owner_normalized('a.name')} AS name_pattern, w.name AS parent_name, 'exact' AS match_type, 1 AS priority
  FROM ownership_links l JOIN companies w ON owner_id = w.id JOIN companies a ON asset_id = a.id
  WHERE {o.owner_normalized('a.name')} <> '' AND {o.owner_normalized('w.name')} <> ''
    AND {o.owner_normalized('a.name')} <> {o.owner_normalized('w.name')}
  UNION ALL SELECT {o.owner_normalized('name')}, name, NULL, 2 FROM companies WHERE id IN (SELECT owner_id FROM ownership_links)
    AND {o.owner_normalized('name')} <> '') p) q WHERE rn = 1""",
}
register("parent_map", "name_pattern:s parent_name:s match_type:s", "SELECT * FROM parent_map")(
    lambda i: reference_data.build_parent_map(i.raw("companies"), i.raw("ownership_links"))
)
_UNSAFE = "replace(replace({0}, ',', ''), '''', '')"
register(
    "parent_overrides", "name_pattern:s parent_name:s match_type:s",
    f"""SELECT {_UNSAFE.format('name_pattern')} AS name_pattern, {_UNSAFE.format('parent_name')} AS parent_name, match_type FROM (
  SELECT name_pattern, parent_name, 'prefix' AS match_type FROM parent_companies UNION ALL SELECT * FROM parent_map WHERE name_pattern NOT IN (
    SELECT name_pattern FROM parent_companies)) x""",
)(
    lambda i: reference_data.apply_overrides(
        reference_data.build_parent_map(i.raw("companies"), i.raw("ownership_links")), i.parents
    )
)
register(
    "naics_merge", "naics_code:s naics_title:s",
    """SELECT naics_code, naics_title FROM naics_2022 UNION ALL SELECT naics_code, min(naics_title) FROM naics_older
WHERE length(naics_code) = 6 AND naics_code NOT IN (SELECT naics_code FROM naics_2022) GROUP BY 1""",
)(lambda i: reference_data.merge_naics(i.naics, i.raw("naics_older")))
register(
    "naics_stubs", "naics_code:s naics_title:s",
    """SELECT DISTINCT naics_code, 'NAICS ' || naics_code || ' (pre-2022 code)' AS naics_title FROM profile
WHERE naics_code IS NOT NULL AND naics_code NOT IN (SELECT naics_code FROM naics_2022)""",
)(lambda i: reference_data.naics_stubs(i.profile, i.naics))

# --- sources and sinks: written to the shared scratch folder and read back ---


def _snapshot_scan(i: Inputs) -> DataFrame:
    root = scratch_path(i.spark, "bronze")
    raw = i.raw("raw_osha_inspections")
    snapshots.write_snapshot(raw.filter("naics_code IS NULL"), root, "osha_inspections", "2001-07-31")
    snapshots.write_snapshot(raw.withColumn("extra", F.lit(1)), root, "osha_inspections", "2001-08-01")
    return snapshots.read_latest(i.spark, root, "osha_inspections")


_RAW_INSPECTIONS = "activity_nr:s estab_name:s site_address:s site_city:s site_state:s site_zip:s naics_code:s open_date:s close_case_date:s insp_type:s owner_type:s"
register("latest_snapshot_scan", _RAW_INSPECTIONS, "SELECT * FROM raw_osha_inspections")(_snapshot_scan)


def _snapshot_columns(i: Inputs) -> DataFrame:
    root = scratch_path(i.spark, "bronze")
    path = snapshots.write_snapshot(i.raw("raw_msha_violations"), root, "msha_violations", "2001-08-01")
    path = snapshots.write_snapshot(i.raw("raw_msha_violations"), root, "msha_violations", "2001-08-01")
    return i.spark.read.parquet(path)


register(
    "snapshot_write_projected", "EVENT_NO:s MINE_ID:s VIOLATION_NO:s VIOLATOR_NAME:s PROPOSED_PENALTY:s NEGLIGENCE:s",
    "SELECT * FROM raw_msha_violations",
)(_snapshot_columns)


def _delimited_scan(i: Inputs) -> DataFrame:
    """Every order as a pipe-delimited line; some lines are one field short, some one too long."""
    path = scratch_path(i.spark, "bulk")
    lines = i.table("orders").select(
        F.concat_ws(
            "|", F.col("o_orderkey").cast("string"), F.col("o_orderpriority"),
            F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")),
            F.when(F.col("o_orderstatus") == "P", F.lit("one too many")),
        ).alias("KEY|PRIORITY|STATUS")
    )
    # One column under a separator that no line holds: each file gets the header line, and files are written side by side.
    lines.write.options(header="true", sep="\u0001").csv(f"{path}/file")
    return delimited.read_delimited(i.spark, f"{path}/file", ["KEY", "PRIORITY", "STATUS", "NOT_THERE"])


register(
    "delimited_scan", "KEY:s PRIORITY:s STATUS:s",
    """SELECT o_orderkey AS KEY, o_orderpriority AS PRIORITY, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS STATUS FROM orders
WHERE o_orderstatus <> 'P'""",
)(_delimited_scan)


def _ownership_lines(i: Inputs) -> DataFrame:
    text = lambda **props: F.struct(*[F.array(F.col(c)).alias(k) for k, c in props.items()])
    companies = i.raw("companies").select(
        F.to_json(F.struct("id", F.lit("Company").alias("schema"), text(name="name", country="country").alias("properties"))).alias("value")
    )
    links = i.raw("ownership_links").select(
        F.to_json(
            F.struct(
                F.concat("owner_id", "asset_id").alias("id"), F.lit("Ownership").alias("schema"),
                text(owner="owner_id", asset="asset_id").alias("properties"),
            )
        ).alias("value")
    )
    broken = i.raw("companies").select(F.concat(F.lit('{"id": '), "id").alias("value"))
    return companies.unionByName(links).unionByName(broken)


def _ownership_feed(i: Inputs) -> tuple[DataFrame, DataFrame]:
    path = scratch_path(i.spark, "feed")
    _ownership_lines(i).write.text(path)
    return ownership.read_ownership_feed(i.spark, path)


register("ownership_companies", "id:s name:s country:s jurisdiction:s", "SELECT id, name, country, '' AS jurisdiction FROM companies")(
    lambda i: _ownership_feed(i)[0]
)
register("ownership_links", "owner_id:s asset_id:s", "SELECT * FROM ownership_links")(
    lambda i: ownership.parse_ownership_lines(_ownership_lines(i))[1]
)


def _seed_join(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "seed")
    i.naics.write.option("header", True).csv(path)
    seed = delimited.read_seed(i.spark, path, "naics_code string, naics_title string")
    return i.stg_inspections.join(seed, "naics_code", "left")


register(
    "seed_join", "activity_nr:s naics_code:s naics_title:s",
    "SELECT activity_nr, i.naics_code, naics_title FROM stg_inspections i LEFT JOIN naics_2022 n ON i.naics_code = n.naics_code",
)(_seed_join)
register("materialized_silver", _OSHA, "SELECT * FROM osha")(
    lambda i: publishing.materialize(i.build_osha(), scratch_path(i.spark, "silver"))
)


def _swap(i: Inputs) -> DataFrame:
    root = scratch_path(i.spark, "serving")
    publishing.publish(i.served_at("2000-08-01"), root, "run-2", "2000-08-01")
    publishing.publish(i.served, root, "run-3", AS_OF)
    now, before = publishing.read_published(i.spark, root), publishing.read_published(i.spark, root, back=1)
    return now.select("employer_id", "risk_score", "pipeline_run_id").unionByName(
        before.select("employer_id", "risk_score", "pipeline_run_id")
    )


def _published_at_once(i: Inputs) -> DataFrame:
    """Two writers publish at the same time; both versions, with the number of versions in the log."""
    root = scratch_path(i.spark, "serving")
    runs = {"run-2": i.served_at("2000-08-01"), "run-3": i.served}
    with ThreadPoolExecutor(len(runs)) as pool:
        for done in [pool.submit(publishing.publish, served, root, run, AS_OF) for run, served in runs.items()]:
            done.result()
    versions = [publishing.read_published(i.spark, root, back).select("employer_id", "risk_score", "pipeline_run_id") for back in (0, 1)]
    return versions[0].unionByName(versions[1]).withColumn("versions", F.lit(len(CommitLog(i.spark, root).entries())))


register(
    "publish_concurrent", "employer_id:s risk_score:d pipeline_run_id:s versions:i",
    """SELECT employer_id, risk_score, 'run-3' AS pipeline_run_id, 2 AS versions FROM profile
UNION ALL SELECT employer_id, risk_score, 'run-2', 2 FROM profile_2000""",
)(_published_at_once)


def _refused(i: Inputs) -> DataFrame:
    """What is published after an empty profile was refused, with the number of folders written."""
    root = scratch_path(i.spark, "serving")
    publishing.publish(i.served, root, "run-3", AS_OF)
    try:
        publishing.publish(i.served.filter("risk_score > 1000"), root, "run-4", AS_OF)
    except ValueError:
        pass
    return publishing.read_published(i.spark, root).withColumn("folders", F.lit(len(CommitLog(i.spark, root).folders())))


register(
    "publish_refused", "employer_id:s pipeline_run_id:s folders:i",
    "SELECT employer_id, 'run-3' AS pipeline_run_id, 1 AS folders FROM profile",
)(_refused)
register(
    "publish_swap", "employer_id:s risk_score:d pipeline_run_id:s",
    "SELECT employer_id, risk_score, 'run-3' AS pipeline_run_id FROM profile UNION ALL SELECT employer_id, risk_score, 'run-2' FROM profile_2000",
)(_swap)


def _appended_history(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "history")
    for served in (i.served_at("2000-08-01"), i.served, i.served):
        publishing.append_history(served, path)
    return publishing.read_history(i.spark, path)


register("append_history_twice", _HISTORY, "SELECT * FROM history WHERE snapshot_date >= DATE '2000-08-01'")(_appended_history)


def _enriched_csv(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "enriched")
    delimited.write_csv(lookup.enrich_lookups(_lookups(i), i.served), path)
    return delimited.read_lookups(i.spark, path).fillna("")


register(
    "enriched_csv", "lookup_id:i match_confidence:s matched_name:s matched_zip:s",
    "SELECT lookup_id, coalesce(match_confidence, '') AS match_confidence, coalesce(matched_name, '') AS matched_name, coalesce(matched_zip, '') AS matched_zip FROM enriched",
)(_enriched_csv)


o.VIEWS |= {
    "up_asked": f"SELECT * REPLACE (CAST(NULL AS VARCHAR) AS q_id) FROM ({_LOOKUPS}) a",
    "up_hits": o.VIEWS["name_hits"].replace("asked", "up_asked"),
    "up_resolved": o.VIEWS["resolved"].replace("asked", "up_asked").replace("name_hits", "up_hits"),
}


def _uploaded(i: Inputs) -> DataFrame:
    """An upload in Latin-1 with its own headers, quoted commas and line breaks, enriched; the written rows and their order."""
    root = scratch_path(i.spark, "upload")
    note = F.concat(F.lit('caf\u00e9, "no. '), F.col("lookup_id"), F.lit('"\nsecond line'))
    upload = i.raw("lookups").select(
        F.col("lookup_id").alias("Ref"), F.col("name").alias("Company Name"), F.col("ein").alias("FEIN"), F.col("state").alias("St"),
        F.col("zip").alias("Zip Code"), F.col("city").alias("City"), note.alias("Note"), F.lit("mine").alias("risk_tier"),
    )
    upload.orderBy("Ref").write.options(header=True, encoding="ISO-8859-1", escape='"').csv(f"{root}/in")
    enrich_upload(i.spark, f"{root}/in", i.served, f"{root}/out")
    back = delimited.read_lookups(i.spark, f"{root}/out", quoted_breaks=True)
    return back.fillna("").withColumnsRenamed({"Ref": "lookup_id", "Company Name": "name", "Note": "note"})


register(
    "upload_enriched",
    "lookup_id:i name:s note:s risk_tier:s match_employer_id:s match_match_confidence:s match_risk_tier:s match_matched_name:s match_matched_zip:s",
    """SELECT l.lookup_id, coalesce(l.name, '') AS name, 'caf' || chr(233) || ', "no. ' || l.lookup_id || '"' || chr(10) || 'second line' AS note,
  'mine' AS risk_tier, coalesce(r.employer_id, '') AS match_employer_id, CASE WHEN r.employer_id IS NULL THEN '' WHEN sim IS NULL THEN 'exact'
    WHEN sim > 0.8 THEN 'high' WHEN sim > 0.5 THEN 'medium' ELSE 'low' END AS match_match_confidence, coalesce(s.risk_tier, '') AS match_risk_tier,
  coalesce(s.employer_name, '') AS match_matched_name, coalesce(s.zip, '') AS match_matched_zip
FROM lookups l LEFT JOIN up_resolved r ON l.lookup_id = r.lookup_id LEFT JOIN served s ON r.employer_id = s.employer_id""",
)(_uploaded)


def _metrics(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "metrics")
    for day, profile_rows in (("2001-07-30", i.profile_at("1999-08-01")), ("2001-07-31", i.profile_at("2000-08-01")), (AS_OF, i.profile)):
        publishing.write_metrics(quality.tier_distribution(profile_rows), path, day)
    return publishing.read_previous_metrics(i.spark, path, AS_OF)


register(
    "previous_metrics", _CHECKS,
    _TIER_COUNTS.replace("FROM profile", "FROM profile_2000") + """
UNION ALL SELECT 'has_high_risk', 'CRITICAL', count(*) > 0, count(*) FROM profile_2000 WHERE risk_tier = 'HIGH'
UNION ALL SELECT 'low_share', 'CRITICAL', avg(CAST(risk_tier = 'LOW' AS INTEGER)) >= 0.4, avg(CAST(risk_tier = 'LOW' AS INTEGER)) FROM profile_2000
UNION ALL SELECT 'high_share', 'WARNING', avg(CAST(risk_tier = 'HIGH' AS INTEGER)) < 0.05, avg(CAST(risk_tier = 'HIGH' AS INTEGER)) FROM profile_2000""",
)(_metrics)
_SERVED = (
    "employer_id:s snapshot_date:t pipeline_run_id:s employer_name:s address:s city:s state:s zip:s naics_code:s naics_description:s "
    "osha_inspections:i osha_violations:i osha_serious_willful:i osha_total_penalties:d osha_open_date_latest:t osha_avg_gravity:d "
    "whd_cases:i whd_backwages_total:d whd_ee_violated_total:i msha_violations:i msha_assessed_penalties:d risk_tier:s risk_score:d "
    "confidence_tier:s trend_signal:s location_count:i parent_name:s"
)
register("serving_rows", _SERVED, "SELECT * FROM served")(lambda i: i.build_served(AS_OF))


def _landed(i: Inputs, dated: bool = False) -> DataFrame:
    """Event records through the stream in two runs over one checkpoint; records without a user are set aside."""
    from riskloom.streaming.landing import land_json_lines

    root = scratch_path(i.spark, "landing")
    bronze = f"{root}/bronze/events/2001-08-01" if dated else f"{root}/bronze"
    events = i.table("events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"), "event_type"
    )
    for late in (False, True):
        part = events.filter((F.col("event_type") == "click") == late)
        part.write.mode("append").json(f"{root}/inbox")
        land_json_lines(
            i.spark, f"{root}/inbox", bronze, f"{root}/quarantine", f"{root}/checkpoint",
            "event_id long, user_id long, event_type string", ["event_id", "user_id"],
        ).awaitTermination()
    if dated:
        return snapshots.read_latest(i.spark, f"{root}/bronze", "events")
    return i.spark.read.option("recursiveFileLookup", True).parquet(bronze)


register(
    "streamed_landing", "event_id:i user_id:i event_type:s",
    "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'",
)(_landed)
register(
    "landed_then_read", "event_id:i user_id:i event_type:s",
    "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'",
)(lambda i: _landed(i, dated=True))


def _landed_once(i: Inputs) -> DataFrame:
    """A download that broke off and was resumed an hour later from the start: every record lands once."""
    from riskloom.streaming.landing import land_json_lines

    root = scratch_path(i.spark, "landing")
    events = i.table("events").select("event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"), "event_type")
    for fetched, hour in ((events.filter("event_type <> 'click'"), "00"), (events, "01")):
        fetched.withColumn("loaded_at", F.lit(f"2001-08-01 {hour}:00:00")).write.mode("append").json(f"{root}/inbox")
        land_json_lines(
            i.spark, f"{root}/inbox", f"{root}/bronze", f"{root}/quarantine", f"{root}/checkpoint",
            "event_id long, user_id long, event_type string, loaded_at timestamp", ["user_id"],
            keys=["event_id"], loaded_at="loaded_at", overlap="1 day",
        ).awaitTermination()
    return i.spark.read.option("recursiveFileLookup", True).parquet(f"{root}/bronze")


register(
    "landed_once", "event_id:i user_id:i event_type:s loaded_at:t",
    "SELECT event_id, user_id, event_type, DATE '2001-08-01' AS loaded_at FROM events WHERE event_type <> 'error'",
)(_landed_once)
