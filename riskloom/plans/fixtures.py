"""Record sets of the expected shape, derived from whole tables of a TPC-H-like star schema.

Each text is SQL that Spark and DuckDB both run: ``{orders}`` stands for a
table, ``[emp]`` for another text of this module. No row is left out: modulo
expressions only choose values.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

TEXTS = {
    "emp": """
SELECT c_custkey AS ck, n_name AS st, upper(p_name) || ' ' || c_mktsegment AS base,
  10000 + c_custkey % 700 * 7 AS z, CAST(230010 + (c_custkey % 40) * 100 AS STRING) AS naics,
  'CITY ' || CAST(c_custkey % 50 AS STRING) AS city
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {part} ON p_partkey = c_custkey""",
    "raw_osha_inspections": """
SELECT CAST(o_orderkey AS STRING) AS activity_nr,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 'N/A' ELSE base || CASE o_orderkey % 6
    WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Corp'
    WHEN 3 THEN ' Co. #' || CAST(10 + o_orderkey % 90 AS STRING) WHEN 4 THEN '' ELSE ' Ltd' END END AS estab_name,
  CASE WHEN o_orderkey % 41 = 0 THEN 'PO BOX 7' ELSE CAST(100 + ck AS STRING) || CASE ck % 4
    WHEN 0 THEN ' N MAIN ST' WHEN 1 THEN ' Oak Ave' WHEN 2 THEN ' Elm St., Suite 400' ELSE ' INDUSTRIAL PKWY'
    END END AS site_address,
  city AS site_city, CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE st END AS site_state,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'N/A'
    ELSE CAST(z + o_orderkey % 7 AS STRING) || '-0001' END AS site_zip,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE naics END AS naics_code,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS open_date,
  CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE NULL END AS close_case_date,
  substr('ABCHIJKMPRSZ', CAST(o_orderkey % 12 AS INT) + 1, 1) AS insp_type, 'A' AS owner_type
FROM {orders} JOIN [emp] ON o_custkey = ck""",
    "raw_osha_violations": """
SELECT CAST(l_orderkey AS STRING) AS activity_nr, '0' || CAST(l_linenumber AS STRING) || '001' AS citation_id,
  CASE WHEN l_discount >= 0.095 AND l_quantity >= 48 THEN 'W' WHEN l_quantity >= 47 THEN 'R'
    WHEN l_quantity >= 30 THEN 'S' WHEN l_quantity >= 12 THEN 'O' WHEN l_quantity >= 4 THEN 'U' ELSE 'X' END AS viol_type,
  CAST(CAST(l_quantity AS INT) % 11 AS STRING) AS gravity, '1' AS nr_instances,
  CAST(CAST(floor(l_extendedprice / 10) AS BIGINT) AS STRING) AS initial_penalty,
  CASE WHEN l_linenumber = 3 THEN NULL
    ELSE CAST(CAST(floor(l_extendedprice * (1 - l_discount) / 10) AS BIGINT) AS STRING) END AS current_penalty,
  CAST(NULL AS STRING) AS abate_date,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS issuance_date
FROM {lineitem}""",
    "raw_whd_actions": """
SELECT CAST(event_id AS STRING) AS case_id,
  CASE WHEN event_id % 8 = 1 THEN NULL ELSE base || ' LLC' END AS trade_nm,
  CASE WHEN event_id % 16 = 1 THEN NULL ELSE base || ' Incorporated' END AS legal_name,
  CAST(100 + ck AS STRING) || ' Oak Ave' AS street_addr_1_txt, city AS cty_nm, st AS st_cd,
  CAST(z + o_orderkey % 9 AS STRING) AS zip_cd, 'INDUSTRY ' || CAST(ck % 40 AS STRING) AS naics_code_description,
  naics AS naic_cd,
  CAST(make_date(CAST(1995 + event_id % 7 AS INT), CAST(1 + event_id % 12 AS INT), CAST(1 + event_id % 28 AS INT))
    AS STRING) AS findings_start_date,
  CAST(make_date(CAST(1995 + event_id % 7 AS INT), CAST(1 + event_id % 12 AS INT), CAST(1 + event_id % 28 AS INT))
    AS STRING) AS findings_end_date,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) END AS bw_atp_amt,
  CAST(event_id % 45 AS STRING) AS ee_violtd_cnt
FROM {events} JOIN {orders} ON event_id = o_orderkey JOIN [emp] ON o_custkey = ck""",
    "raw_msha_mines": """
SELECT CAST(s_suppkey AS STRING) AS MINE_ID, 'MINE ' || CAST(s_suppkey AS STRING) AS CURRENT_MINE_NAME,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Abandoned' ELSE 'Active' END AS CURRENT_MINE_STATUS,
  base || ' Company' AS CURRENT_OPERATOR_NAME, base AS CURRENT_CONTROLLER_NAME, st AS STATE,
  'COUNTY ' || CAST(s_suppkey % 7 AS STRING) AS FIPS_CNTY_NM, '1221' AS PRIMARY_SIC,
  CAST(30 + s_suppkey % 15 AS STRING) || '.5' AS LATITUDE, '-80.25' AS LONGITUDE
FROM {supplier} JOIN [emp] ON ck = s_suppkey""",
    "raw_msha_violations": """
SELECT CAST(l_orderkey AS STRING) AS EVENT_NO, CAST(l_suppkey AS STRING) AS MINE_ID,
  CAST(l_orderkey * 10 + l_linenumber AS STRING) AS VIOLATION_NO,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE base || ' Co.' END AS VIOLATOR_NAME,
  substr(d, 6, 2) || '/' || substr(d, 9, 2) || '/' || substr(d, 1, 4) AS VIOLATION_OCCUR_DT,
  CASE WHEN l_orderkey % 13 = 0 THEN 'unknown'
    ELSE CAST(CAST(substr(d, 6, 2) AS INT) AS STRING) || '/' || CAST(CAST(substr(d, 9, 2) AS INT) AS STRING) || '/'
      || substr(d, 1, 4) END AS VIOLATION_ISSUE_DT,
  '104(a)' AS SECTION_OF_ACT, CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS SIG_SUB,
  CASE WHEN l_orderkey % 29 = 0 THEN 'n/a' ELSE CAST(CAST(floor(l_extendedprice / 100) AS BIGINT) AS STRING)
    END AS PROPOSED_PENALTY,
  CAST(CAST(floor(l_extendedprice / 200) AS BIGINT) AS STRING) AS AMOUNT_PAID, 'Moderate' AS NEGLIGENCE
FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_extendedprice,
    CAST(CAST(l_shipdate AS DATE) AS STRING) AS d FROM {lineitem}) x JOIN [emp] ON ck = l_suppkey""",
    "raw_ofccp_evaluations": """
SELECT CASE WHEN ck % 23 = 0 THEN NULL ELSE base || ' Corporation' END AS contractor_name,
  CAST(100 + ck AS STRING) || ' Oak Ave' AS street, city, st AS state, CAST(z AS STRING) || ' ' AS zip,
  naics AS naics_code,
  CAST(make_date(CAST(1996 + ck % 5 AS INT), CAST(1 + ck % 12 AS INT), 5) AS STRING) AS date_received,
  CASE WHEN ck % 3 = 0 THEN NULL
    ELSE CAST(make_date(CAST(1997 + ck % 5 AS INT), CAST(1 + ck % 12 AS INT), 9) AS STRING) END AS date_resolved,
  c_mktsegment AS resolution_type, CASE WHEN c_acctbal < 0 THEN 'Y' ELSE 'N' END AS violations_found,
  CASE WHEN ck % 4 = 0 THEN NULL ELSE CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS STRING) END AS amount_of_relief,
  CASE WHEN ck % 5 = 0 THEN NULL ELSE CAST(ck % 60 AS STRING) END AS number_of_class_members
FROM {customer} JOIN [emp] ON c_custkey = ck""",
    "raw_oflc_disclosure": """
SELECT CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE base || ' Inc' END AS employer_name,
  CAST(100 + ck AS STRING) || ' Oak Ave' AS employer_address1, city AS employer_city, st AS employer_state,
  'ZIP ' || CAST(z AS STRING) || '-4321' AS employer_postal_code, naics AS naics_code,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS received_date,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS decision_date,
  o_orderstatus AS case_status,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice / 4) AS BIGINT) AS STRING)
    END AS wage_rate_of_pay_from,
  CAST(CAST(floor(o_totalprice / 5) AS BIGINT) AS STRING) AS prevailing_wage,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 30 AS STRING) END AS total_workers,
  'Y' AS full_time_position, o_orderpriority AS visa_class, 'JOB ' || CAST(o_orderkey % 20 AS STRING) AS job_title,
  CAST(11 + o_orderkey % 20 AS STRING) || '-1011' AS soc_code, 'TITLE' AS soc_title
FROM {orders} JOIN [emp] ON o_custkey = ck""",
    "naics_2022": """
SELECT CAST(230010 + n_nationkey * 100 AS STRING) AS naics_code,
  'INDUSTRY ' || CAST(n_nationkey AS STRING) AS naics_title FROM {nation}""",
    "naics_older": """
SELECT CASE WHEN s_suppkey % 10 = 9 THEN '23' ELSE CAST(231510 + (s_suppkey % 30) * 100 AS STRING) END AS naics_code,
  'OLDER ' || CAST(s_suppkey % 30 AS STRING) AS naics_title FROM {supplier}""",
    "parent_companies": """
SELECT * FROM (VALUES ('COLD', 'Cold Group', 'prefix'), ('COLD WIDGET', 'Cold Widget Holdings', 'prefix'),
  ('RED', 'Red Corp', 'prefix'), ('BLUE BOLT', 'Blue Bolt Inc', 'prefix'),
  ('SMALL RING FURNITURE', 'Small Ring Co', 'exact')) AS t (name_pattern, parent_name, match_type)""",
    "api_usage": """
SELECT event_id AS id, md5(CAST(user_id AS STRING)) AS key_hash, user_id AS customer_id, event_type AS endpoint,
  1 + CAST(event_id % 5 AS INT) AS lookup_count, ts AS queried_at FROM {events}""",
    "api_keys": """
SELECT DISTINCT md5(CAST(user_id AS STRING)) AS key_hash, CAST(10 + user_id % 90 AS INT) AS monthly_limit FROM {events}""",
    "companies": """
SELECT 'c-' || CAST(c_custkey AS STRING) AS id, base || CASE ck % 3 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Group LLC'
  ELSE '' END AS name, 'us' AS country, st AS jurisdiction FROM {customer} JOIN [emp] ON c_custkey = ck
UNION ALL
SELECT DISTINCT 'o-' || p_type || '-' || c_mktsegment, p_type || ' ' || c_mktsegment || ' Holdings, Inc.',
  'us', CAST(NULL AS STRING) FROM {customer} JOIN {part} ON p_partkey = c_custkey""",
    "ownership_links": """
SELECT DISTINCT 'o-' || p_type || '-' || c_mktsegment AS owner_id, 'c-' || CAST(c_custkey AS STRING) AS asset_id
FROM {customer} JOIN {part} ON p_partkey = c_custkey""",
    "lookups": """
SELECT ck AS lookup_id,
  CASE WHEN ck % 37 = 0 THEN '' ELSE substr(base, 1, 2) || substr(base, 4) END AS name,
  CASE WHEN ck % 10 = 2 THEN 'EIN-' || substr(md5(base), 1, 4) END AS ein,
  CAST(NULL AS STRING) AS employer_id,
  CASE WHEN ck % 3 = 0 THEN NULL ELSE lower(st) || ' ' END AS state,
  CASE WHEN ck % 2 = 0 THEN NULL ELSE CAST(z + ck % 7 AS STRING) || '-9999' END AS zip,
  CASE WHEN ck % 5 = 0 THEN lower(city) END AS city
FROM [emp]""",
    "feedback": """
SELECT event_id AS id, md5(CAST(user_id % 20 AS STRING)) AS employer_id, user_id AS customer_id,
  CASE event_type WHEN 'click' THEN 'incorrect_match' WHEN 'view' THEN 'missing_data'
    WHEN 'purchase' THEN 'wrong_employer' WHEN 'signup' THEN 'other' ELSE 'unsupported' END AS type
FROM {events}""",
    "labelled_pairs": """
SELECT CAST(o_orderkey AS STRING) AS record_id_left, CAST(first_order AS STRING) AS record_id_right,
  CASE o_orderkey % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'non_match' ELSE NULL END AS decision
FROM {orders} JOIN (SELECT o_custkey AS fk, min(o_orderkey) AS first_order FROM {orders} GROUP BY o_custkey) f
  ON o_custkey = fk""",
}


def spark_text(name: str) -> str:
    """The text with every ``[other]`` spelled out as a subquery."""
    return re.sub(r"\[(\w+)\]", lambda m: f"({spark_text(m.group(1))}) AS {m.group(1)}", TEXTS[name])


def duckdb_text(name: str) -> str:
    """The text with plain table and CTE names."""
    return re.sub(r"[\[{](\w+)[\]}]", r"\1", TEXTS[name]).strip()


@lru_cache(maxsize=64)
def _table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _table(spark, sf_dir, name)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = spark_text(name)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
