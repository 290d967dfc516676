import datetime as dt
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions import codes, dates, headers, names, scoring, similarity
from riskloom.functions.address import address_key


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "given_name, expected",
    [
        ("Walmart Inc. #1234", "WALMART"),
        ("12 34 ACME CO., LLC", "34 ACME"),
        ("A INC INC", "A INC"),
        ("CO CO CO", "CO"),
        ("A&B  Corp / DBA  X", "AB X"),
        (" Café 7-Eleven  ", "CAF 7ELEVEN"),
        ("123", ""),
        ("X LLC CO 12", "X"),
        ("Groß Incorporated", "GRO"),
        (None, None),
    ],
)
def test_normalize_name(spark, given_name, expected):
    assert one(spark, names.normalize_name(F.lit(given_name).cast("string"))) == expected


def test_owner_and_variant_names(spark):
    assert one(spark, names.normalize_owner_name(F.lit("Acme Holdings Group, Inc."))) == "ACME"
    assert one(spark, names.normalize_name_variant(F.lit("The Acme Mfg. Store #12 Co"))) == "ACME MANUFACTURING"
    assert one(spark, names.seed_safe(F.lit("O'Neil, \"A\" #1\\"))) == "ONeil A 1"


@pytest.mark.parametrize("raw, expected", [("83702-1234", "83702"), ("N/A", ""), (None, None), (" 1 2", "12")])
def test_zip5(spark, raw, expected):
    assert one(spark, codes.zip5(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    "line, zip_code, expected",
    [
        ("123 Main St, Suite 400, Boise", "83702", "123|MAIN STREET|83702"),
        ("123 N. Oak Ave Apt 4", "83702", "123|N OAK AVENUE|83702"),
        ("PO BOX 7", "83702", None),
        ("123 Main St", "8370", None),
        ("123 Main St", None, None),
        (None, "83702", None),
    ],
)
def test_address_key(spark, line, zip_code, expected):
    assert one(spark, address_key(F.lit(line).cast("string"), F.lit(zip_code).cast("string"))) == expected


def test_key_and_id(spark):
    key = codes.employer_key(F.lit("ACME"), F.lit(None).cast("string"), F.lit("83702"))
    assert one(spark, key) == "ACME||83702"
    assert one(spark, codes.is_uuid(codes.uuid_from_text(key)))
    assert not one(spark, codes.is_uuid(F.lit(None).cast("string")))


def test_dates(spark):
    assert one(spark, dates.us_date(F.lit("1/2/2020"))) == dt.date(2020, 1, 2)
    assert one(spark, dates.us_date(F.lit("2020-01-02"))) is None
    assert one(spark, dates.years_before("2024-02-29", 1)) == dt.date(2023, 2, 28)
    assert one(spark, dates.sunday_based_weekday(F.lit("2024-06-02").cast("date"))) == 0


def grams(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(*[st.text(alphabet="abcdé 1-,.", max_size=12)] * 2), min_size=1, max_size=20))
def test_trigram_similarity_is_that_of_gram_sets(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string")
    for row in rows.withColumn("s", similarity.trigram_similarity(F.col("a"), F.col("b"))).collect():
        a, b = grams(row.a), grams(row.b)
        assert row.s == pytest.approx(len(a & b) / len(a | b) if a | b else 0.0)


def test_jaro_winkler(spark):
    pairs = spark.createDataFrame([("MARTHA", "MARHTA"), ("A", None), ("", "A"), ("SAME", "SAME")], "a string, b string")
    got = [r[0] for r in pairs.select(similarity.jaro_winkler(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.961111, abs=1e-5)
    assert got[1:] == [None, 0.0, 1.0]


def test_jaro_winkler_copies_no_letters_at_each_step(spark):
    """400 pairs of 300 letters each; a copy of all letters for each of them takes minutes."""
    word = F.repeat(F.concat(F.lit("abcdefgh-"), F.col("id").cast("string"), F.lit("-xyz ")), 20)
    pairs = spark.range(100, 500).select(word.alias("a"), F.concat(word, F.lit("q")).alias("b"))
    began = time.monotonic()
    least, most = pairs.select(similarity.jaro_winkler(F.col("a"), F.col("b")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert 0.9 < least <= most < 1.0
    assert time.monotonic() - began < 30


COUNTS = (
    "osha_inspections osha_violations osha_willful_count osha_repeat_count osha_serious_count osha_other_count "
    "osha_total_penalties whd_cases whd_backwages_total whd_ee_violated_total violations_1yr violations_3yr"
).split()


def employer(spark, last=None, **counts):
    row = spark.range(1).select(
        *[F.lit(counts.get(c)).cast("decimal(18,3)").alias(c) for c in COUNTS],
        F.lit(last).cast("date").alias("osha_last_inspection_date"),
    )
    return row.select(
        scoring.risk_tier().alias("tier"), scoring.risk_score("2024-01-01").alias("score"),
        scoring.trend_signal().alias("trend"), scoring.confidence_tier().alias("confidence"),
        scoring.severe_violator().alias("severe"),
    ).first()


@pytest.mark.parametrize(
    "counts, tier",
    [
        ({}, "LOW"),
        ({"osha_willful_count": 1}, "HIGH"),
        ({"osha_repeat_count": 3}, "HIGH"),
        ({"osha_repeat_count": 2}, "LOW"),
        ({"osha_total_penalties": 100000}, "LOW"),
        ({"osha_total_penalties": 100001}, "HIGH"),
        ({"whd_backwages_total": 100001}, "HIGH"),
        ({"whd_ee_violated_total": 101}, "HIGH"),
        ({"osha_inspections": 5, "osha_violations": 10}, "ELEVATED"),
        ({"whd_cases": 3, "whd_backwages_total": 10001}, "ELEVATED"),
        ({"osha_inspections": 1, "osha_violations": 10}, "MEDIUM"),
        ({"osha_inspections": 2}, "MEDIUM"),
        ({"osha_inspections": 5}, "LOW"),
        ({"osha_violations": 3}, "MEDIUM"),
        ({"osha_violations": 2}, "LOW"),
        ({"whd_cases": 2}, "MEDIUM"),
    ],
)
def test_risk_tier(spark, counts, tier):
    assert employer(spark, **counts).tier == tier


@pytest.mark.parametrize(
    "last, factor", [(None, 1.0), ("2021-01-01", 1.0), ("2020-12-31", 0.8), ("2019-12-31", 0.6), ("2018-12-31", 0.4)]
)
def test_risk_score_decays(spark, last, factor):
    assert employer(spark, last, osha_willful_count=1, osha_other_count=3).score == pytest.approx(31.5 * factor)


def test_trend_confidence_and_severity(spark):
    assert employer(spark, violations_1yr=2, violations_3yr=3).trend == "WORSENING"
    assert employer(spark, violations_1yr=2, violations_3yr=2).trend == "STABLE"
    assert employer(spark, violations_1yr=0, violations_3yr=3).trend == "IMPROVING"
    assert employer(spark, violations_1yr=2, violations_3yr=4).trend == "STABLE"
    assert [employer(spark, osha_inspections=n).confidence for n in (0, 1, 3)] == ["LOW", "MEDIUM", "HIGH"]
    assert employer(spark, osha_serious_count=3, osha_total_penalties=50001).severe
    assert not employer(spark, osha_serious_count=3, osha_total_penalties=50000).severe


def test_headers():
    assert headers.resolve_headers(["Company Name", "FEIN", "Postal Code"]) == {
        "name": "Company Name", "ein": "FEIN", "zip": "Postal Code"
    }
    with pytest.raises(ValueError):
        headers.resolve_headers(["city"])
