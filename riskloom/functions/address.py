"""Address keys ``NUMBER|STREET|ZIP5``."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: street types as written and as spelled out ---
STREET_TYPES = {
    "ST": "STREET", "AVE": "AVENUE", "BLVD": "BOULEVARD", "DR": "DRIVE", "RD": "ROAD", "LN": "LANE", "CT": "COURT",
    "PL": "PLACE", "CIR": "CIRCLE", "WAY": "WAY", "PKWY": "PARKWAY", "HWY": "HIGHWAY", "TRL": "TRAIL", "SQ": "SQUARE",
}
# --- end of fixed values ---

# Everything from a unit marker or the first comma on does not belong to the street.
UNIT_TAIL = r"(,|#|\b(SUITE|STE|APT|UNIT|RM|ROOM|FLOOR|FL|BLDG|DEPT|LOT)\b).*$"


def address_key(street_line: Column, zip_code: Column) -> Column:
    """Key of a street line and a five-digit zip; null when number, street or zip is missing."""
    line = F.upper(F.trim(street_line))
    number = F.regexp_extract(line, r"^([0-9]+[A-Z]?)\s", 1)
    rest = F.regexp_replace(line, r"^[0-9]+[A-Z]?\s+", "")
    rest = F.regexp_replace(F.regexp_replace(rest, UNIT_TAIL, ""), r"\.", "")
    spelled = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in STREET_TYPES.items()))
    words = F.split(F.trim(F.regexp_replace(rest, r"\s+", " ")), " ")
    street = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(spelled, w), w)), " ")
    # A missing part makes the whole null, so that each part is worked out once.
    known = F.when(F.length(zip_code) == 5, zip_code)
    return F.concat(F.nullif(number, F.lit("")), F.lit("|"), F.nullif(street, F.lit("")), F.lit("|"), known)
