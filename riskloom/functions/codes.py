"""Postal codes, industry codes, keys and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,3)"
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def zip5(raw: Column) -> Column:
    """First five digits; '' when there are none, null only for null."""
    return F.left(F.regexp_replace(raw, "[^0-9]", ""), F.lit(5))


def naics4(code: Column) -> Column:
    return F.left(code, F.lit(4))


def naics4_for_blocking(code4: Column) -> Column:
    """Missing industry prefix as a value of its own, so that such records share a block."""
    return F.coalesce(code4, F.lit("0000"))


def employer_key(name: Column, state: Column, zip_code: Column) -> Column:
    """``NAME|STATE|ZIP``; a missing state or zip counts as ''."""
    blank = F.lit("")
    return F.concat(name, F.lit("|"), F.coalesce(state, blank), F.lit("|"), F.coalesce(zip_code, blank))


def uuid_from_text(text: Column) -> Column:
    """MD5 of the text, written in the five groups of a UUID."""
    digest, dash = F.md5(text), F.lit("-")
    first, *rest = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(first, *[part for group in rest for part in (dash, group)])


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID_PATTERN), F.lit(False))
