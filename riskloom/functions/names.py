"""Employer-name cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: patterns whose results must agree with published profiles ---
# Each group of legal words is removed in one pass over the name, in this order.
LEGAL_WORD_GROUPS = [
    ["INC", "INCORPORATED"],
    ["LLC", "LC", "LLP", "LP", "LTD", "LIMITED"],
    ["CORP", "CORPORATION"],
    ["CO", "COMPANY", "COMPANIES"],
    ["DBA", "DOING BUSINESS AS"],
]
# Ownership-feed names lose these one word at a time, in this order.
OWNERSHIP_WORDS = [
    "INC", "INCORPORATED", "LLC", "LC", "LLP", "LP", "LTD", "LIMITED", "CORP", "CORPORATION", "CO", "COMPANY",
    "COMPANIES", "DBA", "DOING BUSINESS AS", "GROUP", "HOLDINGS", "HOLDING",
]
# Words that the fuller variant removes, and the two abbreviations it spells out.
VARIANT_WORDS = ["LLC", "INC", "CORP", "LTD", "LP", "LLP", "STORES", "COMPANY", "HOLDINGS", "CO", "THE"]
VARIANT_SITE_WORDS = ["STORE", "UNIT", "LOCATION", "PLANT", "SITE", "BRANCH"]
VARIANT_SPELLINGS = {"MFG": "MANUFACTURING", "SVC": "SERVICE"}
# Names that stand for "no name given".
JUNK_NAMES = [
    "UNKNOWNINVALID ESTABLISHMENT", "INVALID ESTABLISHMENT", "NA", "NONE", "TEST", "TBD", "NO NAME",
]
SEED_UNSAFE_CHARS = ",'\"\\#"
# --- end of fixed values ---


def _drop_words(name: Column, words: list[str]) -> Column:
    return F.regexp_replace(name, f"( |^)({'|'.join(words)})( |$)", " ")


def _tidy(name: Column) -> Column:
    without_trailing_number = F.regexp_replace(name, "[0-9]+$", "")
    return F.trim(F.regexp_replace(without_trailing_number, " +", " "))


def _letters_and_digits(name: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(name)), "[^A-Z0-9 ]", "")


def normalize_name(name: Column) -> Column:
    """Matching form of an employer name.

    A word group is removed where it does not share a blank with the match
    before it, so ``A INC INC`` keeps one INC. Letters are raised one by one: a
    sharp s is no letter A-Z and goes, where ``upper`` alone would make it SS.
    """
    ascii_letters = F.regexp_replace(F.translate(F.trim(name), "\u0131\u017f", "IS"), "[^A-Za-z0-9 ]", "")
    bare = F.regexp_replace(F.upper(ascii_letters), "^[0-9]+ ", "")
    return _tidy(reduce(_drop_words, LEGAL_WORD_GROUPS, bare))


def normalize_owner_name(name: Column) -> Column:
    """Matching form of a company name from the ownership feed."""
    bare = _letters_and_digits(name)
    return _tidy(reduce(lambda col, word: _drop_words(col, [word]), OWNERSHIP_WORDS, bare))


def normalize_name_variant(name: Column) -> Column:
    """Fuller matching form: spells out abbreviations, drops site markers and more legal words."""
    col = _letters_and_digits(name)
    for short, full in VARIANT_SPELLINGS.items():
        col = F.regexp_replace(col, rf"\b{short}\b", full)
    col = F.regexp_replace(col, rf"\b({'|'.join(VARIANT_SITE_WORDS)})\s*#?\s*[0-9]+\b", "")
    col = F.regexp_replace(col, rf"\b({'|'.join(VARIANT_WORDS)})\b", "")
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def name_prefix(name: Column) -> Column:
    return F.substring(name, 1, 4)


def first_word(name: Column) -> Column:
    """First blank-separated word in upper case; null when there is none."""
    return F.nullif(F.regexp_extract(F.upper(name), r"^\s*(\S+)", 1), F.lit(""))


def is_valid_name(name: Column) -> Column:
    """Inspection names worth profiling."""
    return name.isNotNull() & ~name.isin(JUNK_NAMES) & (F.length(name) > 2)


def is_valid_wage_name(name: Column) -> Column:
    return name.isNotNull() & (F.length(name) > 2)


def seed_safe(text: Column) -> Column:
    """Drop the characters that CSV seeds must not hold."""
    return F.translate(text, SEED_UNSAFE_CHARS, "")
