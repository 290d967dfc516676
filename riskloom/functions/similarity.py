"""Text similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A gram of a word padded with two blanks before and one after. The look-ahead
# makes neighbouring grams overlap; three blanks part the words, so none spans two.
_GRAM = r"(?=( {2}[\p{L}\p{N}]| [\p{L}\p{N}][\p{L}\p{N} ]|[\p{L}\p{N}]{2}[\p{L}\p{N} ]))"


def trigrams(text: Column) -> Column:
    """Distinct three-character grams of the words of ``text``, in lower case."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "   ")
    padded = F.concat(F.lit("  "), spaced, F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(_GRAM), F.lit(1)))


def jaccard(left: Column, right: Column) -> Column:
    """Shared elements over all elements of two duplicate-free arrays; 0 for two empty ones."""
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))), F.lit(0.0)
    )


def trigram_similarity(left: Column, right: Column) -> Column:
    """Share of common trigrams, 0..1."""
    return jaccard(trigrams(left), trigrams(right))


# --- Fixed values: agreement levels of names ---
CLOSE_NAME = 0.92
NEAR_NAME = 0.80
# --- end of fixed values ---


def name_agreement_level(similarity: Column) -> Column:
    """Linkage level of a Jaro-Winkler similarity: 2 close, 1 near, 0 different; null when a name is missing."""
    return F.when(similarity >= CLOSE_NAME, 2).when(similarity >= NEAR_NAME, 1).when(similarity.isNotNull(), 0)


def jaro_winkler(left: Column, right: Column) -> Column:
    """Jaro-Winkler similarity; null when a text is null, 0 when one is empty and the other not.

    A pair is scored in Python, in batches: array functions have to copy the letters and
    their state at every step, which takes milliseconds a pair.
    """

    def score(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        if a == b:
            return 1.0
        reach = max(max(len(a), len(b)) // 2 - 1, 0)
        free, matched = list(b), []  # a letter of b that is taken becomes None
        for i, letter in enumerate(a):
            try:
                k = free.index(letter, max(i - reach, 0), i + reach + 1)
            except ValueError:
                continue
            free[k] = None
            matched.append(letter)
        m = len(matched)
        if not m:
            return 0.0
        swaps = sum(x != y for x, y in zip(matched, (y for y, left_over in zip(b, free) if left_over is None))) // 2
        jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
        common = sum(a[:n] == b[:n] for n in range(1, min(len(a), len(b), 4) + 1))
        return jaro + common * 0.1 * (1 - jaro) if jaro > 0.7 else jaro

    return F.udf(score, "double", useArrow=True)(left, right)
