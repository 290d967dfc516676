"""Code labels and short explanations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: code tables ---
VIOLATION_LABELS = {"W": "Willful", "R": "Repeat", "S": "Serious", "O": "Other", "U": "Unclassified"}
# code, label, severity, penalty multiplier
VIOLATION_TYPES = [
    ("W", "Willful", "HIGH", 10),
    ("R", "Repeat", "HIGH", 5),
    ("S", "Serious", "MEDIUM", 1),
    ("O", "Other-than-Serious", "LOW", 0),
    ("U", "Unclassified", "LOW", 0),
]
# code, label, description
INSPECTION_TYPES = [
    ("A", "Accident", "Accident investigation"),
    ("B", "Complaint (Formal)", "Formal complaint investigation"),
    ("C", "Referral", "Referral investigation"),
    ("H", "Health", "Health inspection"),
    ("I", "Imminent Danger", "Imminent danger investigation"),
    ("J", "Variance", "Variance inspection"),
    ("K", "Complaint (Informal)", "Informal complaint investigation"),
    ("M", "Monitoring", "Follow-up monitoring inspection"),
    ("P", "Planned", "Planned/Programmed inspection"),
    ("R", "Fatality/Catastrophe", "Fatality or catastrophe investigation"),
    ("S", "Safety", "Safety inspection"),
    ("Z", "Other", "Other inspection type"),
]
NO_INSPECTIONS_NOTE = (
    "No OSHA inspections on record. This does not mean the employer is violation-free — OSHA inspects a small "
    "fraction of workplaces annually."
)
# --- end of fixed values ---


def _lookup(table: dict[str, object], code: Column) -> Column:
    entries = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.try_element_at(entries, code)


def violation_label(code: Column) -> Column:
    """Short label; an unknown code stands for itself."""
    return F.coalesce(_lookup(VIOLATION_LABELS, code), code)


def violation_type_label(code: Column) -> Column:
    return _lookup({row[0]: row[1] for row in VIOLATION_TYPES}, code)


def violation_severity(code: Column) -> Column:
    return _lookup({row[0]: row[2] for row in VIOLATION_TYPES}, code)


def violation_multiplier(code: Column) -> Column:
    return _lookup({row[0]: row[3] for row in VIOLATION_TYPES}, code)


def inspection_label(code: Column) -> Column:
    return _lookup({row[0]: row[1] for row in INSPECTION_TYPES}, code)


def match_confidence(matched: Column, similarity: Column) -> Column:
    """``exact`` for id or tax-number matches (no similarity), else by similarity; null when unmatched."""
    return F.when(
        matched,
        F.when(similarity.isNull(), "exact")
        .when(similarity > 0.8, "high")
        .when(similarity > 0.5, "medium")
        .otherwise("low"),
    )


def risk_note(inspections: Column, score: Column) -> Column:
    quiet = (F.coalesce(inspections, F.lit(0)) == 0) & (F.coalesce(score, F.lit(0.0)) == 0)
    return F.when(quiet, NO_INSPECTIONS_NOTE)
