"""Column-name resolution of uploaded lookup tables."""

from __future__ import annotations

# --- Fixed values: accepted header spellings, in order of preference ---
HEADER_SYNONYMS = {
    "name": ["name", "company_name", "employer_name", "company", "employer", "business_name", "trade_name"],
    "ein": ["ein", "fein", "tax_id"],
    "state": ["state", "st", "state_code"],
    "zip": ["zip", "zip_code", "zipcode", "postal_code"],
    "city": ["city", "city_name"],
}
# --- end of fixed values ---


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """Map each known field to the input column that carries it. Raises when neither name nor ein is there."""
    by_form = {column.strip().lower().replace(" ", "_"): column for column in columns}
    found = {}
    for field, spellings in HEADER_SYNONYMS.items():
        hit = next((s for s in spellings if s in by_form), None)
        if hit is not None:
            found[field] = by_form[hit]
    if "name" not in found and "ein" not in found:
        raise ValueError(f"no name or ein column among: {', '.join(columns)}")
    return found
