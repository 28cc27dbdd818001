"""Queries and their SQL by name."""

from labtrail.plans import analytics, ingest, integrity, products, rules, scalars

PARTS = (analytics, ingest, integrity, products, scalars, rules)


def _all(which: str) -> dict:
    found: dict = {}
    for part in PARTS:
        if twice := found.keys() & getattr(part, which).keys():
            raise ValueError(f"{which} named twice: {sorted(twice)}")
        found |= getattr(part, which)
    return found


QUERIES: dict = _all("QUERIES")
SQL: dict[str, str] = _all("SQL")
