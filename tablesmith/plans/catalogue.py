"""The queries of the engine and the SQL that says the same."""

from __future__ import annotations

from tablesmith.plans import merging, planning, quality, scraping, sourcing, texts

flagship = merging.flagship
#: The modules put their queries into one catalogue.
MODULES = (merging, quality, sourcing, texts, planning, scraping)


def queries() -> dict:
    return dict(merging.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(merging.SQL)
