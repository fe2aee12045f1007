"""Queries of the library's own operators, with their DuckDB counterparts."""

from __future__ import annotations

from .plans import queries as _own
from .plans import reports as _reports  # noqa: F401  (registers its queries)
from .plans import staged as _staged  # noqa: F401

FLAGSHIP = "triage_verdicts"


def queries() -> dict:
    return dict(_own.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_own.SQL)
