"""All queries of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from rowsmith.plans import cleaning, contacts, details, leads, merges, projections, reports, resolution, segments, shaping, streams, texts
from rowsmith.plans.tables import Query

BOOKS = (reports.book, merges.book, texts.book, projections.book, contacts.book, leads.book, details.book, cleaning.book, resolution.book, streams.book, segments.book, shaping.book)


def queries() -> dict[str, Query]:
    return {name: q for b in BOOKS for name, q in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for b in BOOKS for name, s in b.sql.items()}
