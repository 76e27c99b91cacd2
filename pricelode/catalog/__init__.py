"""Registered queries over the shared test tables, each with its comparison SQL."""

from . import changes, deals, estimates, maintenance, quality, scans, streams, texts, timed_streams, verdicts

_FAMILIES = (estimates, deals, texts, changes, maintenance, verdicts, quality, streams, timed_streams, scans)


def all_queries() -> dict:
    return {name: fn for family in _FAMILIES for name, fn in family.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, sql in family.SQL.items()}
