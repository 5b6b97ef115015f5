"""Registered queries over the tables, each with its SQL."""

from __future__ import annotations

from lexora.plans import catalog, events, lexicon, texts  # noqa: F401
from lexora.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
