"""Queries over the file lake, by name, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from .plans import queries as plans


def queries() -> dict[str, Callable]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)


def flagship(spark, sf_dir: str):
    return plans.QUERIES["dedup_savings"](spark, sf_dir)
