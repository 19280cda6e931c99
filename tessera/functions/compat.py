"""Opt-in predicate semantics: comparisons with null are false, LIKE ignores case, null sorts as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(p: Column) -> Column:
    """Two-valued: an unknown comparison is false, so its negation is true."""
    return F.coalesce(p, F.lit(False))


def like(c: Column, pattern: str, compat: bool = False) -> Column:
    return known(c.ilike(pattern)) if compat else c.like(pattern)


def sort_key(c: Column, descending: bool = False, compat: bool = False) -> Column:
    if compat:
        c = F.coalesce(c, F.lit(0))
    return c.desc_nulls_last() if descending else c.asc_nulls_last()
