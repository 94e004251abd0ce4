"""Bounded mergeable heaps as aggregates: the one place that touches a function PySpark does not document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from pyspark.sql.internal import InternalFunction

    _top_k = InternalFunction.collect_top_k
except (ImportError, AttributeError):  # another release: equal results, but a group's values are held whole
    _top_k = None


def largest(entry: Column, n: int) -> Column:
    """Aggregate: the ``n`` largest values of a group, largest first.

    Spark's own mergeable heap (an object hash aggregate with partial and final
    steps, spilling to a sort when there are many groups).
    """
    return _top_k(entry, n, False) if _top_k else F.slice(F.sort_array(F.collect_list(entry), asc=False), 1, n)


def smallest(entry: Column, n: int) -> Column:
    """Aggregate: the ``n`` smallest values of a group, smallest first."""
    return _top_k(entry, n, True) if _top_k else F.slice(F.sort_array(F.collect_list(entry), asc=True), 1, n)
