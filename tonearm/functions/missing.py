"""One notion of a missing number: null, NaN or outside its possible range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_number(c: Column, low: float, high: float) -> Column:
    """True where ``c`` lies in ``low..high``; false for null and NaN.

    Spark orders NaN above every number, so the upper bound removes it.
    """
    return F.coalesce((c >= F.lit(low)) & (c <= F.lit(high)), F.lit(False))


def number_or_null(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """``c`` where it is a possible value, else null (NaN counts as null)."""
    ok = ~F.isnan(c)
    if low is not None:
        ok = ok & (c >= F.lit(low))
    if high is not None:
        ok = ok & (c <= F.lit(high))
    return F.when(ok, c)
