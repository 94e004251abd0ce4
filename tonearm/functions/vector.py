"""Distances as generated scalar expressions, which stay inside whole-stage code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(parts: Sequence[Column]) -> Column:
    return reduce(add, parts, F.lit(0.0))


def euclidean(xs: Sequence[Column], qs: Sequence[Column], weights: Sequence[float]) -> Column:
    """Euclidean distance of weighted vectors."""
    return F.sqrt(total([(x - q) * (x - q) * F.lit(w * w) for x, q, w in zip(xs, qs, weights)]))


def cosine(xs: Sequence[Column], qs: Sequence[Column]) -> Column:
    """1 - cosine similarity; 1 where either vector is zero or there are no dimensions."""
    dot = total([x * q for x, q in zip(xs, qs)])
    norms = F.sqrt(total([x * x for x in xs])) * F.sqrt(total([q * q for q in qs]))
    return F.lit(1.0) - F.coalesce(F.try_divide(dot, norms), F.lit(0.0))


def hybrid(audio: Column, genre: Column, genre_weight: Column | float) -> Column:
    weighted = genre * (genre_weight if isinstance(genre_weight, Column) else F.lit(genre_weight))
    return F.sqrt(audio * audio + weighted * weighted)


def half_precision(x: Column) -> Column:
    """The nearest half-precision value of a number, as a double; zero stays zero, and from 65520 it is infinity.

    Below 2^-14 values are subnormal, with the fixed step 2^-24.
    """
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    rounded = F.when(size >= 65520, F.lit(float("inf"))).otherwise(F.bround(size / step, 0) * step)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.signum(x) * rounded + F.lit(0.0))
