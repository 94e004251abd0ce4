"""Stages of cleaning and encoding raw tracks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.functions.missing import number_or_null
from tonearm.functions.text import is_remix
from tonearm.operators.skew import attach

INDEX_COLUMN = "Unnamed: 0"
LARGEST = 1.7976931348623157e308


def conform(df: DataFrame, columns: Mapping[str, str], extra: Sequence[str] = ()) -> DataFrame:
    """Exactly ``columns`` (name -> type) and ``extra``, in order; missing ones are null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()], *extra
    )


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Names of the columns of a class of types: ``number``, ``string`` or ``other``, in order."""
    kinds = {c.name: "number" if isinstance(c.dataType, T.NumericType) else "string" if isinstance(c.dataType, T.StringType) else "other" for c in df.schema}
    return [c for c, k in kinds.items() if k == kind]


def union_in_order(*parts: DataFrame, order: str) -> DataFrame:
    """``UNION ALL`` by name with ``source_ord``, the part's number; ``order`` ranks rows within a part."""
    tagged = [p.drop(INDEX_COLUMN).withColumn("source_ord", F.lit(i)).withColumn("row_ord", F.col(order)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def ranked_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``repeat``: 1 for the first row of each key, null keys being equal."""
    return df.withColumn("repeat", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. The filter on a row number becomes a group limit ahead of the shuffle."""
    return ranked_repeats(df, keys, order).filter("repeat = 1").drop("repeat")


def without_remixes(df: DataFrame, title: str = "track_name") -> DataFrame:
    return df.filter(~is_remix(F.col(title)))


def finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinite values become null."""
    return df.withColumns({c: number_or_null(F.col(c).cast("double"), -LARGEST, LARGEST) for c in columns})


def fill_constants(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.fillna({c: v for c, v in values.items() if c in df.columns})


def fill_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's mean: one aggregate row, broadcast. An empty column stays null."""
    means = df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    out = df.join(F.broadcast(means))  # one row
    return out.select(*[F.coalesce(c, f"mean_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def scale_to_unit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x - min) / (max - min)`` per column; a constant column becomes 0."""
    asks = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]
    out = df.join(F.broadcast(df.agg(*asks)))  # one row

    def scaled(c: str) -> Column:
        share = F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"low_{c}"))
        return F.when(F.col(c).isNotNull(), F.coalesce(share, F.lit(0.0))).alias(c)

    return out.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def fill_and_scale(df: DataFrame, columns: Sequence[str], defaults: Mapping[str, float]) -> DataFrame:
    """Constants, then means, then scaling, with one pass for all statistics.

    Filling with constants or the mean moves neither the minimum nor the maximum
    of the means' columns, so both can be taken from the same aggregate.
    """
    known = {c: F.coalesce(F.col(c), F.lit(defaults[c])) if c in defaults else F.col(c) for c in columns}
    asks = [f(known[c]).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg))]
    out = df.join(F.broadcast(df.agg(*asks)))  # one row

    def scaled(c: str) -> Column:
        x = F.coalesce(known[c], F.col(f"mean_{c}"))
        share = F.try_divide(x - F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"low_{c}"))
        return F.when(x.isNotNull(), F.coalesce(share, F.lit(0.0))).alias(c)

    return out.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def with_group_size(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups of at least ``least`` rows; null groups are dropped. Sizes are pre-aggregated and attached, so a large group is no one task."""
    big = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("group_size")).filter(F.col("group_size") >= least)
    out = attach(df.withColumn("row_hash", F.xxhash64(*df.columns)), big, group, "group_size", df.count(), "row_hash")
    return out.filter("group_size is not null").drop("group_size", "row_hash")


def top_per_group(df: DataFrame, group: str, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, as a window group limit."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("group_rank", rank).filter(F.col("group_rank") <= n).drop("group_rank")
