"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_counts(df: DataFrame, group: str) -> DataFrame:
    """``(group, rows)`` without null groups."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("rows"))


def groups_by_threshold(df: DataFrame, group: str, least: int) -> DataFrame:
    """One row: groups of at least ``least`` rows, and smaller ones."""
    counts = group_counts(df, group)
    return counts.agg(F.count_if(F.col("rows") >= least).alias("enough"), F.count_if(F.col("rows") < least).alias("too_few"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: all rows, and exact distinct non-null values of each column."""
    return df.agg(F.count("*").alias("rows"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in columns])


def matching_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.agg(F.count_if(predicate).alias("matching"), F.count("*").alias("rows"))


def first_values(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """``(group, rows, first_<value>)``: a group's row count and the value of its first row."""
    named = df.filter(F.col(group).isNotNull())
    return named.groupBy(group).agg(F.count("*").alias("rows"), F.min_by(value, order).alias(f"first_{value}"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def sorted_values(df: DataFrame, column: str) -> DataFrame:
    """``(rank, column)``: distinct values in order, numbered; for a report of few values, such as genres."""
    return distinct_values(df, column).withColumn("rank", F.row_number().over(W.orderBy(column)).cast("int"))


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by ``order``, to be looked at."""
    return df.orderBy(*order).limit(n)


def inverted(membership: DataFrame) -> DataFrame:
    """``(family, genres, total_weight)``: the taxonomy seen from its families."""
    rows = membership.filter("family is not null")
    return rows.groupBy("family").agg(F.count("*").alias("genres"), F.sum("weight").alias("total_weight"))
