"""Top N rows of every group by a mergeable bounded heap.

Each map task keeps, for each group it meets, a heap of at most N
``(score, -id)`` entries; only those heaps are shuffled, and the reducers merge
them. A group of any size therefore sends at most N entries per map task, and no
task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.llm.heap import largest

#: Unicode-aware test for a name made of nothing but white space.
BLANK = r"(?U)^[\s\p{Z}]*$"


def top_n_per_group(df: DataFrame, group: str, score: Column, ident: str, n: int) -> DataFrame:
    """The ``n`` highest-scoring rows of every group: ``(group, ident, score, rank)``.

    Higher score first, ties to the smaller ``ident``. Rows with a null group,
    score or identifier, and NaN scores, are left out; an empty table gives an
    empty result; equal rows sharing an identifier each count. ``score`` is any
    numeric expression over ``df``; other columns are never read, so their names
    cannot clash.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    slim = df.select(
        F.col(group).alias("__g"), score.cast("double").alias("__s"), F.col(ident).cast("bigint").alias("__i")
    ).filter("__g is not null and __s is not null and not isnan(__s) and __i is not null")
    # ~i reverses the order of every bigint, the smallest included, where -i would overflow
    entry = F.struct(F.col("__s").alias("s"), F.bitwise_not(F.col("__i")).alias("r"))
    heaps = slim.groupBy("__g").agg(largest(entry, n).alias("__h"))
    rows = heaps.select(F.col("__g"), F.posexplode("__h").alias("__p", "__e"))
    return rows.select(
        F.col("__g").alias(group),
        F.bitwise_not(F.col("__e.r")).alias(ident),
        F.col("__e.s").alias("score"),
        (F.col("__p") + 1).cast("int").alias("rank"),
    )


def named_groups(df: DataFrame, column: str) -> DataFrame:
    """Rows whose group name is neither null nor blank."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).rlike(BLANK))
