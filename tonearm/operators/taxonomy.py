"""Dense genre vectors from a weighted taxonomy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a neighbour's membership that is passed on (fixed value).
DECAY = 0.5


def genre_vectors(membership: DataFrame) -> DataFrame:
    """``(genre, family, value)``: unit vectors over families, zero components left out.

    A genre's component is the larger of its own weight and half the strongest
    path genre - shared family - other genre - family. Rows without a family or
    weight say nothing.
    """
    own = membership.filter("genre is not null and family is not null and weight is not null")
    own = own.groupBy("genre", "family").agg(F.max("weight").alias("weight"))
    a, b, c = own.alias("a"), own.alias("b"), own.alias("c")
    paths = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.genre") != F.col("b.genre")))
    paths = paths.join(c, F.col("b.genre") == F.col("c.genre")).select(
        F.col("a.genre").alias("genre"),
        F.col("c.family").alias("family"),
        (F.col("a.weight") * F.col("b.weight") * F.col("c.weight") * DECAY).alias("weight"),
    )
    raw = own.unionByName(paths).groupBy("genre", "family").agg(F.max("weight").alias("weight")).filter("weight > 0")
    norms = raw.groupBy("genre").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return raw.join(norms, "genre").select("genre", "family", (F.col("weight") / F.col("norm")).alias("value"))


def families(membership: DataFrame) -> list[str]:
    """The taxonomy's families, sorted: a fixed list of a hand-written table."""
    return [r[0] for r in membership.select("family").dropna().distinct().orderBy("family").collect()]


def wide_vectors(membership: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per genre with a ``genre_<family>`` column for each of ``names``."""
    long = genre_vectors(membership)
    parts = [F.coalesce(F.max(F.when(F.col("family") == f, F.col("value"))), F.lit(0.0)).alias(f"genre_{f}") for f in names]
    return long.groupBy("genre").agg(*parts)


def with_genre_vectors(tracks: DataFrame, membership: DataFrame) -> DataFrame:
    """``tracks`` with the genre columns; genres without families, and null ones, get zeros."""
    names = families(membership)
    wide = wide_vectors(membership, names)
    # the taxonomy is hand-written: one row per genre
    out = tracks.join(F.broadcast(wide), "genre", "left")
    return out.select(*tracks.columns, *[F.coalesce(f"genre_{f}", F.lit(0.0)).alias(f"genre_{f}") for f in names])
