"""The offline encoding of raw tracks into the table that is searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.operators.clean import (
    INDEX_COLUMN,
    fill_and_scale,
    finite,
    keep_first,
    top_per_group,
    union_in_order,
    with_group_size,
    without_remixes,
)
from tonearm.operators.taxonomy import with_genre_vectors
from tonearm.schema import DEFAULTS, ENCODED_FEATURES, META, SCALED
from tonearm.session import durable


def encode(
    tracks: DataFrame, membership: DataFrame, added: DataFrame | None = None, *, order: str = "row_id",
    added_order: str = "added_id", min_songs: int = 2, max_songs: int = 50, keep_remixes: bool = False,
) -> DataFrame:
    """Encoded tracks: names, twelve features in 0-1 and a column per genre family.

    Stages in this order, since each sees what the one before leaves: union with
    ``added`` and first row per track id (only when merging; null ids are equal),
    remixes out, missing and non-finite values filled, scaling, small artists out,
    the ``max_songs`` most popular tracks of each artist, genre vectors.
    """
    if "artist_name" not in tracks.columns or "popularity" not in tracks.columns:
        raise ValueError("artist_name and popularity are required")
    rows = tracks.drop(INDEX_COLUMN)
    ranks = [F.col("source_ord"), F.col("row_ord")]
    if added is None:
        rows = rows.withColumns({"source_ord": F.lit(0), "row_ord": F.col(order)})
    else:
        rows = union_in_order(rows.withColumnRenamed(order, "ord"), added.withColumnRenamed(added_order, "ord"), order="ord")
        rows = keep_first(rows, ["track_id"], ranks)
    if not keep_remixes and "track_name" in rows.columns:
        rows = without_remixes(rows)
    scaled = [c for c in SCALED if c in rows.columns]
    # what is read again for statistics, group sizes and genres, written once
    rows = durable(rows.select(*[c for c in META if c in rows.columns], *scaled, "source_ord", "row_ord"))
    rows = fill_and_scale(finite(rows, scaled), scaled, {k: v for k, v in DEFAULTS.items() if k in scaled})
    rows = with_group_size(rows, "artist_name", min_songs)
    rows = top_per_group(rows, "artist_name", max_songs, [F.round("popularity", 9).desc(), *ranks])
    features = [c for c in ENCODED_FEATURES if c in rows.columns]
    rows = rows.select(*[c for c in META if c in rows.columns], *features)
    if "genre" in rows.columns:
        rows = with_genre_vectors(rows, membership)
    return rows.select(*[F.col(c) if c in META else F.col(c).cast("float").alias(c) for c in rows.columns])


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows read, rows kept and artists kept."""
    kept = after.agg(F.count("*").alias("rows_kept"), F.countDistinct("artist_name").alias("artists"))
    return before.agg(F.count("*").alias("rows_read")).join(F.broadcast(kept))  # one row each
