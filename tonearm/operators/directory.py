"""The artist directory and look-ups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.functions.text import contains_ignoring_case


def artist_directory(tracks: DataFrame) -> DataFrame:
    """``(artist_name, popularity_sum)`` of every named artist."""
    return tracks.filter("artist_name is not null").groupBy("artist_name").agg(
        F.coalesce(F.sum(F.nanvl(F.col("popularity").cast("double"), F.lit(None))), F.lit(0.0)).alias("popularity_sum")
    )


def search(directory: DataFrame, q: str, limit: int) -> DataFrame:
    """The first ``limit`` artists whose name contains ``q``, most popular first, with their rank."""
    if limit < 0:
        raise ValueError("limit must be at least 0")
    hits = directory.filter(contains_ignoring_case(F.col("artist_name"), q)) if q else directory
    order = [F.round("popularity_sum", 6).desc(), F.col("artist_name")]
    top = hits.orderBy(*order).limit(limit)  # a top-k report
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("int"))


def valid_artists(requests: DataFrame, directory: DataFrame) -> DataFrame:
    """``(request_id, pos, artist_name)``: requested artists that exist, in order, repetitions kept."""
    asked = requests.select("request_id", F.posexplode("artists").alias("pos", "artist_name"))
    return asked.join(directory.select("artist_name"), "artist_name", "left_semi").select("request_id", "pos", "artist_name")


def unique_tracks(tracks: DataFrame) -> DataFrame:
    """``(artist_name, track_name, track_id)``: an artist's titles once each, by the smallest id."""
    named = tracks.filter("artist_name is not null")
    return named.groupBy("artist_name", "track_name").agg(F.min("track_id").alias("track_id"))


def selected_tracks(selections: DataFrame, tracks: DataFrame) -> DataFrame:
    """``selections`` (any columns, with artist_name and track_name) with ``track_id``, the smallest of the artist's tracks of that name.

    Selections of unknown tracks, or without a name, have no id.
    """
    return selections.join(unique_tracks(tracks), ["artist_name", "track_name"], "left")


def artist_tracks(tracks: DataFrame, artist: str) -> DataFrame:
    """One artist's titles; a ``LookupError`` if there is no such artist."""
    own = unique_tracks(tracks.filter(F.col("artist_name") == artist)).select("track_id", "track_name")
    if own.isEmpty():
        raise LookupError(artist)
    return own.select("*", F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("genre"))
