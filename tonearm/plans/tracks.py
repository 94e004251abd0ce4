"""Queries that fill the missing values of the raw track store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators.impute import Field, fill_category, fill_numbers
from tonearm.sources.tables import table

#: Possible values of the filled fields (fixed by the data's definition).
FIELDS = (Field("year", 1950, 2025, 0), Field("popularity", 0, 100, 0), Field("tempo", 40, 230, 3))


def p4_numbers(spark: SparkSession, folder: str) -> DataFrame:
    tracks = table(spark, folder, "data_tracks")
    return fill_numbers(tracks, "row_id", "artist_name", "genre", "fetched_at", FIELDS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    marks = F.array(*[F.when(F.col(f"{f.name}_filled"), F.lit(f.name)) for f in FIELDS])
    filled = p4_numbers(spark, folder)
    return filled.select("row_id", F.explode(F.array_compact(marks)).alias("field"))


def p4_genres(spark: SparkSession, folder: str) -> DataFrame:
    return fill_category(table(spark, folder, "data_tracks"), "row_id", "artist_name", "genre", "fetched_at")


QUERIES = {"p4_found": p4_found, "p4_numbers": p4_numbers, "p4_genres": p4_genres}

ORACLE = {
    "p4_found": """
      SELECT row_id, 'year' AS field FROM data_tracks
      WHERE year IS NULL OR isnan(year) OR year NOT BETWEEN 1950 AND 2025
      UNION ALL SELECT row_id, 'popularity' FROM data_tracks
      WHERE popularity IS NULL OR isnan(popularity) OR popularity NOT BETWEEN 0 AND 100
      UNION ALL SELECT row_id, 'tempo' FROM data_tracks
      WHERE tempo IS NULL OR isnan(tempo) OR tempo NOT BETWEEN 40 AND 230
    """,
}
