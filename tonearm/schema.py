"""Column names, types and constants of the track tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Columns of a raw track, in order (fixed format).
RAW_STRINGS = ("artist_name", "track_name", "track_id", "genre")
RAW_COLUMNS = (
    "artist_name", "track_name", "track_id", "popularity", "year", "genre", "danceability", "energy", "key", "loudness",
    "mode", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo", "duration_ms", "time_signature",
)
RAW = T.StructType([T.StructField(c, T.StringType() if c in RAW_STRINGS else T.DoubleType()) for c in RAW_COLUMNS])

META = ("artist_name", "track_name", "track_id", "genre")
#: Weights of the audio features in the distance, in order (fixed values).
FEATURE_WEIGHTS = {
    "popularity": 0.6,
    "year": 0.6,
    "duration_ms": 0.4,
    "acousticness": 1.2,
    "danceability": 1.2,
    "energy": 1.2,
    "valence": 1.2,
    "instrumentalness": 1.2,
    "speechiness": 1.0,
    "loudness": 1.0,
    "tempo": 1.0,
    "liveness": 1.0,
}
#: Features of an encoded track, in file order (fixed format).
ENCODED_FEATURES = (
    "popularity", "year", "duration_ms", "acousticness", "danceability", "energy", "instrumentalness", "liveness",
    "loudness", "speechiness", "tempo", "valence",
)
#: Columns scaled to 0-1 when encoding (fixed list).
SCALED = (*ENCODED_FEATURES, "key", "time_signature")
#: What a missing year and popularity become before scaling (fixed values).
DEFAULTS = {"year": 2020.0, "popularity": 25.0}
#: Tracks that represent an artist: knots (tracks it has, tracks taken) of a piecewise linear curve (fixed values).
CURVE = ((5, 5), (20, 12), (50, 25), (80, 30))
CANDIDATES_PER_DIVERSITY, TRACKS_PER_ARTIST, LEAST_TRACKS = 200, 4, 2


#: What a client lets a listener ask for (fixed values): at most so many artists, and songs of each of them; variety,
#: genre weight with its step, and results, from and to.
MOST_ARTISTS, MOST_SONGS = 5, 3
VARIETY, GENRE_WEIGHT, GENRE_WEIGHT_STEP, RESULTS = (1, 3), (0.0, 5.0), 0.5, (3, 12)


@dataclass(frozen=True)
class Request:
    """One recommendation request; defaults as in the API (fixed values)."""

    artists: tuple[str, ...]
    track_ids: tuple[str, ...] = ()
    diversity: int = 2
    max_artists: int = 6
    genre_weight: float = 2.0

    def __post_init__(self) -> None:
        if self.diversity < 1 or self.max_artists < 0 or self.genre_weight < 0:
            raise ValueError("diversity must be at least 1, max_artists and genre_weight at least 0")
        if not self.artists:
            raise ValueError("at least one artist is required")
