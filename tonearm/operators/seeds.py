"""Representative vectors of requested artists and tracks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.schema import CURVE, GENRE_WEIGHT, GENRE_WEIGHT_STEP, MOST_ARTISTS, MOST_SONGS, RESULTS, VARIETY

#: Requests, and names in all of them, up to which what is derived from requests is broadcast; more are joined.
MAX_REQUESTS, MAX_NAMES = 100_000, 1_000_000


def hint_for(requests: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``broadcast`` if the requests and the lists in them are few enough, else nothing."""
    names = F.greatest(F.size("artists"), F.lit(0)) + F.greatest(F.size("track_ids"), F.lit(0))
    size = requests.agg(F.count("*").alias("rows"), F.coalesce(F.sum(names), F.lit(0)).alias("names")).first()
    return F.broadcast if size["rows"] <= MAX_REQUESTS and size["names"] <= MAX_NAMES else lambda df: df


def client_problems(requests: DataFrame, tracks: DataFrame) -> DataFrame:
    """``(request_id, problem)``: each limit of the client a request exceeds; a request within all limits has no row.

    Songs are counted by artist, through the tracks they name; repeated names count once.
    """
    def beyond(column: str, low: float, high: float) -> Column:
        return ~F.coalesce(F.col(column).between(low, high), F.lit(False))

    step = F.col("genre_weight") / GENRE_WEIGHT_STEP
    found = {
        "artists": F.size(F.array_distinct(F.coalesce("artists", F.array()))) > MOST_ARTISTS,
        "variety": beyond("diversity", *VARIETY),
        "genre weight": beyond("genre_weight", *GENRE_WEIGHT) | (step != F.round(step)),
        "results": beyond("max_artists", *RESULTS),
    }
    problems = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in found.items()]))
    plain = requests.select("request_id", F.explode(problems).alias("problem"))
    asked = requests.select("request_id", F.explode(F.array_distinct("track_ids")).alias("track_id")).filter("track_id is not null")
    artists = tracks.filter("artist_name is not null").groupBy("track_id").agg(F.min("artist_name").alias("artist_name"))
    songs = hint_for(requests)(asked).join(artists, "track_id").groupBy("request_id", "artist_name").count()
    many = songs.filter(F.col("count") > MOST_SONGS).select("request_id", F.lit("songs").alias("problem")).distinct()
    return plain.unionByName(many)


def sample_size(n: Column) -> Column:
    """How many of an artist's ``n`` tracks represent it: the curve in whole numbers, at most ``n``."""
    (x0, y0), *rest = CURVE
    out = F.when(n <= x0, F.lit(y0))
    low_x, low_y = x0, y0
    for x, y in rest:
        out = out.when(n <= x, F.lit(low_y) + F.floor((n - low_x) * (y - low_y) / F.lit(x - low_x)))
        low_x, low_y = x, y
    return F.least(n, out.otherwise(F.lit(low_y))).cast("int")


def artist_samples(tracks: DataFrame, ident: str = "track_id") -> DataFrame:
    """The tracks that represent each artist: its most popular ones, ties by ``ident``."""
    order = W.partitionBy("artist_name").orderBy(F.col("popularity").desc_nulls_last(), F.col(ident))
    sizes = tracks.filter("artist_name is not null").groupBy("artist_name").agg(F.count("*").alias("n"))
    ranked = tracks.withColumn("taken", F.row_number().over(order)).filter(F.col("taken") <= CURVE[-1][1])
    return ranked.join(sizes, "artist_name").filter(F.col("taken") <= sample_size(F.col("n"))).drop("taken", "n")


def representative_vectors(tracks: DataFrame, requests: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(request_id, entities, <features>)``: the mean over a request's artists and tracks, each weighing the same.

    An artist is the mean of its sample. Artists named twice count twice; unknown
    artists and tracks, and requests left with neither, are dropped. ``tracks`` has
    one row per track; it is not shuffled by track if the requests are few enough to broadcast.
    """
    small = hint_for(requests)
    asked = requests.select("request_id", F.explode("artists").alias("artist_name")).filter("artist_name is not null")
    wanted = asked.select("artist_name").distinct()
    samples = artist_samples(tracks.join(small(wanted), "artist_name", "left_semi"))
    means = samples.groupBy("artist_name").agg(*[F.avg(c).alias(c) for c in features])
    entities = asked.join(means, "artist_name").select("request_id", *features)
    named = requests.select("request_id", F.explode("track_ids").alias("track_id"))
    entities = entities.unionByName(tracks.join(small(named), "track_id").select("request_id", *features))
    return entities.groupBy("request_id").agg(F.count("*").alias("entities"), *[F.avg(c).alias(c) for c in features])
