"""Recommendations: the best artists for requested artists and tracks, with their best tracks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.functions.vector import cosine, euclidean, hybrid
from tonearm.operators.clean import LARGEST, keep_first
from tonearm.operators.directory import artist_directory, valid_artists
from tonearm.operators.seeds import hint_for, representative_vectors
from tonearm.schema import (
    CANDIDATES_PER_DIVERSITY,
    FEATURE_WEIGHTS,
    LEAST_TRACKS,
    TRACKS_PER_ARTIST,
    Request,
)
from tonearm.session import durable

#: Requests answered in one pass over the tracks; more are answered in further passes.
BLOCK = 512
#: What is shown of a track; the id comes first.
NAMES = ("track_id", "artist_name", "track_name", "genre")
#: Decimals at which two distances count as equal, so that ties are settled by the track id.
DECIMALS = 9
#: More than the error of a distance got by matrix products.
SLACK = 1e-6


def audio_columns(df: DataFrame) -> list[str]:
    """The weighted features the table has, in the order of the weights."""
    return [c for c in FEATURE_WEIGHTS if c in df.columns]


def genre_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("genre_")]


def serving_table(encoded: DataFrame, order: str = "track_id") -> DataFrame:
    """What is searched: named artists' tracks with all audio features, the first row of each track id.

    Raises ``ValueError`` without artist_name, track_name, track_id and popularity.
    """
    for c in ("artist_name", "track_name", "track_id", "popularity"):
        if c not in encoded.columns:
            raise ValueError(f"missing column: {c}")
    audio, genre = audio_columns(encoded), genre_columns(encoded)
    rows = encoded if "genre" in encoded.columns else encoded.withColumn("genre", F.lit(None).cast("string"))
    # one flag instead of a filter per feature: Catalyst would derive constraints from each pair of them
    complete = reduce(and_, [F.abs(F.col(c).cast("double")) <= F.lit(LARGEST) for c in audio], F.lit(True))
    flag = F.when(complete & F.col("artist_name").isNotNull() & F.col("track_id").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    rows = keep_first(rows.withColumn("complete", flag).filter("complete = 1"), ["track_id"], [F.col(order)])
    numbers = [F.col(c).cast("double").alias(c) for c in audio] + [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in genre]
    return rows.select("artist_name", "track_name", "track_id", "genre", *numbers)


# ---- many requests: blocks of query vectors against all tracks ------------------------------------------------------


def _nearest_of_partition(
    asks: list[Row], audio: Sequence[str], genre: Sequence[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each request the partition's nearest tracks: one matrix product a batch finds those that may be near, whose
    exact distances go into one bounded list per request."""
    weights = np.array([FEATURE_WEIGHTS[c] for c in audio])
    qa = np.array([[r[c] for c in audio] for r in asks], float).reshape(len(asks), len(audio)) * weights
    qg = np.array([[r[c] for c in genre] for r in asks], float).reshape(len(asks), len(genre))
    factor = np.array([float(r["genre_weight"]) for r in asks])
    sizes = [CANDIDATES_PER_DIVERSITY * int(r["diversity"]) for r in asks]
    ids = [r["request_id"] for r in asks]

    genre_norms, audio_norms = np.sqrt((qg * qg).sum(1)), (qa * qa).sum(1)

    def about(xa: np.ndarray, xg: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Distances of all tracks to all requests by matrix products, to within ``SLACK``."""
        both = size[:, None] * genre_norms[None, :]
        dg = 1.0 - np.divide(xg @ qg.T, both, out=np.zeros_like(both), where=both > 0)
        return np.sqrt(np.maximum((xa * xa).sum(1)[:, None] + audio_norms[None, :] - 2 * xa @ qa.T, 0.0) + (dg * factor) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0) for _ in asks]
        names = [np.zeros((0, len(NAMES)), object) for _ in asks]
        bound = np.full(len(asks), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            xa = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in audio]) * weights
            xg = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in genre]) if genre else np.zeros((len(xa), 0))
            size = np.sqrt((xg * xg).sum(1))
            rough = about(xa, xg, size)
            for k in range(len(asks)):
                limit = bound[k]
                if len(xa) > sizes[k]:
                    limit = min(limit, np.partition(rough[:, k], sizes[k] - 1)[sizes[k] - 1] + SLACK)
                near = np.flatnonzero(rough[:, k] <= limit + SLACK)
                if not len(near):
                    continue
                both = size[near] * genre_norms[k]
                dg = 1.0 - np.divide(xg[near] @ qg[k], both, out=np.zeros(len(near)), where=both > 0)
                d = np.round(np.sqrt(((xa[near] - qa[k]) ** 2).sum(1) + (dg * factor[k]) ** 2), DECIMALS)
                own = batch.take(pa.array(near))
                rows = np.column_stack([own.column(c).to_numpy(zero_copy_only=False) for c in NAMES])
                d, n = np.concatenate([best[k], d]), np.concatenate([names[k], rows])
                if len(d) > sizes[k]:
                    close = np.flatnonzero(d <= np.partition(d, sizes[k] - 1)[sizes[k] - 1])
                    close = close[np.lexsort((n[close, 0], d[close]))][: sizes[k]]
                    d, n = d[close], n[close]
                best[k], names[k] = d, n
                if len(d) == sizes[k]:
                    bound[k] = d.max()
        for k, (d, n) in enumerate(zip(best, names)):
            if len(d):
                columns = [pa.array(n[:, i], pa.string()) for i in range(len(NAMES))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), ids[k], np.int64)), *columns, pa.array(d)], names=["request_id", *NAMES, "d"])

    return run


def nearest_tracks(tracks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(request_id, track_id, artist_name, track_name, genre, d, place)``: each request's 200 x diversity nearest tracks.

    ``vectors`` has request_id, diversity, genre_weight and the features. It is
    read in blocks of ``BLOCK`` requests; each block is one pass over the tracks.
    """
    audio, genre = audio_columns(tracks), genre_columns(tracks)
    asks = vectors.orderBy("request_id").collect()  # the stated requests, not data
    slim = tracks.select(*NAMES, *audio, *genre)
    schema = "request_id bigint, " + ", ".join(f"{c} string" for c in NAMES) + ", d double"
    found = None
    for low in range(0, len(asks), BLOCK):
        part = slim.mapInArrow(_nearest_of_partition(asks[low : low + BLOCK], audio, genre), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = tracks.sparkSession.createDataFrame([], schema)
    place = F.row_number().over(W.partitionBy("request_id").orderBy("d", "track_id"))
    sizes = tracks.sparkSession.createDataFrame(
        [(r["request_id"], CANDIDATES_PER_DIVERSITY * int(r["diversity"])) for r in asks], "request_id bigint, wanted int"
    )
    ranked = found.withColumn("place", place)
    return ranked.join(F.broadcast(sizes), "request_id").filter(F.col("place") <= F.col("wanted")).drop("wanted")


def permuted_place(seed: int) -> Column:
    """A reproducible shuffle of a request's candidates."""
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), "request_id", "track_id")), F.col("track_id")]
    return F.row_number().over(W.partitionBy("request_id").orderBy(*order))


def recommend_all(tracks: DataFrame, requests: DataFrame, seed: int = 0) -> DataFrame:
    """``(request_id, artist_rank, artist_name, track_rank, track_id, track_name, genre)`` for every request.

    ``tracks`` is a serving table; ``requests`` has request_id, artists, track_ids,
    diversity, max_artists and genre_weight. Unknown artists are dropped, and a
    request with no known artist has no answer. Scores count down from the number
    of candidates by distance, or in a seeded shuffle if diversity exceeds 1.
    Requested artists are taken out after the candidates are chosen; an artist
    needs two candidates.
    """
    audio, genre = audio_columns(tracks), genre_columns(tracks)
    small = hint_for(requests)
    wanted = requests.select(F.explode("artists").alias("artist_name")).distinct()
    named = tracks.select("artist_name").join(small(wanted), "artist_name", "left_semi").distinct()
    seeds = durable(valid_artists(requests, named))  # read three times below, and as small as the requests
    known = requests.join(seeds.select("request_id").distinct(), "request_id", "left_semi")
    settings = known.select("request_id", "diversity", "max_artists", "genre_weight")
    vectors = representative_vectors(tracks, known, [*audio, *genre]).join(settings, "request_id")
    near = nearest_tracks(tracks, vectors)
    near = near.join(small(settings.select("request_id", "diversity", "max_artists")), "request_id")
    of = F.count("*").over(W.partitionBy("request_id"))
    place = F.when(F.col("diversity") > 1, permuted_place(seed)).otherwise(F.col("place"))
    pool = near.select("request_id", *NAMES, "max_artists", (of + 1 - place).alias("score"))
    pool = pool.join(small(seeds.select("request_id", "artist_name")), ["request_id", "artist_name"], "left_anti")
    pool = durable(pool)  # 200 x diversity rows a request, read twice
    artists = pool.groupBy("request_id", "artist_name", "max_artists").agg(
        F.sum("score").alias("total"), F.count("track_id").alias("tracks")
    )
    best = W.partitionBy("request_id").orderBy(F.desc("total"), "artist_name")
    artists = artists.filter(F.col("tracks") >= LEAST_TRACKS).withColumn("artist_rank", F.row_number().over(best).cast("int"))
    artists = artists.filter(F.col("artist_rank") <= F.col("max_artists")).select("request_id", "artist_name", "artist_rank")
    own = W.partitionBy("request_id", "artist_name").orderBy(F.desc("score"))
    out = pool.join(artists, ["request_id", "artist_name"]).withColumn("track_rank", F.row_number().over(own).cast("int"))
    return out.filter(F.col("track_rank") <= TRACKS_PER_ARTIST).select(
        "request_id", "artist_rank", "artist_name", "track_rank", "track_id", "track_name", "genre"
    )


# ---- one request: a single declarative plan -------------------------------------------------------------------------


def nearest_to_point(tracks: DataFrame, point: DataFrame, n: int, genre_weight: float) -> DataFrame:
    """The ``n`` tracks nearest to a one-row ``point``: a broadcast row, an expression and a top-k."""
    audio, genre = audio_columns(tracks), genre_columns(tracks)
    q = point.select(*[F.col(c).alias(f"q_{c}") for c in [*audio, *genre]])
    both = tracks.join(F.broadcast(q))  # one row
    weights = [FEATURE_WEIGHTS[c] for c in audio]
    da = euclidean([F.col(c) for c in audio], [F.col(f"q_{c}") for c in audio], weights)
    dg = cosine([F.col(c) for c in genre], [F.col(f"q_{c}") for c in genre])
    d = F.round(hybrid(da, dg, genre_weight), DECIMALS)
    return both.select(*tracks.columns, da.alias("d_audio"), dg.alias("d_genre"), d.alias("d")).orderBy("d", "track_id").limit(n)


def request_frame(spark: SparkSession, request: Request) -> DataFrame:
    row = (0, list(request.artists), list(request.track_ids), request.diversity, request.max_artists, request.genre_weight)
    kinds = "request_id bigint, artists array<string>, track_ids array<string>, diversity int, max_artists int, genre_weight double"
    return spark.createDataFrame([row], kinds)


def recommend(tracks: DataFrame, request: Request, seed: int = 0) -> DataFrame:
    """One request's recommendations; ``ValueError`` if none of its artists is known."""
    requests = request_frame(tracks.sparkSession, request)
    if valid_artists(requests, artist_directory(tracks)).isEmpty():
        raise ValueError("no valid artists found")
    return recommend_all(tracks, requests, seed).drop("request_id")


def nested(recommendations: DataFrame) -> DataFrame:
    """``(artist_rank, artist_name, tracks)``: each artist's tracks as one ordered list, at most four."""
    keys = [c for c in ("request_id", "artist_rank", "artist_name") if c in recommendations.columns]
    track = F.struct("track_rank", "track_id", "track_name", "genre")
    return recommendations.groupBy(*keys).agg(F.array_sort(F.collect_list(track)).alias("tracks"))


def as_json(recommendations: DataFrame) -> DataFrame:
    """``(request_id, recommendations)``: the response as JSON, artist -> list of tracks, best first."""
    tracks = nested(recommendations)
    entry = F.struct("artist_rank", F.struct(F.col("artist_name").alias("key"), F.col("tracks").alias("value")).alias("e"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"])
    return tracks.groupBy("request_id").agg(F.to_json(F.map_from_entries(ordered)).alias("recommendations"))
