"""Every operator of the recommender as a query over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions import text, vector
from tonearm.operators import clean, directory, ingest, reports, seeds, taxonomy
from tonearm.plans import encode as encoding
from tonearm.plans import recommend as rec
from tonearm.plans import formats
from tonearm.plans import tracks as filling
from tonearm.schema import DEFAULTS, FEATURE_WEIGHTS, RAW_COLUMNS, RAW_STRINGS
from tonearm.session import durable
from tonearm.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(filling.QUERIES) | formats.QUERIES

HOST = "play.tunes.example"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _tracks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "data_tracks")


def _added(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "added_artists")


def _encoded(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "data_encoded")


def _serving(spark: SparkSession, folder: str) -> DataFrame:
    """Loaded once per query, as it is read several times."""
    return durable(rec.serving_table(_encoded(spark, folder), order="vec_id"))


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "recommend_requests")


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    added = _added(spark, folder).withColumnRenamed("added_id", "ord")
    return clean.union_in_order(_tracks(spark, folder).withColumnRenamed("row_id", "ord"), added, order="ord")


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


# ---- recommendation -------------------------------------------------------------------------------------------------


@query
def recommend_top(spark: SparkSession, folder: str) -> DataFrame:
    """By distance alone, for the requested artists."""
    requests = _requests(spark, folder).withColumns({"diversity": F.lit(1), "track_ids": F.lit(None).cast("array<string>")})
    return rec.recommend_all(_serving(spark, folder), requests)


@query
def recommend_with_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """By distance alone, for the requested artists and tracks."""
    return rec.recommend_all(_serving(spark, folder), _requests(spark, folder).withColumn("diversity", F.lit(1)))


@query
def recommend_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The requests as they are, candidates shuffled by a seed where diversity asks for it."""
    return rec.recommend_all(_serving(spark, folder), _requests(spark, folder))


@query
def representative_vector(spark: SparkSession, folder: str) -> DataFrame:
    tracks = _serving(spark, folder)
    features = [*rec.audio_columns(tracks), *rec.genre_columns(tracks)]
    return _rounded(seeds.representative_vectors(tracks, _requests(spark, folder), features), features)


@query
def sampling_curve(spark: SparkSession, folder: str) -> DataFrame:
    sizes = reports.group_counts(_tracks(spark, folder), "artist_name")
    return sizes.select("artist_name", "rows", seeds.sample_size(F.col("rows")).alias("taken"))


@query
def artist_samples(spark: SparkSession, folder: str) -> DataFrame:
    return seeds.artist_samples(_serving(spark, folder)).select("artist_name", "track_id")


def _top_artist_vector(tracks: DataFrame) -> DataFrame:
    """The representative vector of the artist at the head of the directory."""
    top = directory.search(directory.artist_directory(tracks), "", 1).select("artist_name")
    asked = top.select(F.lit(0).cast("bigint").alias("request_id"), F.array("artist_name").alias("artists"))
    asked = asked.withColumn("track_ids", F.lit(None).cast("array<string>"))
    return seeds.representative_vectors(tracks, asked, [*rec.audio_columns(tracks), *rec.genre_columns(tracks)])


def _distances(spark: SparkSession, folder: str) -> DataFrame:
    tracks = _serving(spark, folder)
    audio, genre = rec.audio_columns(tracks), rec.genre_columns(tracks)
    q = _top_artist_vector(tracks).select(*[F.col(c).alias(f"q_{c}") for c in [*audio, *genre]])
    both = tracks.join(F.broadcast(q))  # one row
    xs, qs = [F.col(c) for c in audio], [F.col(f"q_{c}") for c in audio]
    da = vector.euclidean(xs, qs, [FEATURE_WEIGHTS[c] for c in audio])
    dg = vector.cosine([F.col(c) for c in genre], [F.col(f"q_{c}") for c in genre])
    return both.select("track_id", da.alias("d_audio"), dg.alias("d_genre"))


@query
def weighted_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_distances(spark, folder).select("track_id", "d_audio"), ["d_audio"])


@query
def cosine_distance(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_distances(spark, folder).select("track_id", "d_genre"), ["d_genre"])


@query
def hybrid_topn(spark: SparkSession, folder: str) -> DataFrame:
    """The 400 tracks nearest to the most popular artist, as one plan ending in a top-k."""
    tracks = _serving(spark, folder)
    near = rec.nearest_to_point(tracks, _top_artist_vector(tracks), 400, 2.0)
    return _rounded(near.select("track_id", "artist_name", "d"), ["d"])


@query
def quantized_features(spark: SparkSession, folder: str) -> DataFrame:
    """Half-precision values of the raw danceability and tempo."""
    rows = clean.finite(_tracks(spark, folder), ["danceability", "tempo"])
    return rows.select("row_id", *[vector.half_precision(F.col(c)).alias(c) for c in ("danceability", "tempo")])


# ---- directory ------------------------------------------------------------------------------------------------------


@query
def artist_directory(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(directory.artist_directory(_encoded(spark, folder)), ["popularity_sum"], 4)


@query
def artist_search(spark: SparkSession, folder: str) -> DataFrame:
    hits = directory.search(directory.artist_directory(_serving(spark, folder)), "tE", 100)
    return hits.select("rank", "artist_name")


@query
def artist_typeahead(spark: SparkSession, folder: str) -> DataFrame:
    """The first 15 artists that contain the text and are not among those already chosen."""
    known = directory.artist_directory(_serving(spark, folder))
    chosen = directory.search(known, "a", 3).select("artist_name")
    left = known.join(F.broadcast(chosen), "artist_name", "left_anti")  # three names
    return directory.search(left, "a", 15).select("rank", "artist_name")


@query
def artist_tracks_unique(spark: SparkSession, folder: str) -> DataFrame:
    return directory.unique_tracks(_tracks(spark, folder))


@query
def validate_inputs(spark: SparkSession, folder: str) -> DataFrame:
    known = directory.artist_directory(_encoded(spark, folder))
    return directory.valid_artists(_requests(spark, folder), known)


@query
def health(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded(spark, folder).agg(F.lit("ok").alias("status"), F.count("*").alias("tracks_loaded"))


# ---- encoding -------------------------------------------------------------------------------------------------------


@query
def union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    rows = _merged(spark, folder)
    return rows.select("source_ord", "row_ord", "track_id", F.coalesce("batch_no", F.lit(-1)).alias("batch_no"), F.col("fetched_at").isNull().alias("no_time"))


@query
def dedupe_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean.keep_first(_merged(spark, folder), ["track_id"], [F.col("source_ord"), F.col("row_ord")])
    return rows.select("source_ord", "row_ord", "track_id")


@query
def remix_filter(spark: SparkSession, folder: str) -> DataFrame:
    return clean.without_remixes(_tracks(spark, folder)).select("row_id")


@query
def impute_constant(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean.finite(_tracks(spark, folder), ["year", "popularity"])
    return clean.fill_constants(rows, DEFAULTS).select("row_id", "year", "popularity")


@query
def impute_mean(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["danceability", "energy", "loudness", "tempo"]
    rows = clean.fill_means(clean.finite(_tracks(spark, folder), columns).select("row_id", *columns), columns)
    return _rounded(rows, columns, 5)


@query
def minmax_scale(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["danceability", "loudness", "tempo", "duration_ms"]
    rows = clean.finite(_tracks(spark, folder), columns).select("row_id", *columns)
    return _rounded(clean.scale_to_unit(rows, columns), columns)


@query
def min_group_filter(spark: SparkSession, folder: str) -> DataFrame:
    return clean.with_group_size(_tracks(spark, folder), "artist_name", 3).select("row_id")


@query
def topn_per_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean.finite(_tracks(spark, folder), ["popularity"]).filter("artist_name is not null")
    return clean.top_per_group(rows, "artist_name", 50, [F.col("popularity").desc_nulls_last(), F.col("row_id")]).select("row_id")


@query
def genre_embedding(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(taxonomy.genre_vectors(table(spark, folder, "genre_membership")), ["value"], 9)


@query
def genre_left_join(spark: SparkSession, folder: str) -> DataFrame:
    membership = table(spark, folder, "genre_membership")
    rows = taxonomy.with_genre_vectors(_tracks(spark, folder).select("row_id", "genre"), membership)
    return _rounded(rows, [c for c in rows.columns if c.startswith("genre_")])


@query
def family_inversion(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reports.inverted(table(spark, folder, "genre_membership")), ["total_weight"])


@query
def encode_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """The whole encoding: merge, filter, fill, scale, cap, genre vectors."""
    out = encoding.encode(_tracks(spark, folder), table(spark, folder, "genre_membership"), _added(spark, folder))
    return _rounded(out, [c for c in out.columns if c not in RAW_STRINGS], 4)


@query
def encode_summary(spark: SparkSession, folder: str) -> DataFrame:
    tracks = _tracks(spark, folder)
    return encoding.summary(tracks, encoding.encode(tracks, table(spark, folder, "genre_membership")))


# ---- ingestion ------------------------------------------------------------------------------------------------------


@query
def normalize_title(spark: SparkSession, folder: str) -> DataFrame:
    return _tracks(spark, folder).select("row_id", text.normalized_title(F.col("track_name")).alias("title"))


@query
def extract_id(spark: SparkSession, folder: str) -> DataFrame:
    return _added(spark, folder).select("added_id", text.id_from_url(F.col("track_id"), HOST).alias("track_id"))


@query
def title_ellipsis(spark: SparkSession, folder: str) -> DataFrame:
    return _tracks(spark, folder).select("row_id", text.shortened(F.col("track_name"), 26).alias("label"))


@query
def genre_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Outside terms: the raw genre, and the last word of it as the style."""
    terms = _tracks(spark, folder).select(
        F.col("row_id").alias("ident"), "genre", F.element_at(F.split(F.coalesce("genre", F.lit("")), " "), -1).alias("style")
    )
    return ingest.resolve_genres(terms, table(spark, folder, "genre_synonyms"))


@query
def genre_unique_match(spark: SparkSession, folder: str) -> DataFrame:
    """Each synonym key against the valid genres: matched if it is one, or part of exactly one."""
    synonyms = table(spark, folder, "genre_synonyms")
    genres = synonyms.select(F.col("genre").alias("valid")).distinct()
    pairs = synonyms.select("ord", "key").join(F.broadcast(genres), F.col("valid").contains(F.col("key")), "left")  # hand-written
    hits = pairs.groupBy("ord", "key").agg(F.count("valid").alias("hits"), F.max(F.col("valid") == F.col("key")).alias("own"), F.min("valid").alias("only"))
    found = F.when(F.col("own"), F.col("key")).when(F.col("hits") == 1, F.col("only"))
    return hits.select("ord", "key", F.when(F.col("own"), 1).otherwise(F.col("hits")).cast("bigint").alias("hits"), found.alias("genre"))


@query
def build_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Added rows split into landed track and feature records, and joined again, 15 an artist."""
    added = _added(spark, folder).filter("track_id is not null")
    link = F.concat(F.lit("https://x/track/"), F.trim("track_id"))
    tracks = added.select(
        "artist_name", "genre", F.col("track_name").alias("trackTitle"), "popularity", F.col("duration_ms").alias("durationMs"), link.alias("href")
    )
    tracks = clean.finite(tracks, ["popularity"])
    features = added.select(link.alias("href"), F.col("added_id").alias("ord"), *ingest.AUDIO)
    rows = ingest.build_rows(tracks, features, 15)
    return rows.select("artist_name", "track_name", "track_id", "genre", "popularity", "energy", "tempo", "year")


@query
def anti_join_main(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.without_known_ids(_added(spark, folder), _tracks(spark, folder)).select("added_id")


@query
def skip_known_artists(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.without_known_artists(_added(spark, folder), _tracks(spark, folder)).select("added_id")


@query
def dedupe_report(spark: SparkSession, folder: str) -> DataFrame:
    combined = _added(spark, folder).withColumn("source_ord", F.lit(0))
    rows = ingest.removal_reasons(combined, _tracks(spark, folder), "added_id")
    return rows.select("added_id", "reason").filter("reason is not null")


def _store_and_new(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The first batches as the store, the last two as what has newly landed."""
    added = _added(spark, folder)
    return added.filter("batch_no < 10 or batch_no is null"), added.filter("batch_no >= 10")


def _merge(mode: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        store, new = _store_and_new(spark, folder)
        rows = ingest.merge(store, new, _tracks(spark, folder), mode)
        return rows.select("added_id", "source_ord", "reason")

    return run


QUERIES["merge_default"] = _merge("default")
QUERIES["merge_update"] = _merge("update")
QUERIES["override_merge"] = _merge("override")


@query
def genre_update(spark: SparkSession, folder: str) -> DataFrame:
    """The last batch's genres applied to the store, by artist."""
    store, new = _store_and_new(spark, folder)
    updates = new.filter("artist_name is not null and genre is not null").select("artist_name", "genre", "added_id")
    return ingest.update_genres(store, updates, "added_id").select("added_id", "genre", "old_genre")


@query
def row_pick(spark: SparkSession, folder: str) -> DataFrame:
    """Rows 1-3 and 7 of each batch, by id."""
    picked = text.parse_ordinals("1-3,7", 10)
    ranked = clean.ranked_repeats(_added(spark, folder), ["batch_no"], [F.col("added_id")])
    return ranked.filter(F.col("repeat").isin(picked)).select("added_id", "batch_no")


@query
def raw_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Added rows conformed to the raw schema."""
    types = {c: "string" if c in RAW_STRINGS else "double" for c in RAW_COLUMNS}
    return clean.conform(_added(spark, folder), types, ["added_id"]).select("added_id", "artist_name", "track_id", "year", "mode")


# ---- reports --------------------------------------------------------------------------------------------------------


@query
def group_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.group_counts(_tracks(spark, folder), "artist_name")


@query
def groups_by_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return reports.groups_by_threshold(_tracks(spark, folder), "artist_name", 2)


@query
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.distinct_counts(_tracks(spark, folder), ["artist_name", "track_id", "genre"])


@query
def distinct_genres(spark: SparkSession, folder: str) -> DataFrame:
    return reports.distinct_values(_tracks(spark, folder), "genre")


@query
def predicate_count(spark: SparkSession, folder: str) -> DataFrame:
    return reports.matching_rows(_tracks(spark, folder), text.is_remix(F.col("track_name")))


@query
def first_value_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.first_values(_added(spark, folder), "artist_name", "genre", "added_id")
