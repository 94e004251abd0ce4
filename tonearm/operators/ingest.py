"""Bringing newly landed tracks into the store of added artists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions.text import known_or_unknown, normalized_title, strip
from tonearm.operators.clean import ranked_repeats
from tonearm.operators.reports import preview
from tonearm.operators.skew import attach
from tonearm.schema import RAW_COLUMNS

#: Features a landed audio record supplies (fixed list).
AUDIO = (
    "danceability", "energy", "key", "loudness", "mode", "speechiness", "acousticness", "instrumentalness", "liveness",
    "valence", "tempo", "time_signature",
)


def last_segment(href):
    """The part after the last ``/``."""
    return F.element_at(F.split(href, "/"), -1)


def build_rows(tracks: DataFrame, features: DataFrame, limit: int | None = None) -> DataFrame:
    """Raw rows from landed records: tracks left joined to their audio features.

    ``tracks``: artist_name, genre, href, trackTitle, popularity, durationMs;
    ``features``: href, the audio fields and ``ord``, the later record winning.
    Tracks without an id in their href are dropped; ``limit`` keeps the most
    popular ones of each artist, missing popularity counting as 0; the year is null.
    """
    ids = tracks.withColumn("track_id", last_segment(F.col("href"))).filter("track_id is not null and track_id <> ''")
    if limit is not None:
        best = [F.coalesce("popularity", F.lit(0)).desc(), F.col("track_id")]
        ids = ranked_repeats(ids, ["artist_name"], best).filter(F.col("repeat") <= limit).drop("repeat")
    last = features.withColumn("track_id", last_segment(F.col("href")))
    last = ranked_repeats(last, ["track_id"], [F.col("ord").desc()]).filter("repeat = 1").select("track_id", *AUDIO)
    rows = ids.join(last, "track_id", "left").select(
        "*", F.lit(None).cast("double").alias("year"), known_or_unknown(F.col("genre")).alias("genre_known")
    )
    names = {"trackTitle": "track_name", "durationMs": "duration_ms"}
    rows = rows.drop("genre").withColumnRenamed("genre_known", "genre").withColumnsRenamed(names)
    return rows.select(*RAW_COLUMNS)


def resolve_genres(terms: DataFrame, synonyms: DataFrame, legacy_blank_match: bool = False) -> DataFrame:
    """``(ident, resolved)``: a genre for outside ``genre`` and ``style`` terms.

    First an equal key for the genre, then for the style; then the first key, in
    map order, that contains the term or is contained in it, for the genre before
    the style. Blank terms resolve to nothing, or with ``legacy_blank_match`` to the
    first key, which contains everything. No match gives null.
    """
    asked = terms.select(
        "ident", F.posexplode(F.array(*[strip(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in ("genre", "style")])).alias("pos", "term")
    )
    distinct = asked.select("term").distinct()
    keys = synonyms.select("ord", "key", F.col("genre").alias("hit"))
    # the synonym map is hand-written and small; distinct terms meet it, not rows
    partly = F.col("term").contains(F.col("key")) | F.col("key").contains(F.col("term"))
    if not legacy_blank_match:
        partly = partly & (F.col("term") != "")
    found = distinct.join(F.broadcast(keys), (F.col("term") == F.col("key")) | partly)
    found = found.groupBy("term").agg(
        F.min(F.when(F.col("term") == F.col("key"), F.struct("ord", "hit"))).alias("equal"), F.min(F.struct("ord", "hit")).alias("part")
    )
    options = asked.join(found, "term").select(
        "ident",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("phase"), F.col("pos"), F.col("equal.ord").alias("ord"), F.col("equal.hit").alias("hit")),
                F.struct(F.lit(1).alias("phase"), F.col("pos"), F.col("part.ord").alias("ord"), F.col("part.hit").alias("hit")),
            )
        ).alias("o"),
    ).filter("o.hit is not null")
    best = options.groupBy("ident").agg(F.min("o").alias("o")).select("ident", F.col("o.hit").alias("resolved"))
    return terms.select("ident").join(best, "ident", "left")


def without_known_ids(new: DataFrame, main: DataFrame) -> DataFrame:
    """Rows whose track id is not in ``main``; rows without an id stay."""
    return new.join(main.select("track_id").filter("track_id is not null").distinct(), "track_id", "left_anti")


def without_known_artists(new: DataFrame, *stores: DataFrame) -> DataFrame:
    """Rows of artists in none of the stores; rows without an artist stay."""
    for store in stores:
        new = new.join(store.select("artist_name").filter("artist_name is not null").distinct(), "artist_name", "left_anti")
    return new


def removal_reasons(combined: DataFrame, main: DataFrame, ident: str = "row_ord") -> DataFrame:
    """``combined`` with ``reason``: why a row is removed, or null if it stays.

    ``duplicate track_id``: the id is in ``main`` or on an earlier row (null ids are
    equal). ``similar name``: among the rows left, the normalised title is on an
    earlier row of the artist. Earlier is by (source_ord, ``ident``).
    """
    order = F.struct("source_ord", ident)
    known = main.select("track_id").filter("track_id is not null").distinct().withColumn("in_main", F.lit(True))
    # firsts by aggregates, so that no task gathers an id's rows; rows without an id are scattered, and rows of a frequent
    # id or title are left to the adaptive split of skewed joins, which meet one record each
    ids = combined.filter("track_id is not null").groupBy("track_id").agg(F.min(order).alias("first"))
    ids = ids.join(known, "track_id", "left").withColumn("salt", F.lit(0).cast("bigint"))
    scatter = F.when(F.col("track_id").isNull(), F.xxhash64(ident)).otherwise(F.lit(0))
    rows = combined.withColumn("salt", scatter).join(ids, ["track_id", "salt"], "left").drop("salt")
    nameless = combined.filter("track_id is null").agg(F.min(order).alias("null_first"))
    rows = rows.join(F.broadcast(nameless))  # one row
    by_id = F.coalesce("in_main", F.lit(False)) | (order > F.coalesce("first", "null_first"))
    rows = rows.withColumn("by_id", by_id).drop("first", "in_main", "null_first")
    name = F.concat(F.coalesce(F.concat(F.lit("="), "artist_name"), F.lit("")), F.lit("\0"), normalized_title(F.col("track_name")))
    rows = rows.withColumn("name_key", F.when(~F.col("by_id"), name))
    titles = rows.filter("name_key is not null").groupBy("name_key").agg(F.min(order).alias("first"))
    rows = rows.join(titles, "name_key", "left")
    reason = F.when(F.col("by_id"), "duplicate track_id").when(order > F.col("first"), "similar name")
    return rows.withColumn("reason", reason).drop("by_id", "name_key", "first")


def override_artists(store: DataFrame, artists: DataFrame) -> DataFrame:
    """The store without the artists that are to be replaced."""
    return store.join(artists.select("artist_name").distinct(), "artist_name", "left_anti")


def merge(added: DataFrame, new: DataFrame, main: DataFrame, mode: str = "default", ident: str = "added_id") -> DataFrame:
    """The store after a run of ingestion, with a ``reason`` for each row that falls out.

    ``default`` skips artists that either store has, ``update`` appends, ``override``
    first removes the new rows' artists from the added store, never from ``main``.
    """
    if mode not in ("default", "update", "override"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "default":
        new = without_known_artists(new, added, main)
    if mode == "override":
        added = override_artists(added, new)
    both = added.withColumn("source_ord", F.lit(0)).unionByName(new.withColumn("source_ord", F.lit(1)), allowMissingColumns=True)
    return removal_reasons(both, main, ident)


def dry_run(added: DataFrame, new: DataFrame, main: DataFrame, mode: str = "default", ident: str = "added_id", n: int = 10) -> tuple[DataFrame, DataFrame]:
    """What ``merge`` would do, without writing: the first ``n`` rows it would add, and how many rows fall out for which reason."""
    merged = merge(added, new, main, mode, ident)
    kept = merged.filter("source_ord = 1 and reason is null")
    out = merged.groupBy("source_ord", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))
    return preview(kept, n, ident), out


def update_genres(store: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """The store with ``genre`` replaced and ``old_genre``; of several updates of an artist the last (by ``order``) wins."""
    last = updates.filter("artist_name is not null").groupBy("artist_name").agg(F.max_by("genre", order).alias("new_genre"))
    sizes = store.groupBy("artist_name").agg(F.count("*").alias("size"))
    out = attach(store.withColumn("row_hash", F.xxhash64(*store.columns)), last.join(sizes, "artist_name"), "artist_name", "size", store.count(), "row_hash")
    out = out.withColumn("old_genre", F.col("genre")).withColumn("genre", F.coalesce("new_genre", "genre"))
    return out.drop("row_hash", "new_genre", "size")
