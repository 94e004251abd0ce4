"""Queries over sources, sinks and request rules: each writes what it reads back, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators import clean, directory, ingest, reports, seeds
from tonearm.plans import recommend as rec
from tonearm.plans.encode import encode
from tonearm.schema import RAW, RAW_COLUMNS, Request
from tonearm.session import durable, shared_dir
from tonearm.sources import files
from tonearm.sources.tables import table

HOST = "play.tunes.example"


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/formats-{uuid.uuid4().hex}"


def _encoded(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "data_encoded")


def _added(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "added_artists")


_SHOWN = ["artist_name", "track_name", "track_id", "popularity", "tempo"]


def csv_zip_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The added store as CSV in a zip archive, and back; empty texts come back as null."""
    path = f"{_folder(spark)}/added.csv.zip"
    files.write_csv_zip(clean.finite(_added(spark, folder), ["popularity", "tempo"]).select(*RAW_COLUMNS), path)
    return files.read_csv_zip(spark, path).select(*_SHOWN)


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The raw store as compressed CSV, and back."""
    path = f"{_folder(spark)}/csv"
    rows = clean.finite(table(spark, folder, "data_tracks"), ["popularity", "tempo"])
    files.write_csv(rows.select("track_id", "popularity", "tempo", "time_signature"), path)
    return files.read_csv(spark, path).select("track_id", "popularity", "tempo")


def parquet_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{_folder(spark)}/parquet"
    files.write_parquet(table(spark, folder, "data_tracks"), path)
    return files.parquet(path)(spark).select("row_id", "artist_name", "track_name", "fetched_at")


def optional_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Two stores, of which one is not there: it counts as an empty table of the raw schema."""
    there, absent = f"{folder}/added_artists.parquet", f"{folder}/no_such_store.parquet"
    sources = [files.optional(files.parquet(there), there), files.optional(files.parquet(absent), absent)]
    parts = [s(spark).select(*RAW_COLUMNS) for s in sources]
    counts = [p.agg(F.lit(i).alias("source"), F.count("*").alias("rows"), F.lit(len(p.columns)).alias("columns")) for i, p in enumerate(parts)]
    return counts[0].unionByName(counts[1])


def source_plugin(spark: SparkSession, folder: str) -> DataFrame:
    """Any function of a session is a source: here one that reads two stores as one."""

    def both(session: SparkSession) -> DataFrame:
        return table(session, folder, "data_tracks").select(*RAW_COLUMNS).unionByName(_added(session, folder).select(*RAW_COLUMNS))

    source: files.Source = both
    return source(spark).groupBy("genre").agg(F.count("*").alias("rows"))


def id_file(spark: SparkSession, folder: str) -> DataFrame:
    """Every added id as a line of its own, as a link, as a comment and with blanks around it, and a blank line, read back."""
    bare = F.regexp_replace("track_id", r"[/?#\s]", "_")
    forms = F.array(bare, F.concat(F.lit(f"https://{HOST}/track/"), bare, F.lit("?si=1")), F.concat(F.lit("# "), bare), F.concat(F.lit("  "), bare, F.lit(" ")), F.lit("  "))
    lines = _added(spark, folder).filter("track_id is not null").select(F.explode(forms).alias("value"))
    path = f"{_folder(spark)}/ids"
    lines.write.text(path)
    return files.read_ids(spark, path, HOST).groupBy("track_id").agg(F.count("*").alias("lines"))


def request_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each arrival batch in look-ups of at most 50: their number and size."""
    ids = _added(spark, folder).select("batch_no", "track_id").filter("track_id is not null").distinct()
    ranked = clean.ranked_repeats(ids, ["batch_no"], [F.col("track_id")])
    return ranked.groupBy("batch_no", files.in_batches(F.col("repeat")).alias("lookup")).agg(F.count("*").alias("ids"))


def pages_to_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks to fetch for each limit from 1 to the number of tracks of the added artist with most of them."""
    most = reports.group_counts(_added(spark, folder), "artist_name").agg(F.max("rows")).first()[0] or 0
    rows = [(n, files.pages_to_fetch(n)) for n in range(1, most + 1)]
    return spark.createDataFrame(rows, "tracks bigint, fetch bigint")


def landed_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Added rows landed as JSON pages of track records, a page for each batch, and read back."""
    rows = clean.finite(_added(spark, folder), ["popularity", "duration_ms"]).select(
        F.coalesce("batch_no", F.lit(-1)).alias("batch"), F.concat(F.lit("https://x/track/"), "track_id").alias("href"),
        F.col("track_name").alias("trackTitle"), "popularity", F.col("duration_ms").alias("durationMs"),
        F.array(F.struct(F.lit("0").alias("id"), F.col("artist_name").alias("name"))).alias("artists"),
    )
    path = f"{_folder(spark)}/tracks"
    files.write_landed(rows, path, files.TRACK_RECORD, "batch")
    back = files.read_landed(spark, path, files.TRACK_RECORD)
    return back.select("href", F.col("trackTitle").alias("title"), "popularity", F.col("artists")[0]["name"].alias("artist"))


def landed_features(spark: SparkSession, folder: str) -> DataFrame:
    """Feature records that land twice, the first and then the last row of each track: the later record wins."""
    link = F.concat(F.lit("https://x/features/"), "track_id").alias("href")
    rows = clean.finite(_added(spark, folder), list(ingest.AUDIO)).withColumn("track_id", ingest.last_segment(F.col("track_id")))
    rows = rows.filter("track_id is not null and track_id <> ''")
    home = _folder(spark)
    for place, order in enumerate((F.col("added_id"), F.desc("added_id"))):
        own = clean.keep_first(rows, ["track_id"], [order]).select(link, *ingest.AUDIO)
        files.write_landed(own, f"{home}/{place}", files.FEATURE_RECORD)
    features = files.read_landed(spark, f"{home}/*", files.FEATURE_RECORD)
    tracks = rows.select("artist_name", "genre", F.col("track_name").alias("trackTitle"), "popularity", F.col("duration_ms").alias("durationMs"), link)
    built = ingest.build_rows(tracks, features)
    return built.select("track_id", "energy", "tempo", "mode").distinct()


def landed_artists(spark: SparkSession, folder: str) -> DataFrame:
    """Artist records with the artist's genre and its last word, landed, read back and resolved by the synonyms."""
    first = reports.first_values(_added(spark, folder), "artist_name", "genre", "added_id").filter("first_genre is not null")
    names = F.array("first_genre", F.element_at(F.split("first_genre", " "), -1))
    path = f"{_folder(spark)}/artists"
    files.write_landed(first.select(F.col("artist_name").alias("name"), names.alias("genres")), path, files.ARTIST_RECORD)
    found = files.genres_of_artists(files.read_landed(spark, path, files.ARTIST_RECORD))
    terms = found.select(F.col("artist_name").alias("ident"), "genre", "style")
    return ingest.resolve_genres(terms, table(spark, folder, "genre_synonyms")).withColumnRenamed("ident", "artist_name")


def first_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """For each added artist the title of its first track, in order, that the raw store knows by its id."""
    tried = _added(spark, folder).select("artist_name", "added_id", "track_id").filter("artist_name is not null and track_id is not null")
    known = table(spark, folder, "data_tracks").filter("track_id is not null").groupBy("track_id").agg(F.min("track_name").alias("title"))
    return files.first_resolving(tried, known, "artist_name", "added_id", "track_id", "title")


def json_response(spark: SparkSession, folder: str) -> DataFrame:
    """Recommendations as JSON, one text a request, taken apart again."""
    requests = table(spark, folder, "recommend_requests").withColumns({"diversity": F.lit(1), "track_ids": F.lit(None).cast("array<string>")})
    serving = durable(rec.serving_table(_encoded(spark, folder), order="vec_id"))
    texts = rec.as_json(rec.recommend_all(serving, requests))
    kinds = "map<string,array<struct<track_rank:int,track_id:string,track_name:string,genre:string>>>"
    back = texts.select("request_id", F.explode(F.from_json("recommendations", kinds)).alias("artist_name", "tracks"))
    return back.select("request_id", "artist_name", F.explode("tracks").alias("t")).select("request_id", "artist_name", "t.track_rank", "t.track_id")


def required_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the serving table can do without each column of the encoded store."""
    encoded = _encoded(spark, folder)
    rows = []
    for c in ("artist_name", "track_name", "track_id", "popularity", "genre", "tempo"):
        try:
            rec.serving_table(encoded.drop(c), order="vec_id")
            rows.append((c, False))
        except ValueError:
            rows.append((c, True))
    return spark.createDataFrame(rows, "column string, required boolean")


def artist_equality(spark: SparkSession, folder: str) -> DataFrame:
    """The titles of the artist at the head of the directory, by its exact name."""
    tracks = table(spark, folder, "data_tracks")
    top = directory.search(directory.artist_directory(tracks), "", 1).first()["artist_name"]
    return directory.artist_tracks(tracks, top).select("track_id", "track_name")


def rows_without_id(spark: SparkSession, folder: str) -> DataFrame:
    """Landed tracks as they are, those without an id included: they are dropped, and nothing else is."""
    link = F.concat(F.lit("https://x/track/"), "track_id").alias("href")
    rows = clean.finite(_added(spark, folder), ["popularity"])
    tracks = rows.select("artist_name", "genre", F.col("track_name").alias("trackTitle"), "popularity", F.col("duration_ms").alias("durationMs"), link)
    features = spark.createDataFrame([], files.FEATURE_RECORD + ", ord int")
    built = ingest.build_rows(tracks, features)
    return built.groupBy("artist_name").agg(F.count("*").alias("rows"), F.count("tempo").alias("with_features"))


def selected_songs(spark: SparkSession, folder: str) -> DataFrame:
    """Every (artist, title) of the encoded store as a selection, with the first id of that title."""
    encoded = _encoded(spark, folder)
    return directory.selected_tracks(encoded.select("vec_id", "artist_name", "track_name"), encoded).select("vec_id", "track_id")


def ingest_preview(spark: SparkSession, folder: str) -> DataFrame:
    """A dry run of merging the added store into nothing: its first ten rows."""
    added = _added(spark, folder)
    return ingest.dry_run(added.filter(F.lit(False)), added, table(spark, folder, "data_tracks"), "update")[0].select("added_id", "track_id")


def ingest_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """The same dry run: how many rows stay, and how many fall out for which reason."""
    added = _added(spark, folder)
    return ingest.dry_run(added.filter(F.lit(False)), added, table(spark, folder, "data_tracks"), "update")[1]


def request_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The limits of the client each request exceeds."""
    return seeds.client_problems(table(spark, folder, "recommend_requests"), _encoded(spark, folder))


def request_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """A request for each of the ten most popular artists that names nothing but the artist."""
    names = [r[0] for r in directory.search(directory.artist_directory(_encoded(spark, folder)), "", 10).select("artist_name").collect()]  # a top-k report
    frames = [rec.request_frame(spark, Request((n,))) for n in names]
    out = frames[0] if frames else rec.request_frame(spark, Request(("",))).limit(0)
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select(F.col("artists")[0].alias("artist_name"), F.size("track_ids").alias("songs"), "diversity", "max_artists", "genre_weight")


def sorted_genres(spark: SparkSession, folder: str) -> DataFrame:
    return reports.sorted_values(table(spark, folder, "genre_synonyms"), "genre")


def filled_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Values present in each column of numbers and of text of the raw store, the columns taken by their types."""
    tracks = table(spark, folder, "data_tracks")
    kinds = {k: clean.columns_of_kind(tracks, k) for k in ("number", "string")}
    counts = tracks.agg(*[F.count(c).alias(c) for own in kinds.values() for c in own])
    entry = [F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), F.col(c).alias("present")) for k, own in kinds.items() for c in own]
    return counts.select(F.explode(F.array(*entry)).alias("e")).select("e.*")


def encode_all(spark: SparkSession, folder: str) -> DataFrame:
    """The encoding with remixes kept, artists of one track kept and twenty tracks an artist."""
    out = encode(
        table(spark, folder, "data_tracks"), table(spark, folder, "genre_membership"), min_songs=1, max_songs=20, keep_remixes=True
    )
    return out.groupBy("artist_name").agg(F.count("*").alias("tracks"), (F.round(F.sum(F.col("popularity").cast("double")), 3) + 0.0).alias("popularity"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_zip_round_trip, csv_round_trip, parquet_round_trip, optional_sources, source_plugin, id_file, request_batches,
        pages_to_fetch, landed_tracks, landed_features, landed_artists, first_candidate, json_response, required_columns,
        artist_equality, rows_without_id, selected_songs, ingest_preview, ingest_outcome, request_limits, request_defaults,
        sorted_genres, filled_by_kind, encode_all,
    )
}


def oracle(top: str, merged_reasons: str, resolve: str, popularity_unit: str) -> dict[str, str]:
    """DuckDB SQL of these queries; the parts shared with other queries come from ``plans.oracle``."""
    number = "CASE WHEN isfinite({0}) THEN {0} END AS {0}".format
    filled = " UNION ALL ".join(
        f"SELECT '{'string' if f.dataType.simpleString() == 'string' else 'number'}' AS kind, '{f.name}' AS \"column\", count({f.name}) AS present FROM data_tracks"
        for f in RAW
    )
    return {
        "csv_zip_round_trip": f"""SELECT nullif(artist_name, '') AS artist_name, nullif(track_name, '') AS track_name,
          nullif(track_id, '') AS track_id, {number('popularity')}, {number('tempo')} FROM added_artists""",
        "csv_round_trip": f"SELECT nullif(track_id, '') AS track_id, {number('popularity')}, {number('tempo')} FROM data_tracks",
        "parquet_round_trip": "SELECT row_id, artist_name, track_name, fetched_at FROM data_tracks",
        "optional_sources": "SELECT 0 AS source, count(*) AS rows, 19 AS columns FROM added_artists UNION ALL SELECT 1, 0, 19",
        "source_plugin": """SELECT genre, count(*) AS rows
          FROM (SELECT genre FROM data_tracks UNION ALL SELECT genre FROM added_artists) GROUP BY genre""",
        "id_file": r"""WITH b AS (SELECT regexp_replace(track_id, '[/?#\s]', '_', 'g') AS id FROM added_artists WHERE track_id IS NOT NULL)
          SELECT id AS track_id, 3 * count(*) AS lines FROM b GROUP BY id""",
        "request_batches": """SELECT batch_no, (place - 1) // 50 AS lookup, count(*) AS ids FROM (
            SELECT batch_no, row_number() OVER (PARTITION BY batch_no ORDER BY track_id) AS place
            FROM (SELECT DISTINCT batch_no, track_id FROM added_artists WHERE track_id IS NOT NULL)) GROUP BY 1, 2""",
        "pages_to_fetch": """SELECT n AS tracks, (n * 3 + 49) // 50 * 50 AS fetch FROM range(1, 1 + (
            SELECT max(k) FROM (SELECT count(*) AS k FROM added_artists WHERE artist_name IS NOT NULL GROUP BY artist_name))) AS t(n)""",
        "landed_tracks": f"""SELECT 'https://x/track/' || track_id AS href, track_name AS title, {number('popularity')},
          artist_name AS artist FROM added_artists""",
        "landed_features": f"""SELECT DISTINCT string_split(track_id, '/')[-1] AS track_id, energy, tempo, mode FROM (
            SELECT track_id, {number('energy')}, {number('tempo')}, {number('mode')} FROM added_artists
            WHERE track_id IS NOT NULL AND string_split(track_id, '/')[-1] <> ''
            QUALIFY row_number() OVER (PARTITION BY string_split(track_id, '/')[-1] ORDER BY added_id DESC) = 1)""",
        "landed_artists": resolve,
        "first_candidate": """WITH known AS (SELECT track_id, min(track_name) AS title FROM data_tracks WHERE track_id IS NOT NULL GROUP BY 1)
          SELECT artist_name, title FROM added_artists JOIN known USING (track_id)
          WHERE artist_name IS NOT NULL AND title IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY artist_name ORDER BY added_id) = 1""",
        "json_response": f"SELECT request_id, artist_name, track_rank, track_id FROM ({top})",
        "required_columns": """SELECT * FROM (VALUES ('artist_name', true), ('track_name', true), ('track_id', true),
          ('popularity', true), ('genre', false), ('tempo', false)) AS t("column", required)""",
        "artist_equality": """WITH top AS (SELECT artist_name FROM data_tracks WHERE artist_name IS NOT NULL GROUP BY 1
            ORDER BY round(coalesce(sum(popularity) FILTER (WHERE NOT isnan(popularity)), 0), 6) DESC, artist_name LIMIT 1)
          SELECT min(track_id) AS track_id, track_name
          FROM data_tracks JOIN top USING (artist_name) GROUP BY track_name""",
        "rows_without_id": """SELECT artist_name, count(*) AS rows, 0 AS with_features FROM added_artists
          WHERE track_id IS NOT NULL AND string_split(track_id, '/')[-1] <> '' GROUP BY artist_name""",
        "selected_songs": """SELECT e.vec_id, s.track_id FROM data_encoded e LEFT JOIN (
            SELECT artist_name, track_name, min(track_id) AS track_id FROM data_encoded WHERE artist_name IS NOT NULL GROUP BY 1, 2) s
          USING (artist_name, track_name)""",
        "ingest_preview": f"SELECT added_id, track_id FROM ({merged_reasons}) WHERE reason IS NULL ORDER BY added_id LIMIT 10",
        "ingest_outcome": f"""SELECT 1 AS source_ord, coalesce(reason, 'kept') AS reason, count(*) AS rows
          FROM ({merged_reasons}) GROUP BY ALL""",
        "request_limits": """WITH songs AS (SELECT request_id, artist_name, count(DISTINCT track_id) AS n FROM (
              SELECT request_id, unnest(track_ids) AS track_id FROM recommend_requests)
            JOIN (SELECT track_id, min(artist_name) AS artist_name FROM data_encoded WHERE artist_name IS NOT NULL GROUP BY 1) USING (track_id)
            WHERE track_id IS NOT NULL GROUP BY 1, 2)
          SELECT request_id, 'artists' AS problem FROM recommend_requests
            WHERE (SELECT count(*) FROM (SELECT DISTINCT unnest(artists))) > 5
          UNION ALL SELECT request_id, 'variety' FROM recommend_requests WHERE NOT coalesce(diversity BETWEEN 1 AND 3, false)
          UNION ALL SELECT request_id, 'genre weight' FROM recommend_requests
            WHERE NOT coalesce(genre_weight BETWEEN 0 AND 5 AND genre_weight * 2 = round(genre_weight * 2), false)
          UNION ALL SELECT request_id, 'results' FROM recommend_requests WHERE NOT coalesce(max_artists BETWEEN 3 AND 12, false)
          UNION ALL SELECT DISTINCT request_id, 'songs' FROM songs WHERE n > 3""",
        "request_defaults": """SELECT artist_name, 0 AS songs, 2 AS diversity, 6 AS max_artists, 2.0::DOUBLE AS genre_weight FROM (
            SELECT artist_name, coalesce(sum(popularity::DOUBLE) FILTER (WHERE NOT isnan(popularity)), 0) AS s
            FROM data_encoded WHERE artist_name IS NOT NULL GROUP BY 1 ORDER BY round(s, 6) DESC, artist_name LIMIT 10)""",
        "sorted_genres": """SELECT genre, row_number() OVER (ORDER BY genre)::INTEGER AS rank
          FROM (SELECT DISTINCT genre FROM genre_synonyms WHERE genre IS NOT NULL)""",
        "filled_by_kind": f"{filled} UNION ALL SELECT 'number', 'row_id', count(row_id) FROM data_tracks",
        "encode_all": f"""WITH scaled AS (SELECT row_id, artist_name, {popularity_unit} AS popularity FROM data_tracks)
          SELECT artist_name, count(*) AS tracks, round(sum(popularity::FLOAT::DOUBLE), 3) + 0.0 AS popularity FROM (
            SELECT * FROM scaled WHERE artist_name IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY artist_name ORDER BY round(popularity, 9) DESC, row_id) <= 20) GROUP BY 1""",
    }
