"""DuckDB SQL for every query of the recommender, written independently of the plans."""

from __future__ import annotations

from tonearm.plans import formats
from tonearm.plans.tracks import ORACLE as FILLING

ORACLE: dict[str, str] = dict(FILLING)

#: Weighted features and their squared weights; the genre columns of the test table.
WEIGHTS = {
    "popularity": 0.6, "year": 0.6, "duration_ms": 0.4, "acousticness": 1.2, "danceability": 1.2, "energy": 1.2,
    "valence": 1.2, "instrumentalness": 1.2, "speechiness": 1.0, "loudness": 1.0, "tempo": 1.0, "liveness": 1.0,
}
AUDIO = list(WEIGHTS)
GENRE = [f"genre_{f}" for f in ("pulse", "plucked", "brasswork", "chant", "drone", "hearth", "grit", "floor", "hymnal", "haze", "chopped", "bowed")]
FEATURES = AUDIO + GENRE


def commas(parts) -> str:
    return ", ".join(parts)


_FINITE = " AND ".join(f"isfinite({c})" for c in AUDIO)
SERVING = f"""serving AS (
  SELECT artist_name, track_name, track_id, genre, {commas(f'{c}::DOUBLE AS {c}' for c in AUDIO)},
         {commas(f'coalesce({c}::DOUBLE, 0) AS {c}' for c in GENRE)}
  FROM data_encoded WHERE artist_name IS NOT NULL AND track_id IS NOT NULL AND {_FINITE}
  QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY vec_id) = 1
)"""
TAKEN = """least(n, CASE WHEN n <= 5 THEN 5 WHEN n <= 20 THEN 5 + ((n - 5) * 7) // 15
  WHEN n <= 50 THEN 12 + ((n - 20) * 13) // 30 WHEN n <= 80 THEN 25 + ((n - 50) * 5) // 30 ELSE 30 END)::INTEGER"""
SAMPLES = f"""sized AS (
  SELECT *, count(*) OVER (PARTITION BY artist_name) AS n,
         row_number() OVER (PARTITION BY artist_name ORDER BY popularity DESC NULLS LAST, track_id) AS place FROM serving
), samples AS (SELECT * FROM sized WHERE place <= {TAKEN})"""
MEANS = f"means AS (SELECT artist_name, {commas(f'avg({c}) AS {c}' for c in FEATURES)} FROM samples GROUP BY artist_name)"


def _requests(diversity: str = "diversity", track_ids: str = "track_ids") -> str:
    return f"""asks AS (SELECT request_id, artists, {track_ids} AS track_ids, {diversity} AS diversity, max_artists, genre_weight
      FROM recommend_requests),
    seeds AS (SELECT request_id, artist_name FROM (SELECT request_id, unnest(artists) AS artist_name FROM asks)
      WHERE artist_name IN (SELECT artist_name FROM serving))"""


_ENTITIES = f"""entities AS (
  SELECT request_id, {commas(f'm.{c}' for c in FEATURES)} FROM seeds JOIN means m USING (artist_name)
  UNION ALL
  SELECT request_id, {commas(f's.{c}' for c in FEATURES)}
  FROM (SELECT request_id, unnest(track_ids) AS track_id FROM asks %s) JOIN serving s USING (track_id)
), points AS (
  SELECT request_id, count(*) AS entities, {commas(f'avg({c}) AS {c}' for c in FEATURES)} FROM entities GROUP BY request_id
)"""
_KNOWN = "WHERE request_id IN (SELECT request_id FROM seeds)"


def _d_audio(x: str, q: str) -> str:
    return "sqrt(" + " + ".join(f"({x}.{c} - {q}.{c}) ^ 2 * {w * w!r}" for c, w in WEIGHTS.items()) + ")"


def _d_genre(x: str, q: str) -> str:
    dot = " + ".join(f"{x}.{c} * {q}.{c}" for c in GENRE)
    norms = f"sqrt({' + '.join(f'{x}.{c} ^ 2' for c in GENRE)}) * sqrt({' + '.join(f'{q}.{c} ^ 2' for c in GENRE)})"
    return f"(1 - coalesce(({dot}) / nullif({norms}, 0), 0))"


def _recommend(**changes: str) -> str:
    return f"""WITH {SERVING}, {SAMPLES}, {MEANS}, {_requests(**changes)}, {_ENTITIES % _KNOWN},
    distances AS (
      SELECT p.request_id, s.track_id, s.artist_name, s.track_name, s.genre, a.diversity, a.max_artists,
             round(sqrt({_d_audio('s', 'p')} ^ 2 + ({_d_genre('s', 'p')} * a.genre_weight) ^ 2), 9) AS d
      FROM points p JOIN asks a USING (request_id) CROSS JOIN serving s
    ), near AS (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY d, track_id) AS place FROM distances
      QUALIFY place <= 200 * diversity
    ), scored AS (
      SELECT *, count(*) OVER (PARTITION BY request_id) + 1 - CASE WHEN diversity > 1
        THEN row_number() OVER (PARTITION BY request_id ORDER BY md5(concat_ws('|', '0', request_id, track_id)), track_id)
        ELSE place END AS score FROM near
    ), pool AS (
      SELECT * FROM scored WHERE (request_id, artist_name) NOT IN (SELECT (request_id, artist_name) FROM seeds)
    ), artists AS (
      SELECT request_id, artist_name, max_artists,
             row_number() OVER (PARTITION BY request_id ORDER BY sum(score) DESC, artist_name)::INTEGER AS artist_rank
      FROM pool GROUP BY request_id, artist_name, max_artists HAVING count(track_id) >= 2
    )
    SELECT request_id, artist_rank, artist_name,
           row_number() OVER (PARTITION BY request_id, artist_name ORDER BY score DESC)::INTEGER AS track_rank,
           track_id, track_name, genre
    FROM pool JOIN artists USING (request_id, artist_name, max_artists) WHERE artist_rank <= max_artists
    QUALIFY track_rank <= 4"""


ORACLE["recommend_top"] = _recommend(diversity="1", track_ids="NULL::VARCHAR[]")
ORACLE["recommend_with_tracks"] = _recommend(diversity="1")
ORACLE["recommend_shuffled"] = _recommend()
ORACLE["representative_vector"] = f"""WITH {SERVING}, {SAMPLES}, {MEANS}, {_requests()}, {_ENTITIES % ''}
  SELECT request_id, entities, {commas(f'round({c}, 6) + 0.0 AS {c}' for c in FEATURES)} FROM points"""
ORACLE["sampling_curve"] = f"""SELECT artist_name, n AS rows, {TAKEN} AS taken
  FROM (SELECT artist_name, count(*) AS n FROM data_tracks WHERE artist_name IS NOT NULL GROUP BY 1)"""
ORACLE["artist_samples"] = f"WITH {SERVING}, {SAMPLES} SELECT artist_name, track_id FROM samples"

_DIRECTORY = """directory AS (SELECT artist_name, coalesce(sum(popularity::DOUBLE) FILTER (WHERE NOT isnan(popularity)), 0) AS popularity_sum
  FROM {} WHERE artist_name IS NOT NULL GROUP BY artist_name)"""
_TOP_POINT = f"""{SERVING}, {SAMPLES}, {MEANS}, {_DIRECTORY.format('serving')},
  point AS (SELECT m.* FROM means m JOIN (SELECT artist_name FROM directory ORDER BY round(popularity_sum, 6) DESC, artist_name LIMIT 1)
    USING (artist_name))"""
ORACLE["weighted_euclidean"] = f"""WITH {_TOP_POINT} SELECT s.track_id, round({_d_audio('s', 'q')}, 6) + 0.0 AS d_audio
  FROM serving s CROSS JOIN point q"""
ORACLE["cosine_distance"] = f"""WITH {_TOP_POINT} SELECT s.track_id, round({_d_genre('s', 'q')}, 6) + 0.0 AS d_genre
  FROM serving s CROSS JOIN point q"""
ORACLE["hybrid_topn"] = f"""WITH {_TOP_POINT} SELECT track_id, artist_name, round(d, 6) + 0.0 AS d FROM (
    SELECT s.track_id, s.artist_name, round(sqrt({_d_audio('s', 'q')} ^ 2 + ({_d_genre('s', 'q')} * 2.0) ^ 2), 9) AS d
    FROM serving s CROSS JOIN point q) ORDER BY d, track_id LIMIT 400"""
_STEP = "pow(2.0, greatest(floor(log2(abs({0}))), -14) - 10)"
_HALF = f"""CASE WHEN NOT isfinite({{0}}) THEN NULL WHEN {{0}} = 0 THEN 0.0 WHEN abs({{0}}) >= 65520 THEN sign({{0}}) * 'inf'::DOUBLE
  ELSE sign({{0}}) * round_even(abs({{0}}) / {_STEP}, 0) * {_STEP} END AS {{0}}"""
ORACLE["quantized_features"] = f"SELECT row_id, {_HALF.format('danceability')}, {_HALF.format('tempo')} FROM data_tracks"

# ---- directory ------------------------------------------------------------------------------------------------------

ORACLE["artist_directory"] = f"""WITH {_DIRECTORY.format('data_encoded')}
  SELECT artist_name, round(popularity_sum, 4) + 0.0 AS popularity_sum FROM directory"""
_RANK = "row_number() OVER (ORDER BY round(popularity_sum, 6) DESC, artist_name)::INTEGER AS rank"
ORACLE["artist_search"] = f"""WITH {SERVING}, {_DIRECTORY.format('serving')}
  SELECT {_RANK}, artist_name FROM directory WHERE contains(lower(artist_name), 'te') QUALIFY rank <= 100"""
ORACLE["artist_typeahead"] = f"""WITH {SERVING}, {_DIRECTORY.format('serving')},
  hits AS (SELECT *, {_RANK} FROM directory WHERE contains(lower(artist_name), 'a')),
  rest AS (SELECT * EXCLUDE rank FROM hits WHERE rank > 3)
  SELECT {_RANK}, artist_name FROM rest QUALIFY rank <= 15"""
ORACLE["artist_tracks_unique"] = """SELECT artist_name, track_name, min(track_id) AS track_id
  FROM data_tracks WHERE artist_name IS NOT NULL GROUP BY artist_name, track_name"""
ORACLE["validate_inputs"] = """SELECT request_id, (pos - 1)::INTEGER AS pos, artist_name FROM (
    SELECT request_id, unnest(artists) AS artist_name, generate_subscripts(artists, 1) AS pos FROM recommend_requests)
  WHERE artist_name IN (SELECT artist_name FROM data_encoded WHERE artist_name IS NOT NULL)"""
ORACLE["health"] = "SELECT 'ok' AS status, count(*) AS tracks_loaded FROM data_encoded"

# ---- encoding -------------------------------------------------------------------------------------------------------

_RAW = (
    "artist_name, track_name, track_id, popularity, year, genre, danceability, energy, key, loudness, mode, speechiness, "
    "acousticness, instrumentalness, liveness, valence, tempo, duration_ms, time_signature"
)
_MERGED = f"""merged AS (
  SELECT 0 AS source_ord, row_id AS row_ord, NULL::INTEGER AS batch_no, fetched_at, {_RAW} FROM data_tracks
  UNION ALL SELECT 1, added_id, batch_no, NULL, {_RAW} FROM added_artists)"""
_FIRST = "firsts AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY source_ord, row_ord) = 1)"
ORACLE["union_by_name"] = f"WITH {_MERGED} SELECT source_ord, row_ord, track_id, coalesce(batch_no, -1) AS batch_no, fetched_at IS NULL AS no_time FROM merged"
ORACLE["dedupe_keep_first"] = f"WITH {_MERGED}, {_FIRST} SELECT source_ord, row_ord, track_id FROM firsts"
_REMIX = "coalesce(contains(lower(track_name), ' remix'), false)"
ORACLE["remix_filter"] = f"SELECT row_id FROM data_tracks WHERE NOT {_REMIX}"


def _finite(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


ORACLE["impute_constant"] = f"""SELECT row_id, coalesce({_finite('year')}, 2020) AS year, coalesce({_finite('popularity')}, 25) AS popularity
  FROM data_tracks"""
_MEAN = ["danceability", "energy", "loudness", "tempo"]
ORACLE["impute_mean"] = f"""SELECT row_id, {commas(f'round(coalesce({_finite(c)}, avg({_finite(c)}) OVER ()), 5) + 0.0 AS {c}' for c in _MEAN)}
  FROM data_tracks"""


def _unit(c: str, x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce(({x} - min({x}) OVER ()) / nullif(max({x}) OVER () - min({x}) OVER (), 0), 0) END"


_SCALE = ["danceability", "loudness", "tempo", "duration_ms"]
ORACLE["minmax_scale"] = f"""SELECT row_id, {commas(f'round({_unit(c, c)}, 6) + 0.0 AS {c}' for c in _SCALE)}
  FROM (SELECT row_id, {commas(f'{_finite(c)} AS {c}' for c in _SCALE)} FROM data_tracks)"""
ORACLE["min_group_filter"] = """SELECT row_id FROM data_tracks WHERE artist_name IN
  (SELECT artist_name FROM data_tracks WHERE artist_name IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)"""
ORACLE["topn_per_group"] = f"""SELECT row_id FROM data_tracks WHERE artist_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY artist_name ORDER BY {_finite('popularity')} DESC NULLS LAST, row_id) <= 50"""
_VECTORS = """own AS (SELECT genre, family, max(weight) AS weight FROM genre_membership
    WHERE genre IS NOT NULL AND family IS NOT NULL AND weight IS NOT NULL GROUP BY 1, 2),
  passed AS (SELECT a.genre, c.family, a.weight * b.weight * c.weight * 0.5 AS weight
    FROM own a JOIN own b ON a.family = b.family AND a.genre <> b.genre JOIN own c ON b.genre = c.genre),
  raw AS (SELECT genre, family, max(weight) AS weight FROM (SELECT * FROM own UNION ALL SELECT * FROM passed) GROUP BY 1, 2 HAVING max(weight) > 0),
  vectors AS (SELECT genre, family, weight / sqrt(sum(weight * weight) OVER (PARTITION BY genre)) AS value FROM raw)"""
ORACLE["genre_embedding"] = f"WITH {_VECTORS} SELECT genre, family, round(value, 9) + 0.0 AS value FROM vectors"
_WIDE = f"""wide AS (SELECT genre, {commas(f"max(value) FILTER (WHERE family = '{g[6:]}') AS {g}" for g in GENRE)} FROM vectors GROUP BY genre)"""
ORACLE["genre_left_join"] = f"""WITH {_VECTORS}, {_WIDE}
  SELECT row_id, t.genre, {commas(f'round(coalesce({g}, 0), 6) + 0.0 AS {g}' for g in GENRE)} FROM data_tracks t LEFT JOIN wide USING (genre)"""
ORACLE["family_inversion"] = """SELECT family, count(*) AS genres, round(sum(weight), 6) + 0.0 AS total_weight
  FROM genre_membership WHERE family IS NOT NULL GROUP BY family"""
_ENCODED = ["popularity", "year", "duration_ms", "acousticness", "danceability", "energy", "instrumentalness", "liveness",
            "loudness", "speechiness", "tempo", "valence"]
_DEFAULT = {"year": "2020", "popularity": "25"}


def _known(c: str) -> str:
    return f"coalesce({_finite(c)}, {_DEFAULT[c]})" if c in _DEFAULT else f"coalesce({_finite(c)}, avg({_finite(c)}) OVER ())"


def _encode(source: str) -> str:
    return f"""kept AS (SELECT * FROM {source} WHERE NOT {_REMIX}),
    known AS (SELECT source_ord, row_ord, artist_name, track_name, track_id, genre, {commas(f'{_known(c)} AS {c}' for c in _ENCODED)} FROM kept),
    scaled AS (SELECT source_ord, row_ord, artist_name, track_name, track_id, genre,
      {commas(f'{_unit(c, c)} AS {c}' for c in _ENCODED)} FROM known),
    sized AS (SELECT *, count(*) OVER (PARTITION BY artist_name) AS n FROM scaled WHERE artist_name IS NOT NULL),
    best AS (SELECT * FROM sized WHERE n >= 2
      QUALIFY row_number() OVER (PARTITION BY artist_name ORDER BY round(popularity, 9) DESC, source_ord, row_ord) <= 50)"""


ORACLE["encode_tracks"] = f"""WITH {_MERGED}, {_FIRST}, {_encode('firsts')}, {_VECTORS}, {_WIDE}
  SELECT artist_name, track_name, track_id, b.genre, {commas(f'round({c}::FLOAT::DOUBLE, 4) + 0.0 AS {c}' for c in _ENCODED)},
         {commas(f'round(coalesce({g}, 0)::FLOAT::DOUBLE, 4) + 0.0 AS {g}' for g in GENRE)}
  FROM best b LEFT JOIN wide USING (genre)"""
ORACLE["encode_summary"] = f"""WITH plain AS (SELECT 0 AS source_ord, row_id AS row_ord, * FROM data_tracks), {_encode('plain')}
  SELECT (SELECT count(*) FROM data_tracks) AS rows_read, count(*) AS rows_kept, count(DISTINCT artist_name) AS artists FROM best"""

# ---- ingestion ------------------------------------------------------------------------------------------------------

_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _title(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({_strip(f'lower({x})')}, '\\([^)]*\\)', '', 'g'), '\\[[^\\]]*\\]', '', 'g')"
    return f"coalesce({_strip(f"regexp_replace({bare}, '{_SPACE}+', ' ', 'g')")}, '')"


ORACLE["normalize_title"] = f"SELECT row_id, {_title('track_name')} AS title FROM data_tracks"
ORACLE["extract_id"] = """SELECT added_id, CASE WHEN contains(track_id, 'play.tunes.example')
  THEN split_part(list_extract(string_split(track_id, '/'), -1), '?', 1) ELSE track_id END AS track_id FROM added_artists"""
ORACLE["title_ellipsis"] = """SELECT row_id, CASE WHEN length(track_name) > 26 THEN concat(substring(track_name, 1, 26), '…')
  ELSE track_name END AS label FROM data_tracks"""
ORACLE["genre_resolve"] = f"""WITH terms AS (
    SELECT row_id AS ident, 0 AS pos, {_strip("lower(coalesce(genre, ''))")} AS term FROM data_tracks
    UNION ALL SELECT row_id, 1, {_strip("lower(list_extract(string_split(coalesce(genre, ''), ' '), -1))")} FROM data_tracks
  ), hits AS (
    SELECT t.ident, CASE WHEN t.term = s.key THEN 0 ELSE 1 END AS phase, t.pos, s.ord, s.genre
    FROM terms t JOIN genre_synonyms s ON t.term <> '' AND (contains(t.term, s.key) OR contains(s.key, t.term))
  )
  SELECT r.row_id AS ident, b.genre AS resolved FROM data_tracks r
  LEFT JOIN (SELECT ident, genre FROM hits QUALIFY row_number() OVER (PARTITION BY ident ORDER BY phase, pos, ord) = 1) b ON r.row_id = b.ident"""
ORACLE["genre_unique_match"] = """WITH valid AS (SELECT DISTINCT genre AS valid FROM genre_synonyms),
  hits AS (SELECT ord, key, count(valid) AS hits, coalesce(bool_or(valid = key), false) AS own, min(valid) AS sole
    FROM genre_synonyms LEFT JOIN valid ON contains(valid, key) GROUP BY ord, key)
  SELECT ord, key, CASE WHEN own THEN 1 ELSE hits END AS hits, CASE WHEN own THEN key WHEN hits = 1 THEN sole END AS genre FROM hits"""
_LAST = "list_extract(string_split(concat('https://x/track/', trim(track_id, ' ')), '/'), -1)"
ORACLE["build_rows"] = f"""WITH landed AS (SELECT *, {_LAST} AS id FROM added_artists WHERE track_id IS NOT NULL),
  ids AS (SELECT * REPLACE ({_finite('popularity')} AS popularity) FROM landed WHERE id <> ''),
  best AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY artist_name ORDER BY coalesce(popularity, 0) DESC, id) <= 15),
  feats AS (SELECT id, energy, tempo FROM landed QUALIFY row_number() OVER (PARTITION BY id ORDER BY added_id DESC) = 1)
  SELECT b.artist_name, b.track_name, b.id AS track_id, coalesce(nullif(b.genre, ''), 'unknown') AS genre, b.popularity,
         f.energy, f.tempo, NULL::DOUBLE AS year
  FROM best b LEFT JOIN feats f ON b.id = f.id"""
ORACLE["anti_join_main"] = """SELECT added_id FROM added_artists a
  WHERE NOT EXISTS (SELECT 1 FROM data_tracks t WHERE t.track_id = a.track_id)"""
ORACLE["skip_known_artists"] = """SELECT added_id FROM added_artists a
  WHERE NOT EXISTS (SELECT 1 FROM data_tracks t WHERE t.artist_name = a.artist_name)"""


def _reasons(combined: str) -> str:
    return f"""marked AS (
      SELECT *, {_title('track_name')} AS title,
        coalesce(track_id IN (SELECT track_id FROM data_tracks WHERE track_id IS NOT NULL), false)
        OR row_number() OVER (PARTITION BY track_id ORDER BY source_ord, added_id) > 1 AS by_id FROM {combined}
    ), reasons AS (
      SELECT added_id, source_ord, CASE WHEN by_id THEN 'duplicate track_id'
        WHEN row_number() OVER (PARTITION BY artist_name, title, by_id ORDER BY source_ord, added_id) > 1 THEN 'similar name' END AS reason
      FROM marked)"""


ORACLE["dedupe_report"] = f"""WITH combined AS (SELECT *, 0 AS source_ord FROM added_artists), {_reasons('combined')}
  SELECT added_id, reason FROM reasons WHERE reason IS NOT NULL"""


def _merge(store: str, new: str) -> str:
    return f"""WITH store AS (SELECT * FROM added_artists WHERE coalesce(batch_no, -1) < 10), new AS (SELECT * FROM added_artists WHERE batch_no >= 10),
    combined AS (SELECT *, 0 AS source_ord FROM store s WHERE {store} UNION ALL SELECT *, 1 FROM new n WHERE {new}),
    {_reasons('combined')} SELECT added_id, source_ord, reason FROM reasons"""


_ABSENT = "NOT EXISTS (SELECT 1 FROM {} o WHERE o.artist_name = {}.artist_name)"
ORACLE["merge_default"] = _merge("true", f"{_ABSENT.format('store', 'n')} AND {_ABSENT.format('data_tracks', 'n')}")
ORACLE["merge_update"] = _merge("true", "true")
ORACLE["override_merge"] = _merge(_ABSENT.format("new", "s"), "true")
ORACLE["genre_update"] = """WITH changes AS (
    SELECT artist_name, genre FROM added_artists WHERE batch_no >= 10 AND artist_name IS NOT NULL AND genre IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY artist_name ORDER BY added_id DESC) = 1)
  SELECT s.added_id, coalesce(c.genre, s.genre) AS genre, s.genre AS old_genre
  FROM added_artists s LEFT JOIN changes c ON s.artist_name = c.artist_name WHERE coalesce(s.batch_no, -1) < 10"""
ORACLE["row_pick"] = """SELECT added_id, batch_no FROM added_artists
  QUALIFY row_number() OVER (PARTITION BY batch_no ORDER BY added_id) IN (1, 2, 3, 7)"""
ORACLE["raw_projection"] = "SELECT added_id, artist_name, track_id, year, mode FROM added_artists"

# ---- reports --------------------------------------------------------------------------------------------------------

ORACLE["group_counts"] = "SELECT artist_name, count(*) AS rows FROM data_tracks WHERE artist_name IS NOT NULL GROUP BY 1"
ORACLE["groups_by_threshold"] = f"""SELECT count(*) FILTER (WHERE rows >= 2) AS enough, count(*) FILTER (WHERE rows < 2) AS too_few
  FROM ({ORACLE['group_counts']})"""
ORACLE["distinct_counts"] = """SELECT count(*) AS rows, count(DISTINCT artist_name) AS distinct_artist_name,
  count(DISTINCT track_id) AS distinct_track_id, count(DISTINCT genre) AS distinct_genre FROM data_tracks"""
ORACLE["distinct_genres"] = "SELECT DISTINCT genre FROM data_tracks WHERE genre IS NOT NULL"
ORACLE["predicate_count"] = f"SELECT count(*) FILTER (WHERE {_REMIX}) AS matching, count(*) AS rows FROM data_tracks"
ORACLE["first_value_report"] = """SELECT artist_name, count(*) AS rows, arg_min_null(genre, added_id) AS first_genre
  FROM added_artists WHERE artist_name IS NOT NULL GROUP BY artist_name"""

# ---- sources, sinks and request rules -------------------------------------------------------------------------------

_NEW = f"""WITH combined AS (SELECT *, 1 AS source_ord FROM added_artists), {_reasons('combined')}
  SELECT added_id, track_id, reason FROM reasons JOIN (SELECT added_id, track_id FROM added_artists) USING (added_id)"""
_ARTIST_GENRES = f"""WITH firsts AS (SELECT artist_name, genre FROM added_artists WHERE artist_name IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY artist_name ORDER BY added_id) = 1),
  named AS (SELECT * FROM firsts WHERE genre IS NOT NULL),
  terms AS (SELECT artist_name, 0 AS pos, {_strip("lower(genre)")} AS term FROM named
    UNION ALL SELECT artist_name, 1, {_strip("lower(list_extract(string_split(genre, ' '), -1))")} FROM named),
  hits AS (SELECT t.artist_name, CASE WHEN t.term = s.key THEN 0 ELSE 1 END AS phase, t.pos, s.ord, s.genre
    FROM terms t JOIN genre_synonyms s ON t.term <> '' AND (contains(t.term, s.key) OR contains(s.key, t.term)))
  SELECT n.artist_name, b.genre AS resolved FROM named n
  LEFT JOIN (SELECT artist_name, genre FROM hits QUALIFY row_number() OVER (PARTITION BY artist_name ORDER BY phase, pos, ord) = 1) b USING (artist_name)"""
ORACLE |= formats.oracle(ORACLE["recommend_top"], _NEW, _ARTIST_GENRES, _unit("popularity", _known("popularity")))
