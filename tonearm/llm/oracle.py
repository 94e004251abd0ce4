"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

_WHITE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"

_KEYS = r"""
keyed AS (
  SELECT row_id,
         regexp_replace(lower(coalesce(artist_name, '')), '[^\p{L}\p{M}\p{Nd}]', '', 'g') AS a,
         regexp_replace(lower(coalesce(track_name, '')), '[^\p{L}\p{M}\p{Nd}]', '', 'g') AS b
  FROM data_tracks WHERE row_id IS NOT NULL
), sets AS (
  SELECT row_id, min(row_id) OVER w AS first, count(*) OVER w AS copies FROM keyed
  WHERE a <> '' AND b <> ''
  WINDOW w AS (PARTITION BY least(a, b), greatest(a, b))
)
"""

_TOP = rf"""
SELECT artist_name, row_id, popularity,
       CAST(row_number() OVER (PARTITION BY artist_name ORDER BY popularity DESC, row_id) AS INTEGER) AS rank
FROM data_tracks
WHERE NOT regexp_full_match(artist_name, '{_WHITE}')
  AND NOT isnan(popularity) AND popularity BETWEEN 0 AND 100
QUALIFY rank <= 10
"""

_VALUES = ("danceability", "energy", "valence", "acousticness")
_NEAR = f"""
usable AS (
  SELECT vec_id, {", ".join(f"{v}::DOUBLE AS {v}" for v in _VALUES)}
  FROM (SELECT * FROM data_encoded QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY vec_id) = 1)
  WHERE {" AND ".join(f"NOT isnan({v}) AND {v} BETWEEN 0 AND 1" for v in _VALUES)}
), near AS (
  SELECT x.vec_id AS i, y.vec_id AS j, {" + ".join(f"(x.{v} - y.{v}) * (x.{v} - y.{v})" for v in _VALUES)} AS d2
  FROM usable x JOIN usable y ON x.vec_id <> y.vec_id
  QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY d2, y.vec_id) <= 5
), pairs AS (
  SELECT least(i, j) AS vec_id_a, greatest(i, j) AS vec_id_b, round(sqrt(min(d2)), 9) AS distance FROM near GROUP BY 1, 2
)
"""

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_NEAR} SELECT vec_id_a, vec_id_b FROM pairs",
    "p1_pairs": f"WITH {_NEAR} SELECT * FROM pairs",
    "p3_found": f"WITH {_KEYS} SELECT first AS row_id_a, row_id AS row_id_b FROM sets WHERE row_id <> first",
    "p3_counts": f"""WITH {_KEYS} SELECT row_id, copies FROM sets WHERE row_id = first
      UNION ALL SELECT row_id, 1 FROM keyed WHERE a = '' OR b = ''""",
    "p6_texts": "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents",
    "p7_met": """SELECT mix_name, source, round(greatest(coalesce(sum(weight), 0), 0) / sum(greatest(coalesce(sum(weight), 0), 0)) OVER (PARTITION BY mix_name), 9) AS target_share,
        max(max_repeats) AS max_repeats, true AS met
      FROM mix_targets WHERE mix_name IS NOT NULL AND source IS NOT NULL GROUP BY mix_name, source""",
    "p8_read": "SELECT source, count(*) AS documents, count(*) AS scored FROM documents GROUP BY source",
    "p5_found": f"SELECT row_id FROM ({_TOP})",
    "p5_ranked": _TOP,
}
