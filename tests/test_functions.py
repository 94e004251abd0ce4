import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonearm.functions import text, vector
from tonearm.functions.missing import number_or_null, valid_number
from tonearm.plans import queries


def one(spark, rows, kind, *columns):
    return spark.createDataFrame([(r,) for r in rows], f"x {kind}").select(*columns).collect()


def test_normalized_title(spark):
    rows = ["Song (feat. X) [Live]", "  SONG ", "a  b", None, "x (y (z) w)"]
    got = [r[0] for r in one(spark, rows, "string", text.normalized_title(F.col("x")))]
    assert got == ["song", "song", "a b", "", "x w)"]


def test_remix_needs_a_leading_space(spark):
    rows = ["A remix", "A (Remix)", "Remix A", "A - REMIX", None]
    assert [r[0] for r in one(spark, rows, "string", text.is_remix(F.col("x")))] == [True, False, False, True, False]


def test_id_from_url(spark):
    rows = ["https://play.tunes.example/track/abc?si=1", "abc", None]
    assert [r[0] for r in one(spark, rows, "string", text.id_from_url(F.col("x"), "tunes.example"))] == ["abc", "abc", None]


def test_contains_is_literal(spark):
    rows = ["100% A_b", "xA.b"]
    assert [r[0] for r in one(spark, rows, "string", text.contains_ignoring_case(F.col("x"), "a_B"))] == [True, False]


def test_shortened(spark):
    assert [r[0] for r in one(spark, ["abcdef", "abc"], "string", text.shortened(F.col("x"), 3))] == ["abc…", "abc"]


def test_parsers():
    assert text.parse_assignments("A=Pop, B = g=2,bad,A=rock") == {"A": "rock", "B": "g=2"}
    assert text.parse_ordinals("1-3,7, 99", 8) == [1, 2, 3, 7]
    assert text.parse_ordinals("x", 3) == [1, 2, 3]
    assert text.best_genre_match("dub", ["tidal dub", "dub step"]) is None
    assert text.best_genre_match("tidal", ["tidal dub", "rock"]) == "tidal dub"


def test_missing_numbers(spark):
    rows = [1.0, float("nan"), float("inf"), None, -1.0, 101.0]
    got = one(spark, rows, "double", valid_number(F.col("x"), 0, 100), number_or_null(F.col("x"), 0, 100))
    assert [tuple(r) for r in got] == [(True, 1.0)] + [(False, None)] * 5


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(3)
    xs, q, w = rng.random((20, 3)), rng.random(3), [0.6, 1.2, 1.0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in xs], "a double, b double, c double")
    cols, qs = [F.col(c) for c in "abc"], [F.lit(float(v)) for v in q]
    got = df.select(vector.euclidean(cols, qs, w), vector.cosine(cols, qs)).toPandas().to_numpy()
    want_e = np.sqrt((((xs - q) * w) ** 2).sum(1))
    want_c = 1 - xs @ q / np.linalg.norm(xs, axis=1) / np.linalg.norm(q)
    assert np.allclose(got[:, 0], want_e) and np.allclose(got[:, 1], want_c)


def test_cosine_of_zero_vectors_is_one(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0)], "a double, b double")
    zero = [F.lit(0.0), F.lit(0.0)]
    assert [r[0] for r in df.select(vector.cosine([F.col("a"), F.col("b")], zero)).collect()] == [1.0, 1.0]
    assert [r[0] for r in df.select(vector.cosine([F.col("a"), F.col("b")], [F.lit(1.0), F.lit(0.0)])).collect()] == [1.0, 0.0]


def test_half_precision_matches_numpy(spark):
    rng = np.random.default_rng(5)
    xs = np.concatenate([rng.uniform(-300, 300, 300), [0.0, 0.1, 1.0]])
    got = [r[0] for r in one(spark, [float(x) for x in xs], "double", vector.half_precision(F.col("x")))]
    assert np.array_equal(np.array(got), xs.astype(np.float16).astype(float))


def test_half_precision_of_every_finite_value(spark):
    edges = [2.0**-14, 2.0**-24, 2.0**-25, 1.5 * 2.0**-24, 1e-9, 5e-324, 60000.5, 65504.0, 65519.99, 65520.0, 1e300]
    xs = np.concatenate([edges, np.random.default_rng(6).uniform(0, 0.001, 300), np.random.default_rng(7).uniform(60000, 70000, 300), [0.0]])
    xs = np.concatenate([xs, -xs])
    got = [r[0] for r in one(spark, [float(x) for x in xs], "double", vector.half_precision(F.col("x")))]
    with np.errstate(over="ignore"):
        assert np.array_equal(np.array(got), xs.astype(np.float16).astype(float))


def test_quantized_features_keep_zeros_small_and_large_values(spark, tmp_path):
    rows = [(1, 0.0, 0.0), (2, 0.0004, 65504.0), (3, -1e-9, 70000.0), (4, None, float("nan"))]
    spark.createDataFrame(rows, "row_id bigint, danceability double, tempo double").write.parquet(str(tmp_path / "data_tracks.parquet"))
    got = {r.row_id: (r.danceability, r.tempo) for r in queries.quantized_features(spark, str(tmp_path)).collect()}
    assert got == {1: (0.0, 0.0), 2: (float(np.float16(0.0004)), 65504.0), 3: (0.0, float("inf")), 4: (None, None)}


@settings(deadline=None)
@given(st.text(alphabet="0123456789,- x", max_size=12), st.integers(1, 9))
def test_ordinals_stay_in_range(spec, n):
    assert all(1 <= i <= n for i in text.parse_ordinals(spec, n))
