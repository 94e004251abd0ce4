import json

import numpy as np
import pytest

from tonearm.operators.seeds import client_problems
from tonearm.plans import recommend as rec
from tonearm.schema import FEATURE_WEIGHTS, Request


def serving(spark, rows):
    """rows: (artist, id, x, genre_a, genre_b); every audio feature but energy is 0."""
    others = [c for c in FEATURE_WEIGHTS if c != "energy"]
    kinds = "artist_name string, track_id string, track_name string, energy double, genre_a double, genre_b double, " + ", ".join(f"{c} double" for c in others)
    data = [(a, i, f"t {i}", float(x), float(p), float(q), *[0.0] * len(others)) for a, i, x, p, q in rows]
    return rec.serving_table(spark.createDataFrame(data, kinds))


ROWS = [("S", "s1", 0.5, 1, 0), ("S", "s2", 0.5, 1, 0), ("A", "a1", 0.51, 1, 0), ("A", "a2", 0.52, 1, 0), ("A", "a3", 0.53, 1, 0),
        ("A", "a4", 0.54, 1, 0), ("A", "a5", 0.55, 1, 0), ("B", "b1", 0.6, 1, 0), ("B", "b2", 0.9, 0, 1), ("C", "c1", 0.5, 1, 0)]


def test_small_pool_seed_exclusion_and_singletons(spark):
    got = rec.recommend(serving(spark, ROWS), Request(("S", "S", "nobody"), diversity=1)).orderBy("artist_rank", "track_rank").collect()
    assert [r.artist_name for r in got if r.track_rank == 1] == ["A", "B"]  # S is asked for, C has one track
    assert [r.track_id for r in got if r.artist_name == "A"] == ["a1", "a2", "a3", "a4"]  # four at most


def test_unknown_artists_are_an_error(spark):
    with pytest.raises(ValueError):
        rec.recommend(serving(spark, ROWS), Request(("nobody",)))
    with pytest.raises(ValueError):
        Request(())
    with pytest.raises(ValueError):
        Request(("S",), diversity=0)


def test_shuffle_changes_ranks_not_membership(spark):
    tracks = serving(spark, ROWS)
    sets = [{r.track_id for r in rec.recommend(tracks, Request(("S",), max_artists=9), seed=s).collect()} for s in (1, 2)]
    top = {r.artist_name for r in rec.recommend(tracks, Request(("S",), max_artists=9), seed=1).collect()}
    assert top == {"A", "B"} and all(s <= {r[1] for r in ROWS} for s in sets)
    a = rec.recommend(tracks, Request(("S",)), seed=1).collect()
    assert a == rec.recommend(tracks.repartition(7), Request(("S",)), seed=1).collect() or sorted(a) == sorted(
        rec.recommend(tracks.repartition(7), Request(("S",)), seed=1).collect()
    )


def test_blocks_agree_with_the_single_plan(spark):
    tracks = serving(spark, ROWS)
    point = tracks.filter("track_id = 'b1'")
    single = rec.nearest_to_point(tracks, point, 5, 2.0)
    assert "TakeOrderedAndProject" in single._jdf.queryExecution().toString()
    features = [*rec.audio_columns(tracks), *rec.genre_columns(tracks)]
    asks = point.selectExpr("0L as request_id", "1 as diversity", "2.0D as genre_weight", *features)
    many = rec.nearest_tracks(tracks, asks).orderBy("place").limit(5).collect()
    one = single.orderBy("d", "track_id").collect()
    assert [r.track_id for r in many] == [r.track_id for r in one] and np.allclose([r.d for r in many], [r.d for r in one])


def test_serving_table_checks_and_drops(spark):
    with pytest.raises(ValueError):
        rec.serving_table(spark.createDataFrame([("a",)], "artist_name string"))
    others = ", ".join(f"{c} double" for c in FEATURE_WEIGHTS)
    n = len(FEATURE_WEIGHTS)
    rows = [("A", "t", "1", *[0.5] * n), ("A", "t", "1", *[0.6] * n), (None, "t", "2", *[0.5] * n), ("A", "t", "3", *[float("nan")] * n), ("A", "t", "4", *[None] * n)]
    df = spark.createDataFrame(rows, f"artist_name string, track_name string, track_id string, {others}")
    assert [r.track_id for r in rec.serving_table(df).collect()] == ["1"]


def test_nested_view(spark):
    got = rec.nested(rec.recommend(serving(spark, ROWS), Request(("S",), diversity=1))).orderBy("artist_rank").first()
    assert got.artist_name == "A" and [t.track_id for t in got.tracks] == ["a1", "a2", "a3", "a4"]


def test_json_response(spark):
    tracks = serving(spark, ROWS)
    rows = rec.recommend_all(tracks, rec.request_frame(spark, Request(("S",), diversity=1)))
    got = json.loads(rec.as_json(rows).first().recommendations)
    assert list(got) == ["A", "B"] and [t["track_id"] for t in got["B"]] == ["b1", "b2"]


def test_request_plans_do_not_shuffle_tracks_by_id(spark):
    tracks = serving(spark, ROWS)
    asks = rec.request_frame(spark, Request(("S",), ("b1",)))
    from tonearm.operators.seeds import representative_vectors

    plan = representative_vectors(tracks, asks, ["energy"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastHashJoin" in plan


def test_limits_of_the_client(spark):
    kinds = "request_id bigint, artists array<string>, track_ids array<string>, diversity int, max_artists int, genre_weight double"
    rows = [
        (1, ["a"], None, 2, 6, 2.0), (2, list("abcdef"), None, 2, 6, 2.0), (3, list("aabbccd"), [], 4, 2, 2.25), (4, None, ["1", "2", "3", "4", "4"], 1, 12, 5.0),
        (5, ["a"], ["1", "2", "3", "3", "9", None], None, None, None),
    ]
    tracks = spark.createDataFrame([(str(i), "a") for i in range(1, 5)] + [("9", "b"), ("9", None)], "track_id string, artist_name string")
    got = sorted((r.request_id, r.problem) for r in client_problems(spark.createDataFrame(rows, kinds), tracks).collect())
    assert got == [(2, "artists"), (3, "genre weight"), (3, "results"), (3, "variety"), (4, "songs"), (5, "genre weight"), (5, "results"), (5, "variety")]
