import json
import os
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tonearm.schema import RAW
from tonearm.sources import files
from tonearm.streaming.incremental import follow, read_store


def test_csv_zip_round_trip(spark, tmp_path):
    rows = [("A, B", 't "x"', "1", None, 2000.0), (None, "y\nz", "2", 3.5, None)]
    df = spark.createDataFrame(rows, "artist_name string, track_name string, track_id string, popularity double, year double")
    path = str(tmp_path / "in" / "tracks.csv.zip")
    files.write_csv_zip(df, path)
    assert zipfile.ZipFile(path).namelist() == ["tracks.csv"]
    back = files.read_csv_zip(spark, path)
    assert back.schema == RAW
    assert sorted(back.select(*df.columns).collect(), key=lambda r: r.track_id) == rows
    with pytest.raises(ValueError):
        files.read_csv(spark, path)
    files.write_csv(df, str(tmp_path / "plain"))
    assert files.read_csv(spark, str(tmp_path / "plain")).count() == 2


def test_optional_source(spark, tmp_path):
    missing = str(tmp_path / "nothing.parquet")
    assert files.optional(files.parquet(missing), missing)(spark).count() == 0


def test_half_precision_import(spark, tmp_path):
    path = str(tmp_path / "h.parquet")
    table = pa.table({"a": pa.array([0.5, 0.25], pa.float16()), "s": pa.array(["x", "y"]).dictionary_encode()})
    pq.write_table(table, path, row_group_size=1)
    assert sorted(map(tuple, files.read_half_precision(spark, path).collect())) == [(0.25, "y"), (0.5, "x")]


def test_parquet_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "i int, x float")
    files.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()


def test_id_file(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# c\n\n  abc \nhttps://tunes.example/track/xyz?si=1\n")
    assert [r.track_id for r in files.read_ids(spark, str(tmp_path / "ids.txt"), "tunes.example").collect()] == ["abc", "xyz"]


def test_landed_pages(spark, tmp_path):
    pages = [{"content": [{"href": "u/1", "trackTitle": "a"}, {"href": "u/2"}]}, {"content": []}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, pages)))
    got = files.read_landed(spark, str(tmp_path / "l.json"), files.TRACK_RECORD).orderBy("ord").collect()
    assert [(r.href, r.trackTitle) for r in got] == [("u/1", "a"), ("u/2", None)]
    assert files.pages_to_fetch(20) == 100 and files.pages_to_fetch(50) == 150


def test_first_resolving(spark):
    tried = spark.createDataFrame([("A", 1, "x"), ("A", 2, "y"), ("B", 1, "z")], "artist string, o int, link string")
    known = spark.createDataFrame([("x", None), ("y", "id1")], "link string, id string")
    assert [tuple(r) for r in files.first_resolving(tried, known, "artist", "o", "link", "id").collect()] == [("A", "id1")]


def test_following_a_landing_folder(spark, tmp_path):
    main = spark.createDataFrame([("M", "m", "m1")], "artist_name string, track_name string, track_id string")
    main.write.parquet(str(tmp_path / "main"))
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()

    def land(name, rows):
        (landing / name).write_text("\n".join(json.dumps(dict(zip(("artist_name", "track_name", "track_id"), r))) for r in rows))
        follow(spark, str(landing), store, str(tmp_path / "main"), str(tmp_path / "check")).awaitTermination()

    land("1.json", [("A", "s", "a1"), ("A", "S (live)", "a2"), ("M", "other", "m1")])
    land("2.json", [("A", "s", "a9"), ("B", "b", "b1")])
    land("3.json", [("C", "first without an id", None), ("C", "second", None)])
    land("4.json", [("D", "third without an id", None)])
    assert [r.track_name for r in read_store(spark, store).filter("track_id is null").collect()] == ["first without an id"]
    got = spark.read.schema(RAW).parquet(*[f"{store}/batch={i}" for i in (0, 1)])
    assert sorted(r.track_id for r in got.collect()) == ["a1", "b1"]
    assert sorted(r.track_id for r in read_store(spark, store).filter("track_id is not null").collect()) == ["a1", "b1"]


@pytest.mark.parametrize(
    "mode, left",
    [("default", ["a1", "a2", "b1"]), ("update", ["a1", "a2", "a4", "b1", "m2"]), ("override", ["a3", "a4", "b1", "m2"])],
)
def test_modes_of_following(spark, tmp_path, mode, left):
    main = spark.createDataFrame([("M", "m", "m1")], "artist_name string, track_name string, track_id string")
    main.write.parquet(str(tmp_path / "main"))
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    rows = [[("A", "one", "a1"), ("A", "two", "a2")], [("A", "One (live)", "a3"), ("A", "four", "a4"), ("M", "new", "m2"), ("M", "x", "m1"), ("B", "b", "b1")]]
    for i, own in enumerate(rows):
        (landing / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("artist_name", "track_name", "track_id"), r))) for r in own))
        follow(spark, str(landing), store, str(tmp_path / "main"), str(tmp_path / "check"), mode).awaitTermination()
    assert sorted(r.track_id for r in read_store(spark, store).collect()) == left


def test_order_of_arrival_does_not_depend_on_file_sizes(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    names = ["z", "a", "m"]  # arrival goes by time, then by path; a large file is packed apart from small ones
    for i, name in enumerate(names):
        rows = [{"artist_name": "A", "track_name": f"{name} {k}" if i != 1 else "z 0", "track_id": f"{name}{k}"} for k in range(3000 if i == 1 else 2)]
        (landing / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(landing / f"{name}.json", (1000 + i // 2, 1000 + i // 2))
    got = spark.read.schema(RAW).json(str(landing)).select("track_id", files.arrival_order().alias("o")).orderBy("o").limit(3001).collect()
    assert [r.track_id for r in got[:2]] == ["a0", "a1"] and [r.track_id for r in got[-1:]] == ["z0"]
    pages = [{"content": [{"href": "t/1", "tempo": float(i)}]} for i in range(4)]
    for i, page in enumerate(pages):
        (tmp_path / f"p{3 - i}.json").write_text(json.dumps(page) + "\n" + " " * (5000 if i == 2 else 0))
        os.utime(tmp_path / f"p{3 - i}.json", (2000 + i, 2000 + i))
    last = files.read_landed(spark, str(tmp_path / "p*.json"), files.FEATURE_RECORD).orderBy(F.col("ord").desc()).first()
    assert last.tempo == 3.0


def test_artist_records_and_pages(spark, tmp_path):
    page = {"content": [{"name": "A", "genres": ["x", "y", "z"]}, {"name": "A", "genres": ["q"]}, {"name": "B", "genres": []}, {"name": "C", "genres": ["w"]}]}
    (tmp_path / "a.json").write_text(json.dumps(page))
    artists = files.read_landed(spark, str(tmp_path / "a.json"), files.ARTIST_RECORD)
    assert sorted(map(tuple, files.genres_of_artists(artists).collect())) == [("A", "x", "y"), ("C", "w", None)]
    tracks = spark.createDataFrame([("A", i) for i in range(120)], "artist string, n int")
    assert files.artist_pages(tracks, "artist", "n", 10).count() == 50 and files.artist_pages(tracks, "artist", "n", 30).count() == 100
