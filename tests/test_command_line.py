import json

import pytest

from tonearm.__main__ import main, read_store
from tonearm.schema import RAW


def store(spark, path, rows):
    width = len(RAW.fields)
    full = [(*r, *[None] * (width - len(r))) for r in rows]
    from tonearm.sources.files import write_csv_zip

    write_csv_zip(spark.createDataFrame(full, RAW), path)


def land(path, records):
    path.write_text(json.dumps({"content": records}))
    return str(path)


def ids(spark, path):
    return sorted(r.track_id for r in read_store(spark, path).collect())


@pytest.fixture
def landed(tmp_path):
    tracks = [
        {"href": "x/n1", "trackTitle": "New", "popularity": 5.0, "artists": [{"id": "1", "name": "A"}]},
        {"href": "x/n2", "trackTitle": "Other", "popularity": 9.0, "artists": [{"id": "2", "name": "B"}]},
        {"href": "x/m1", "trackTitle": "Known", "popularity": 9.0, "artists": [{"id": "2", "name": "B"}]},
    ]
    return ["--tracks", land(tmp_path / "t.json", tracks), "--features", land(tmp_path / "f.json", [{"href": "x/n1", "tempo": 90.0}])]


@pytest.mark.parametrize("flags, left", [([], ["a1", "n2"]), (["--update"], ["a1", "n1", "n2"]), (["--override"], ["n1", "n2"]), (["--dry-run"], ["a1"])])
def test_ingest(spark, tmp_path, landed, flags, left):
    added, base = str(tmp_path / "added.csv.zip"), str(tmp_path / "main.csv.zip")
    store(spark, added, [("A", "Old", "a1")])
    store(spark, base, [("M", "Known", "m1")])
    assert main(["ingest", *landed, "--added", added, "--main", base, *flags], spark) == 0
    assert ids(spark, added) == left


def test_update_and_override_exclude_each_other(spark, landed):
    with pytest.raises(SystemExit):
        main(["ingest", *landed, "--added", "a", "--main", "m", "--update", "--override"], spark)


def test_update_genre(spark, tmp_path):
    added = str(tmp_path / "added.csv.zip")
    store(spark, added, [("A", "Old", "a1"), ("B", "x", "b1")])
    assert main(["update-genre", "A=Folk, Nobody=rock", "--added", added, "--dry-run"], spark) == 0
    assert {r.genre for r in read_store(spark, added).collect()} == {None}
    assert main(["update-genre", "A=Folk, Nobody=rock", "--added", added], spark) == 0
    assert {r.track_id: r.genre for r in read_store(spark, added).collect()} == {"a1": "folk", "b1": None}


def test_encode(spark, tmp_path):
    data, out, genres = str(tmp_path / "d.csv.zip"), str(tmp_path / "o.parquet"), str(tmp_path / "g")
    spark.createDataFrame([("folk", "wood", 1.0)], "genre string, family string, weight double").write.parquet(genres)
    store(spark, data, [("A", "one", "1", 5.0), ("A", "two remix", "2", 7.0), ("A", "three", "3", 9.0), ("B", "four", "4", 1.0)])
    extra = ["--membership", genres, "--merge", str(tmp_path / "absent.zip")]
    assert main(["encode", "-i", data, "-o", out, *extra], spark) == 0
    assert sorted(r.track_id for r in spark.read.parquet(out).collect()) == ["1", "3"]
    assert main(["encode", "-i", data, "-o", out, *extra, "--keep-remixes", "--min-songs", "1", "--max-songs", "2"], spark) == 0
    assert sorted(r.track_id for r in spark.read.parquet(out).collect()) == ["2", "3", "4"]
    assert main(["encode", "-i", str(tmp_path / "none"), "-o", out, *extra], spark) == 1
