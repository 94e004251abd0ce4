import random

import pytest

from tonearm.llm import history
from tonearm.llm.titles import most_slips, read_title, same_title, slips

HIST = "row_id bigint, artist_name string, track_name string, track_id string"
NEW = "added_id bigint, batch_no int, artist_name string, track_name string, track_id string, cid int, fps string"


def repeated(spark, old, new, **more):
    h, n = spark.createDataFrame(old, HIST), spark.createDataFrame([(*r, 0, "") for r in new], NEW)
    out = history.repeated_rows(h, n, "row_id", "added_id", "batch_no", "artist_name", "track_name", "track_id", **more)
    got = [r.added_id for r in out.collect()]
    assert len(got) == len(set(got))
    return sorted(got)


OLD = [(1, "Ana", "Iceberg Song for Lucid Memory", "AAAAAAAAAAAAAAAAAAAAA1"), (2, "Ana", "Weekend", "A2"), (3, None, "Nobody's Title Here", "A3"), (4, "Bo", None, None)]
ADDED = [
    (10, 0, "Ana", "Iceburg Song for Lucid Memroy", None),  # two slips
    (11, 0, "Bo", "Iceberg Song for Lucid Memory", None),  # another artist
    (12, 0, "Ana", "Iceberg Song for Lucid Winter", "n1"),  # another content word
    (13, 0, "Ana", "ICEBERG SONG FOR LUCID MEMORY (feat. Cy Dee) [Remastered 2011]", "n2"),
    (14, 0, "Cy", "x", " tunes:track:AAAAAAAAAAAAAAAAAAAAA1 "),  # the id in another notation
    (15, 0, "Cy", "x y z", "aaaaaaaaaaaaaaaaaaaaa1"),  # the id in another case
    (16, 0, "Ana", "Wekend", "n3"),  # a slip in a short title
    (17, 0, None, "Nobody's Title Here", "n4"),  # no artist, no title match
    (18, 1, "Dee", "Brand New Opening Number", "n5"),
    (19, 0, "Dee", "Brand New Opening Numbr", "n6"),  # the earlier batch comes first: 18 repeats it
    (20, 2, "Dee", "Brand New Opening Number, Pt. II", "n7"),
    (21, 2, "Dee", "Brand New Opening Number, Pt. III", "n8"),
    (22, 2, "Ana", "Iceberg Song for Lucid Mem…", "n9"),  # cut
    (23, 2, "Ana", "  ", None), (24, 2, "Ana", "", " "),
    (25, 2, "Ana", "Iceberg Song for Lucid Memory (Live)", "n10"),
]
CASES = [10, 13, 14, 16, 18, 22]


@pytest.mark.parametrize("run_rows", [4, 50_000])
def test_cases_do_not_depend_on_how_batches_are_run(spark, run_rows):
    assert repeated(spark, OLD, ADDED, run_rows=run_rows) == CASES


def test_empty_tables_and_nulls(spark):
    assert repeated(spark, OLD, []) == []
    assert repeated(spark, [], [(1, None, "A", "Some Title", "x"), (2, 0, "A", "Some Title", "y"), (None, 0, "A", "Some Title", "x"), (3, 0, "B", "q", "y")]) == [2, 3]


def test_hot_title(spark):
    old = [(i, "Hot", "The Same Old Song Again", f"h{i}") for i in range(400)]
    new = [(i, 0, "Hot", "The Same Old Song Again" if i % 3 == 0 else f"Title number {i} of this list", f"k{i}") for i in range(300)]
    assert repeated(spark, old, new, run_rows=100) == [i for i in range(300) if i % 3 == 0]


def test_small_runs_are_merged_and_nothing_is_lost(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "FAN", 2)
    root = str(tmp_path / "store")
    assert repeated(spark, OLD, ADDED, root=root, run_rows=6) == CASES
    store = history.HistoryStore.open(spark, root)
    assert len(store.live) < 3 and len(list((tmp_path / "store" / "titles").glob("run=*"))) == len(store.live)
    rows = spark.createDataFrame([(90, 9, "AAAAAAAAAAAAAAAAAAAAA1", "Z", None), (91, 9, None, "Ana", "Wekkend"), (92, 9, None, "Dee", "Brand New Opening Number, Pt. III")],
                                 "ident bigint, ord int, idk string, artist string, title string")
    assert sorted(r.ident for r in store.check_and_add(rows).collect()) == [90, 91, 92]


def test_a_hot_bucket_is_split_by_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(history, "ROWS_PER_FILTER", 50)
    old = [(i, "Hot", f"Evening Number {i} of the Long Parade", f"h{i}") for i in range(400)]
    new = [(i, 0, "Hot", f"Evening Numbr {i * 7} of the Long Parade", f"k{i}") for i in range(100)]
    assert repeated(spark, old, new) == [i for i in range(100) if i * 7 < 400]


def test_null_batches_come_before_negative_ones(spark):
    assert repeated(spark, [], [(1, -1, "A", "Some Title", "x"), (2, None, "A", "Some Title", "y"), (3, -2, "A", "Another Song", "z")]) == [1]


def test_store_can_be_continued(spark, tmp_path):
    root = str(tmp_path / "store")
    assert repeated(spark, OLD, ADDED, root=root) == CASES
    rows = spark.createDataFrame([(90, 9, None, "Dee", "Brand New Opening Number"), (91, 9, "n10", "Z", "q"), (92, 9, "N10", "Z", "Something else entirely")],
                                 "ident bigint, ord int, idk string, artist string, title string")
    assert sorted(r.ident for r in history.HistoryStore.open(spark, root).check_and_add(rows).collect()) == [90, 91]
    assert sorted(r.ident for r in history.HistoryStore.open(spark, root).check_and_add(rows).collect()) == [90, 91, 92]


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Song for the Rain", "song_for_the_rain!!", True),
        ("Wandering Firefly & August", "Wandering Firefly n' August", True),
        ("Uncertainty in the Quiet Hall", "Uncertainty in th' Quiet Hall", True),
        ("Crimson Knapsack", "Сrimsоn Knapsасk", True),
        ("Title of Things - 1998 Digital Remaster", "Title of Things", True),
        ("Title of Things (Radio Edit)", "Title of Things", True),
        ("Title of Things (Club Remix)", "Title of Things", False),
        ("Title of Things No. 4", "Title of Things No. 41", False),
        ("Title of Things, Part 2", "Title of Things, Pt. II", False),
        ("Gravity", "Gravity and the Woven Kettle", False),
        ("", "", False),
    ],
)
def test_titles(a, b, same):
    assert same_title(read_title(a), read_title(b)) is same and same_title(read_title(b), read_title(a)) is same


def _spoiled(rng, letters):
    """A title with as many slips as are allowed, or a cut end."""
    if len(letters) >= 12 and rng.random() < 0.3:
        return letters[: rng.randint(-(-len(letters) // 2), len(letters) - 1)]
    out = list(letters)
    for _ in range(most_slips(len(letters))):
        i = rng.randrange(len(out))
        how = rng.choice("xxsid")
        if how == "x" or how == "d" and len(out) < 2:
            out[i] = rng.choice("abcdefgh")
        elif how == "s" and i:
            out[i - 1], out[i] = out[i], out[i - 1]
        elif how == "i":
            out.insert(i, rng.choice("abcdefgh"))
        elif how == "d":
            del out[i]
    return "".join(out)


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ab"])
def test_search_finds_whatever_the_title_rule_accepts(alphabet):
    rng = random.Random(4)
    stored = ["".join(rng.choice(alphabet) for _ in range(n)) for n in range(1, 90) for _ in range(60)]
    asking = [_spoiled(rng, x) for x in stored]
    pairs = [(a, b) for x, y in zip(stored, asking) for a, b in ((x, y), (y, x))]
    pairs = [(a, b) for a, b in pairs if a and b and same_title(read_title(f"{a}…"), read_title(b)) | same_title(read_title(a), read_title(f"{b}…"))]
    assert {len(a) for a, _ in pairs} >= set(range(1, 90))
    kept, asked = (history.fingerprints([p[i] for p in pairs], ["Ana"] * len(pairs), asking=bool(i)).to_pylist() for i in (0, 1))
    assert [p for p, k, a in zip(pairs, kept, asked) if not {*k} & {*a}] == []
    assert [(a, b) for a, b in pairs if not history.covered(b, a)] == []


def test_repetitions_that_share_few_letters_in_a_row(spark):
    old = [(1, "Ana", "Bravo", "a1"), (2, "Ana", "Kingdom Harbor…", "a2"), (3, "Ana", "Velvet Evenings", "a3"), (4, "Ana", "Q", "a4")]
    new = [(10, 0, "Ana", "Brxvo", "n1"), (11, 0, "Ana", "Kingdom Harbor Lights Again", "n2"), (12, 0, "Ana", "Velxet Evexings", "n3"), (13, 0, "Ana", "Z", "n4")]
    assert repeated(spark, old, new) == [10, 11, 12, 13]


def test_slips():
    assert slips("abc", "acb", 3) == 1 and slips("abc", "abc", 0) == 0 and slips("kitten", "sitting", 3) == 3
    assert slips("abc", "xyz", 1) == 2 and slips("", "ab", 2) == 2 and slips("aab", "ab", 2) == 1
