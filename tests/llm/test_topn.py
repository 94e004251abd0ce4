import random

from pyspark.sql import functions as F

from tonearm.llm import heap, topn


def test_against_sorting_with_a_hot_group_and_ties(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"g{rng.randrange(200)}", float(rng.randrange(5)), "x") for i in range(6000)]
    df = spark.createDataFrame(rows, "row_id bigint, artist_name string, popularity double, rank string")
    got = topn.top_n_per_group(df, "artist_name", F.col("popularity"), "row_id", 10).collect()
    want = set()
    for g in {r[1] for r in rows}:
        best = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:10]
        want |= {(g, r[0], k + 1) for k, r in enumerate(best)}
    assert {(r.artist_name, r.row_id, r.rank) for r in got} == want


def test_nulls_blanks_and_extremes(spark):
    low = -(2**63)
    rows = [(low, "a", 1.0), (5, "a", 1.0), (6, None, 1.0), (7, "  ", 1.0), (8, "a", None), (9, "a", float("nan")), (None, "a", 3.0)]
    df = spark.createDataFrame(rows, "row_id bigint, g string, s double")
    got = topn.top_n_per_group(topn.named_groups(df, "g"), "g", F.col("s"), "row_id", 10).orderBy("rank").collect()
    assert [r.row_id for r in got] == [low, 5]
    assert topn.top_n_per_group(df.limit(0), "g", F.col("s"), "row_id", 1).count() == 0


def test_heaps_are_built_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id", "id % 2 as g", "cast(id as double) as s")
    plan = topn.top_n_per_group(df, "g", F.col("s"), "id", 2)._jdf.queryExecution().toString()
    assert "partial_collect_top_k" in plan and "Window" not in plan


def test_heaps_and_what_stands_in_for_them(spark, monkeypatch):
    df = spark.createDataFrame([(g, v) for g in "ab" for v in range(9)], "g string, v int")

    def run():
        got = df.groupBy("g").agg(heap.largest(F.col("v"), 3).alias("l"), heap.smallest(F.col("v"), 2).alias("s"))
        return sorted((r.g, r.l, r.s) for r in got.collect())

    assert run() == [("a", [8, 7, 6], [0, 1]), ("b", [8, 7, 6], [0, 1])]
    own = run()
    monkeypatch.setattr(heap, "_top_k", None)
    assert run() == own
