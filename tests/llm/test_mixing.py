import numpy as np
import pytest

from tonearm.llm import mixing

DOCS = "doc_id bigint, text string, source string, lang string, topic string, tokens int"
PLAN = "mix_name string, source string, weight double, max_repeats int"


def mixed(spark, docs, plan, **more):
    out, shares = mixing.mix_sources(spark.createDataFrame(docs, DOCS), spark.createDataFrame(plan, PLAN), "doc_id", "text", "source", ["lang", "topic"], **more)
    return out.collect(), {(r.mix_name, r.source): r for r in shares.collect()}


def corpus():
    docs = [(i, "word " * (20 + i % 50), "big", "en" if i % 4 else "de", f"t{i % 3}", 0) for i in range(600)]
    docs += [(1000 + i, "word " * 40, "small", "en", "t0", 0) for i in range(40)]
    return docs + [(2000, None, "big", "en", "t0", 0), (2001, "", "small", None, None, 0), (2002, "x y", None, "en", "t1", 0), (2003, "x y", "other", "en", "t1", 0)]


def test_shares_meet_the_targets_and_caps_hold(spark):
    plan = [("m", "big", 3.0, 1), ("m", "small", 1.0, 4), ("m", "absent", 1.0, 9), ("m", "zero", 0.0, 1), ("m", "null", None, None)]
    rows, shares = mixed(spark, corpus(), plan)
    assert shares[("m", "big")].share == pytest.approx(0.75, abs=0.005) and shares[("m", "small")].share == pytest.approx(0.25, abs=0.005)
    assert shares[("m", "absent")].target_share == pytest.approx(0.2) and shares[("m", "absent")].share == 0.0
    assert all(r.repeats <= {"big": 1, "small": 4}[r.source] and r.tokens > 0 for r in rows)
    assert {r.doc_id for r in rows}.isdisjoint({2000, 2001, 2002, 2003})
    assert shares[("m", "small")].tokens == sum(r.tokens * r.repeats for r in rows if r.source == "small")


def test_languages_keep_their_shares(spark):
    docs = [(i, "word " * (20 + i % 50), "big", "en" if i % 4 else "de", f"t{i % 3}", 0) for i in range(4000)]
    docs += [(9000 + i, "word " * 40, "small", "en", "t0", 0) for i in range(1000)]
    rows, _ = mixed(spark, docs, [("m", "big", 1.0, 1), ("m", "small", 1.0, 1)])
    sizes = {d[0]: len(d[1].split()) for d in docs}
    german = {d[0] for d in docs if d[3] == "de"}
    share = sum(sizes[i] for i in german) / sum(sizes.values())
    got = sum(r.tokens * r.repeats for r in rows if r.doc_id in german) / sum(r.tokens * r.repeats for r in rows)
    assert got == pytest.approx(share, abs=0.02)


def test_every_topic_keeps_its_share_however_many_there_are(spark):
    # the rare topics, after 100 larger ones, lie in one source each; together their shares hide that
    docs = [(i, "word " * 20, "big" if i % 2 else "small", "en", f"t{i // 20:03}", 0) for i in range(2000)]
    docs += [(5000 + i, "word " * 10, "big", "en", "rare big", 0) for i in range(15)] + [(6000 + i, "word " * 10, "big" if i % 2 else "small", "en", "rare both", 0) for i in range(16)]
    sizes = mixing.sizes_by_tokens(spark.createDataFrame(docs, DOCS), "doc_id", "text", "source", ["lang", "topic"])
    cells = sizes.groupBy("source", "m0", "m1").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens")
    goals = spark.createDataFrame([("m", "big", 7500.0, 3), ("m", "small", 2500.0, 3)], "mix_name string, source string, want double, cap int")
    for at_once in (10**6, 0):  # by one task, and by aggregates
        rates = mixing.raked_rates(cells, goals, ["m0", "m1"], at_once).toPandas()
        rates["taken"] = rates["rate"] * rates["tokens"]
        topics = rates.groupby("m1")[["tokens", "taken"]].sum()
        assert len(topics) == 102 and np.allclose(topics["taken"] / topics["taken"].sum(), topics["tokens"] / topics["tokens"].sum(), rtol=0.02)
        assert np.allclose(rates.groupby("source")["taken"].sum(), [7500, 2500], rtol=1e-3)


def uneven(low):
    rng = np.random.default_rng(3)
    cells = [(f"s{s}", f"l{m}", f"t{t}", int(rng.integers(low, 900))) for s in range(3) for m in range(2) for t in range(4) if s + m + t != 5]
    return cells, {s: sum(c[3] for c in cells if c[0] == s) for s in ("s0", "s1", "s2")}


CELLS, GOALS, KEY = "source string, m0 string, m1 string, tokens bigint", "mix_name string, source string, want double, cap int", ["mix_name", "source", "m0", "m1"]


def test_rates_do_not_depend_on_how_cells_are_raked(spark):
    cells, of = uneven(600)
    goals = [("a", "s0", 0.1 * of["s0"], 1), ("a", "s1", 0.0, 1), ("a", "s2", 0.7 * of["s2"], 4), ("b", "s0", 0.5 * of["s0"], 2), ("b", "s2", 1.5 * of["s2"], 2)]
    table, plan = spark.createDataFrame(cells, CELLS), spark.createDataFrame(goals, GOALS)
    at_once, spread = (mixing.raked_rates(t, plan, ["m0", "m1"], n).toPandas().sort_values(KEY, ignore_index=True) for t, n in ((table, 10**6), (table.repartition(7), 0)))
    assert len(at_once) == len(spread) == sum(c[0] == g[1] and g[2] > 0 for c in cells for g in goals)
    assert (at_once[[*KEY, "rate"]] == spread[[*KEY, "rate"]]).all(axis=None)  # to the last bit


def test_aggregates_keep_caps_as_one_task_does(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SWEEPS", 4)
    cells, of = uneven(20)
    # s0 must give all it may, s1 nearly so
    goals = [("m", "s0", 2.0 * of["s0"], 2), ("m", "s1", 0.97 * of["s1"], 1), ("m", "s2", 2.4 * of["s2"], 3)]
    table, plan = spark.createDataFrame(cells, CELLS), spark.createDataFrame(goals, GOALS)
    spread = mixing.raked_rates(table, plan, ["m0", "m1"], 0).toPandas().sort_values(KEY, ignore_index=True)
    alone = mixing._rake_mix(["m0", "m1"])(table.join(plan, "source").toPandas()).sort_values(KEY, ignore_index=True)
    assert len(spread) == len(cells) and (spread[[*KEY, "rate"]] == alone[[*KEY, "rate"]]).all(axis=None)
    capped, taken = (spread["rate"] == spread["cap"]).groupby(spread["source"]).mean(), (spread["rate"] * spread["tokens"]).groupby(spread["source"]).sum()
    assert capped["s0"] == 1 and 0 < capped["s1"] < 1 and (spread["rate"] <= spread["cap"]).all()
    assert np.allclose(taken, [g[2] for g in goals], rtol=1e-9)


def test_topics_are_met_beside_a_source_that_must_give_all():
    rng = np.random.default_rng(0)
    source, topic = (a.ravel() for a in np.meshgrid(np.arange(3), np.arange(8), indexing="ij"))
    tokens = rng.integers(100, 900, 24).astype(float)
    of = np.bincount(source, tokens)
    rate = mixing.rake(tokens, source, [topic], of * [2.0, 0.7, 1.0], np.array([2.0, 4.0, 4.0]))
    got, natural = np.bincount(topic, rate * tokens), np.bincount(topic, tokens)
    assert (rate[source == 0] == 2.0).all() and np.allclose(got / got.sum(), natural / natural.sum(), rtol=1e-5)


def test_calibration_is_as_near_as_any_factor(spark):
    rng = np.random.default_rng(5)
    rows = [("m", f"s{i % 2}", i, int(rng.integers(1, 90)), float(rng.choice([0.2, 0.7, 1.4])), 2, float(rng.random())) for i in range(300)]
    drawn = spark.createDataFrame(rows, "mix_name string, source string, id bigint, tokens bigint, rate double, cap int, u double")
    goals = spark.createDataFrame([("m", "s0", 4000.0, 2), ("m", "s1", 10.0**6, 2)], "mix_name string, source string, want double, cap int")
    factors = {r.source: r.factor for r in mixing._factors(drawn, goals).collect()}

    def taken(source, factor):
        return sum(t * min(cap, int(rate * factor + u)) for _, s, _, t, rate, cap, u in rows if s == source)

    jumps = [(j - u) / rate + 1e-9 for _, s, _, _, rate, cap, u in rows if s == "s0" for j in range(1, cap + 1)]
    assert abs(taken("s0", factors["s0"]) - 4000) <= min(abs(taken("s0", f) - 4000) for f in jumps) + 90
    assert taken("s1", factors["s1"]) == taken("s1", 4.0)


def test_a_given_total_lets_capped_sources_fall_short(spark):
    _, shares = mixed(spark, corpus(), [("m", "big", 1.0, 1), ("m", "small", 1.0, 2)], total=10_000)
    assert shares[("m", "small")].tokens == 2 * shares[("m", "small")].available_tokens
    assert sum(r.tokens for r in shares.values()) == pytest.approx(10_000, rel=0.02)


def test_empty_tables(spark):
    rows, shares = mixed(spark, [], [("m", "a", 1.0, 1)])
    assert rows == [] and shares[("m", "a")].share == 0.0
    rows, shares = mixed(spark, corpus(), [])
    assert rows == [] and shares == {}


def test_selection_is_reproducible(spark):
    plan = [("m", "big", 1.0, 1), ("m", "small", 1.0, 1)]
    assert sorted(mixed(spark, corpus(), plan)[0]) == sorted(mixed(spark, corpus()[::-1], plan)[0])


def test_raking_meets_sources_and_caps():
    rng = np.random.default_rng(1)
    tokens, source, lang = rng.uniform(1, 9, 30), np.arange(30) % 3, np.arange(30) % 2
    of = np.bincount(source, tokens)
    want, cap = of * [0.9, 0.3, 1.9], np.array([1.0, 1.0, 2.0])
    rate = mixing.rake(tokens, source, [lang], want, cap)
    assert np.allclose(np.bincount(source, rate * tokens), want, rtol=1e-6) and (rate <= cap[source] + 1e-12).all()


def test_wanted_tokens():
    assert np.allclose(mixing.wanted_tokens(np.array([0.5, 0.5]), np.array([10.0, 4.0]), None), [4, 4])
    assert np.allclose(mixing.wanted_tokens(np.array([0.5, 0.5]), np.array([10.0, 4.0]), 12.0), [8, 4])
    assert np.allclose(mixing.wanted_tokens(np.array([1.0, 0.0]), np.array([0.0, 4.0]), 12.0), [0, 0])
