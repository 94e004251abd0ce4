"""Mixing sources to target shares of the total size, with bounded repetition.

Method. Tokens are summed by cell (source, language, topic). Iterative
proportional fitting rakes the cells' weights in turn to the topic, language and
source marginals; the source marginal comes last and is met exactly, by the level
to which all cells of a source that are not at their cap are raised. A cell's
weight over its tokens is the expected number of times a document of it is taken.
Weights are summed in whole grains of a mix, and such sums are exact in any order:
the rates are the same to the last bit however the cells are spread over tasks.
Documents are then sampled at those rates by a hash of their id: ``floor(rate +
u)`` times. One factor per source is calibrated on the whole data, so that the
sampled tokens meet the target to within a document: each document's repetitions
grow at known factors, and a histogram of these, refined once where the target
lies, gives the factor.

Cells, rates and documents stay in Spark; the driver sees one row per target.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonearm.llm.tokens import DEFAULT_VOCABULARY, token_counts
from tonearm.session import durable, shared_dir

#: Rows a table of targets may have: it is a hand-written plan, and is broadcast.
MAX_TARGETS = 10_000
#: Cells of all mixes up to which one task rakes a mix's whole table; more are raked by aggregates over all tasks, to the same rates.
CELLS_AT_ONCE = 200_000
#: Most sweeps over the margins, and passes for the levels of a sweep. A mix is done before when a sweep moves no rate by more than SETTLED of its source's mean rate.
SWEEPS, PASSES, SETTLED = 60, 60, 1e-9
#: A mix has fewer than 2 ** GRAINS grains, so that doubles hold their sums exactly.
GRAINS = 50
#: Largest factor of the calibration, and bins of its histogram.
MOST_FACTOR, BINS = 4, 4096


def sizes_by_tokens(
    df: DataFrame, ident: str, text: str, source: str, margins: Sequence[str], vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """``(id, source, m0, m1 ..., tokens)`` of every text with at least one token and an id."""
    counted = token_counts(df.filter(F.col(ident).isNotNull()), [ident, source, *margins], text, vocabulary)
    tidy = [F.coalesce(F.lower(F.trim(F.col(m).cast("string"))), F.lit("")).alias(f"m{i}") for i, m in enumerate(margins)]
    return counted.filter("tokens > 0").select(
        F.col(ident).alias("id"), F.col(source).alias("source"), *tidy, F.col("tokens").cast("bigint").alias("tokens")
    )


def grain_of(total: float) -> float:
    """Tokens of a grain: the power of two of which ``total`` has fewer than ``2 ** GRAINS``, and at least half as many."""
    return math.ldexp(1.0, math.frexp(total)[1] - GRAINS) if total > 0 else 1.0


def gives_all(want: np.ndarray, cap: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Must a source give all it may? Then all its cells are at their cap."""
    return want >= cap * of * (1 - 1e-12)


def next_level(
    level: np.ndarray, least: np.ndarray, want: np.ndarray, cap: np.ndarray, full: np.ndarray, held: np.ndarray, rest: np.ndarray
) -> np.ndarray:
    """What a source's rates are multiplied by to meet ``want``, if the cells that ``level`` brings to their cap stay there.

    ``held`` is the natural size of these cells, ``rest`` the raked size of the
    others. From any level a step leads to one that is not too high; from there
    (``least``) levels grow until they bring no further cell to its cap.
    """
    further = np.divide(want - cap * held, rest, out=np.zeros_like(want), where=rest > 0)
    return np.where(full, level, np.maximum(further, least))


def rake(
    tokens: np.ndarray, source: np.ndarray, margins: Sequence[np.ndarray], want: np.ndarray, cap: np.ndarray
) -> np.ndarray:
    """Expected repetitions of each cell.

    ``want`` holds the tokens wanted of each source, ``cap`` its most repetitions
    (``want`` must not exceed ``cap`` times the source's tokens). The other
    margins are drawn towards their shares of the whole; no rate exceeds its cap.
    """
    of = np.bincount(source, tokens, len(want))
    mean = np.divide(want, of, out=np.zeros_like(of), where=of > 0)[source]
    total = math.fsum(want)
    grain = grain_of(total)
    full, most = gives_all(want, cap, of), cap[source]
    size, want = tokens / grain, want / grain
    scale = total / grain / size.sum()
    rate = mean
    for _ in range(SWEEPS):
        before = rate
        for margin in margins:
            goal = np.bincount(margin, size) * scale
            now = np.bincount(margin, np.rint(rate * size), len(goal))
            rate = rate * np.divide(goal, now, out=np.ones_like(goal), where=now > 0)[margin]
        further, least, amount = np.ones_like(of), np.zeros_like(of), np.rint(rate * size)
        for _ in range(PASSES):
            level = further
            capped = rate * level[source] >= most
            held = np.bincount(source[capped], size[capped], len(want))
            rest = np.bincount(source[~capped], amount[~capped], len(want))
            least = further = next_level(level, least, want, cap, full, held, rest)
            if (further == level).all():
                break
        rate = np.where(full[source], most, np.minimum(rate * level[source], most))
        if (np.abs(rate - before) <= mean * SETTLED).all():
            break
    return rate


def wanted_tokens(shares: np.ndarray, most: np.ndarray, total: float | None) -> np.ndarray:
    """Tokens to take of each source, given its share and the most it can give.

    Without ``total``, the largest mix in which every source that has documents
    meets its share. With it, a mix of that size whose short sources give all
    they may and whose others keep their proportions.
    """
    able = (most > 0) & (shares > 0)
    if not able.any():
        return np.zeros_like(shares)
    s = np.where(able, shares, 0.0)
    s = s / s.sum()
    if total is None:
        return s * float((most[able] / s[able]).min())
    total = min(total, float(most[able].sum()))
    low, high = 0.0, float((most[able] / s[able]).max())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(most, s * mid).sum() < total else (low, mid)
    return np.minimum(most, s * high)


def _uniform(mix: Column, ident: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) for each (mix, document)."""
    return F.pmod(F.xxhash64(F.lit(seed), mix, ident), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix_sources(
    df: DataFrame, targets: DataFrame, ident: str, text: str, source: str, margins: Sequence[str],
    total: float | None = None, seed: int = 7, vocabulary: str = DEFAULT_VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """A selection ``(mix_name, ident, source, tokens, repeats)`` and its report.

    ``targets`` has ``mix_name, source, weight, max_repeats``; weights are
    relative, null or negative ones count as 0. The report has one row per target:
    ``target_share`` as asked for, ``attainable_share`` after sources without
    documents are left out, ``share`` as reached, and ``tokens``, ``documents``,
    ``available_tokens``, ``max_repeats``. Documents with no token, a null id or a
    source no target names are not selected; a null source is never a target.
    Repeated documents each count. Empty tables give an empty selection.
    """
    spark = df.sparkSession
    plan = targets.select("mix_name", "source", "weight", "max_repeats").filter("mix_name is not null and source is not null")
    rows = plan.groupBy("mix_name", "source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    rows = rows.orderBy("mix_name", "source").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"a plan may have {MAX_TARGETS} targets")
    sizes = sizes_by_tokens(df, ident, text, source, margins, vocabulary)
    sizes = durable(sizes.filter(F.col("source").isin(sorted({r["source"] for r in rows}))))
    names = [f"m{i}" for i in range(len(margins))]
    # one row per cell that has documents, of every value of the margins
    cells = durable(sizes.groupBy("source", *names).agg(F.sum("tokens").alias("tokens")))
    # a row per target at most
    have = {r["source"]: r["tokens"] for r in cells.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}

    report = []
    for mix in dict.fromkeys(r["mix_name"] for r in rows):
        own = [r for r in rows if r["mix_name"] == mix]
        weight = np.array([max(0.0, float(r["weight"] or 0.0)) for r in own])
        cap = np.array([max(0.0, float(r["max_repeats"] or 0)) for r in own])
        available = np.array([float(have.get(r["source"], 0)) for r in own])
        target = weight / (weight.sum() or 1.0)
        want = wanted_tokens(target, cap * available, total)
        for r, t, w, a, c in zip(own, target, want, available, cap):
            report.append((mix, r["source"], float(t), float(w / (want.sum() or 1.0)), float(w), int(a), r["max_repeats"], int(c)))
    report_table = spark.createDataFrame(
        report,
        "mix_name string, source string, target_share double, attainable_share double, want double, "
        "available_tokens bigint, max_repeats int, cap int",
    )
    goals = report_table.select("mix_name", "source", "want", "cap")
    rates = raked_rates(cells, goals, names)
    # the rates have one row per mix and cell, without a bound: Spark broadcasts them only if they are small
    drawn = sizes.join(rates.select("mix_name", "source", *names, "rate", "cap"), ["source", *names])
    drawn = durable(drawn.select("mix_name", "source", "id", "tokens", "rate", "cap", _uniform(F.col("mix_name"), F.col("id"), seed).alias("u")))
    # a row per target at most
    chosen = drawn.join(F.broadcast(_factors(drawn, goals)), ["mix_name", "source"])
    chosen = chosen.withColumn("repeats", _repeats(F.col("factor"))).filter("repeats > 0")
    chosen = chosen.select("mix_name", F.col("id").alias(ident), "source", "tokens", "repeats")

    got = chosen.groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents")
    )
    got = report_table.drop("cap").join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents"])
    whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("whole"))
    shares = got.join(whole, "mix_name").select(
        "mix_name", "source", "target_share", "attainable_share",
        F.coalesce(F.try_divide(F.col("tokens"), F.col("whole")), F.lit(0.0)).alias("share"),
        "tokens", "documents", "available_tokens", "max_repeats",
    )
    return chosen, shares


def _repeats(factor: Column) -> Column:
    return F.least(F.col("cap"), F.floor(F.col("rate") * factor + F.col("u")).cast("int"))


def raked_rates(cells: DataFrame, goals: DataFrame, margins: Sequence[str], at_once: int = CELLS_AT_ONCE) -> DataFrame:
    """``cells`` (source, margins, tokens) of every mix of ``goals`` (mix_name, source, want, cap), with their ``rate``.

    Up to ``at_once`` cells one task of an executor rakes a mix; more are raked by
    aggregates, in which a mix, source or value of a margin of any size is summed
    before it is shuffled. Both take the same steps and give the same rates.
    """
    # goals have a row per target at most
    own = durable(cells.join(F.broadcast(goals), "source"))
    if own.count() <= at_once:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
        return durable(own.groupBy("mix_name").applyInPandas(_rake_mix(list(margins)), f"{fields}, rate double").filter("rate > 0"))
    return _raked_by_aggregates(own, margins)


def _rake_mix(margins: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", *margins])
        names = pdf["source"].astype("category").cat
        want, cap = (pdf.groupby("source", sort=True)[c].first().to_numpy(float) for c in ("want", "cap"))
        codes = [pdf[m].astype("category").cat.codes.to_numpy() for m in margins]
        return pdf.assign(rate=rake(pdf["tokens"].to_numpy(float), names.codes.to_numpy(), codes, want, cap))

    return run


def _raked_by_aggregates(own: DataFrame, margins: Sequence[str]) -> DataFrame:
    """The steps of ``rake``, each an aggregate of all cells joined back to them; the driver sees a row per target."""
    spark, key = own.sparkSession, ["mix_name", "source"]
    found = own.groupBy(*key).agg(F.sum("tokens").alias("of"), F.first("want").alias("want"), F.first("cap").alias("cap"))
    targets = found.toPandas().astype({"of": float, "want": float, "cap": float})
    mixes = targets.groupby("mix_name")
    total = mixes["want"].transform(math.fsum)
    targets["grain"] = total.map(grain_of)
    targets["scale"] = total / targets["grain"] / (mixes["of"].transform("sum") / targets["grain"])
    targets["mean"], targets["full"] = targets["want"] / targets["of"], gives_all(targets["want"], targets["cap"], targets["of"])
    targets["want"] /= targets["grain"]

    def with_targets(df: DataFrame, rows: pd.DataFrame, *columns: str) -> DataFrame:
        types = ", ".join(f"{c} {'boolean' if c == 'full' else 'double'}" for c in columns)
        table = spark.createDataFrame(rows[[*key, *columns]].values.tolist(), f"mix_name string, source string, {types}")
        return df.join(F.broadcast(table), key)  # a row per target at most

    cap, raised = F.col("cap").cast("double"), F.col("rate") * F.col("level")
    amount, capped = F.rint(F.col("rate") * F.col("size")), raised >= cap
    met = F.when(F.col("full"), cap).otherwise(F.least(raised, cap))
    folder = f"{shared_dir(spark)}/rake-{uuid.uuid4().hex}"
    raked = with_targets(own, targets, "grain", "scale", "mean", "full")
    raked = raked.withColumn("size", F.col("tokens") / F.col("grain")).withColumn("rate", F.col("mean")).drop("grain")
    for sweep in range(SWEEPS):
        raked = raked.withColumn("before", F.col("rate"))
        for m in margins:
            now = raked.groupBy("mix_name", m).agg((F.sum("size") * F.max("scale")).alias("goal"), F.sum(amount).alias("now"))
            now = now.select("mix_name", m, F.coalesce(F.try_divide("goal", "now"), F.lit(1.0)).alias("factor"))
            raked = raked.join(now, ["mix_name", m]).withColumn("rate", F.col("rate") * F.col("factor")).drop("factor")
        # a written table, not a checkpoint, which would carry the estimates of all sweeps' joins along
        raked.write.mode("overwrite").parquet(f"{folder}/{sweep % 2}")
        raked = spark.read.parquet(f"{folder}/{sweep % 2}")
        further, least = np.ones(len(targets)), np.zeros(len(targets))
        for _ in range(PASSES):
            targets["level"] = further
            sums = with_targets(raked, targets, "level").groupBy(*key).agg(
                F.sum(F.when(capped, F.col("size")).otherwise(0.0)).alias("held"),
                F.sum(F.when(capped, 0.0).otherwise(amount)).alias("rest"),
                F.bool_and(F.abs(met - F.col("before")) <= F.col("mean") * SETTLED).alias("settled"),
            )
            sums = targets.merge(sums.toPandas(), on=key, validate="one_to_one")
            least = further = next_level(further, least, *(sums[c].to_numpy() for c in ("want", "cap", "full", "held", "rest")))
            if (further == targets["level"]).all():
                break
        done = sums.groupby("mix_name")["settled"].transform("all") | (sweep == SWEEPS - 1)
        if done.any():
            parts = with_targets(raked, targets[done], "level").withColumn("rate", met)
            parts.select(*own.columns, "rate").filter("rate > 0").write.mode("append").parquet(f"{folder}/done")
        if done.all():
            break
        targets = targets[~done].reset_index(drop=True)
        raked = with_targets(raked, targets, "level").withColumn("rate", met).drop("level", "before")
    rates = durable(spark.read.parquet(f"{folder}/done"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return rates


def _factors(drawn: DataFrame, goals: DataFrame) -> DataFrame:
    """``(mix_name, source, factor)``: where the sampled tokens come nearest to what is wanted.

    A document is taken a j-th time from the factor ``(j - u) / rate`` on. Tokens are
    summed by bins of these factors, and again by parts of the bin the target lies in.
    """
    key = ["mix_name", "source"]
    times = F.least(F.col("cap"), F.ceil(F.col("rate") * MOST_FACTOR + 1).cast("int"))
    jumps = drawn.filter("rate > 0 and cap > 0").select(*key, "tokens", "rate", "u", F.explode(F.sequence(F.lit(1), times)).alias("j"))
    place = (F.col("j") - F.col("u")) / F.col("rate") * (BINS / MOST_FACTOR)
    jumps = jumps.select(*key, "tokens", place.alias("place")).filter(F.col("place") < BINS)
    # at most BINS rows of each target
    order = Window.partitionBy(*key).orderBy("bin")
    bins = jumps.groupBy(*key, F.floor("place").alias("bin")).agg(F.sum("tokens").alias("t"))
    bins = bins.withColumn("upto", F.sum("t").over(order)).join(F.broadcast(goals.select(*key, "want")), key)
    reached = F.min(F.when(F.col("upto") >= F.col("want"), F.struct("bin", (F.col("upto") - F.col("t")).alias("base"))))
    chosen = durable(bins.groupBy(*key).agg(reached.alias("r"), F.first("want").alias("want")).select(*key, "want", "r.*"))
    inside = jumps.join(F.broadcast(chosen.withColumnRenamed("bin", "own")), key).filter(F.floor("place") == F.col("own"))
    part = F.floor((F.col("place") - F.col("own")) * BINS).alias("bin")
    parts = inside.groupBy(*key, "own", "base", "want", part).agg(F.sum("tokens").alias("t"))
    parts = parts.withColumn("upto", F.col("base") + F.sum("t").over(order))
    either = F.array(
        F.struct(F.abs(F.col("upto") - F.col("want")).alias("miss"), ((F.col("bin") + 1) / BINS + F.col("own")).alias("place")),
        F.struct(F.abs(F.col("upto") - F.col("t") - F.col("want")).alias("miss"), (F.col("bin") / BINS + F.col("own")).alias("place")),
    )
    best = parts.select(*key, F.explode(either).alias("e")).groupBy(*key).agg(F.min("e").alias("e"))
    best = best.select(*key, F.col("e.place").alias("place"))
    # a target that all repetitions together do not reach takes them all
    found = chosen.join(best, key, "left")
    return found.select(*key, (F.coalesce("place", F.lit(float(BINS))) * (MOST_FACTOR / BINS)).alias("factor"))
