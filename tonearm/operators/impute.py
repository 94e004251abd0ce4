"""Filling missing values from rows of the same group, level or time.

Numbers follow a mixed-effects model: grand mean + level effect (genre) +
period effect (time) + group effect (artist), each a random effect shrunk
towards zero by the ratio of its noise to its own variance. Variances are
estimated by the method of moments from counts, sums and sums of squares alone,
so everything is a partial aggregate followed by a small shuffle, and a group of
any size costs one record per map task.

Categories follow a multinomial model: the group's counts with a Dirichlet prior
at the overall shares, weighted by how much the period favours each category.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions.missing import number_or_null
from tonearm.operators.skew import attach
from tonearm.session import durable

#: Category values that mean "not known" once trimmed and in lower case.
UNKNOWN = ("", "unknown", "n/a", "na", "none", "null", "-", "?")
_EDGE_SPACE = r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$"


@dataclass(frozen=True)
class Field:
    """A numeric field to fill: its possible range and the decimals of its values."""

    name: str
    low: float
    high: float
    decimals: int = 3


def known_name(c: Column) -> Column:
    """A name without outer white space, in lower case; null where it says nothing."""
    trimmed = F.lower(F.regexp_replace(c, _EDGE_SPACE, ""))
    return F.when(~trimmed.isin(*UNKNOWN), trimmed)


def quarter_index(ts: Column) -> Column:
    return (F.year(ts) * 4 + F.quarter(ts)).cast("int")


def _stats(fields: Sequence[Field], offset: str | None = None) -> list[Column]:
    """n, sum and sum of squares of each field's residual against its offset column."""
    out = []
    for f in fields:
        y = F.col(f.name) - F.col(f"{offset}_{f.name}") if offset else F.col(f.name)
        out += [F.count(y).alias(f"n_{f.name}"), F.sum(y).alias(f"s_{f.name}"), F.sum(y * y).alias(f"q_{f.name}")]
    return out


def _shrunk(stats: DataFrame, key: str, fields: Sequence[Field], prefix: str) -> DataFrame:
    """Effects ``<prefix>_<field>`` per key from residual stats, shrunk by method-of-moments variances."""
    have = stats.filter(F.col(key).isNotNull())
    asks = []
    for f in fields:
        n, s, q = (F.col(f"{x}_{f.name}") for x in "nsq")
        mean = F.try_divide(s, n)
        asks += [
            F.count_if(n > 0).alias(f"k_{f.name}"),
            F.sum(n).alias(f"N_{f.name}"),
            F.sum(n * n).alias(f"N2_{f.name}"),
            F.sum(s).alias(f"S_{f.name}"),
            F.sum(n * mean * mean).alias(f"B_{f.name}"),
            F.sum(q).alias(f"Q_{f.name}"),
        ]
    got = have.agg(*asks).first()
    effects = []
    for f in fields:
        k, n, n2, s, b, q = (float(got[f"{x}_{f.name}"] or 0) for x in ("k", "N", "N2", "S", "B", "Q"))
        ratio = float("inf")
        if k > 1 and n > k:
            noise = max((q - b) / (n - k), 1e-9)
            between = (b - s * s / n) / (k - 1)
            evenness = (n - n2 / n) / (k - 1)
            own = (between - noise) / evenness if evenness > 0 else 0.0
            ratio = noise / own if own > 0 else float("inf")
        if ratio == float("inf"):
            effect = F.lit(0.0)
        else:
            effect = F.coalesce(F.col(f"s_{f.name}") / (F.col(f"n_{f.name}") + F.lit(ratio)), F.lit(0.0))
        effects.append(effect.alias(f"{prefix}_{f.name}"))
    return have.select(key, "rows", *effects)


def fill_numbers(
    df: DataFrame, ident: str, group: str, level: str, when: str, fields: Sequence[Field]
) -> DataFrame:
    """``(ident, <field>, <field>_filled ...)``: every row, its missing numbers predicted, and a mask for each.

    A value is missing if it is null, NaN or outside its range. Null, blank or
    unknown groups and levels, and null times, contribute and receive no effect;
    a row with none of the three gets the grand mean. If a field has no usable
    value in the whole table, the middle of its range is used. Repeated rows count
    each; an empty table gives an empty result. Other columns are not read.
    """
    rows = df.select(
        F.col(ident),
        known_name(F.col(group)).alias("__group"),
        known_name(F.col(level)).alias("__level"),
        quarter_index(F.col(when)).alias("__period"),
        *[number_or_null(F.col(f.name).cast("double"), f.low, f.high).alias(f.name) for f in fields],
    )
    count = F.count("*").alias("rows")
    cells = durable(rows.groupBy("__level", "__period").agg(count, *_stats(fields)))
    whole = cells.agg(
        F.sum("rows").alias("rows"), *[F.sum(f"{x}_{f.name}").alias(f"{x}_{f.name}") for f in fields for x in "ns"]
    ).first()
    total = int(whole["rows"] or 0)
    mean = {
        f.name: whole[f"s_{f.name}"] / whole[f"n_{f.name}"] if whole[f"n_{f.name}"] else (f.low + f.high) / 2
        for f in fields
    }

    def resum(cell: DataFrame, key: str, offsets: Mapping[str, Column]) -> DataFrame:
        """Residual stats by key from cell stats, each cell's offset being constant."""
        asks = [F.sum("rows").alias("rows")]
        for f in fields:
            n, s, q, c = F.col(f"n_{f.name}"), F.col(f"s_{f.name}"), F.col(f"q_{f.name}"), offsets[f.name]
            asks += [
                F.sum(n).alias(f"n_{f.name}"),
                F.sum(s - n * c).alias(f"s_{f.name}"),
                F.sum(q - c * s * 2 + n * c * c).alias(f"q_{f.name}"),
            ]
        return cell.groupBy(key).agg(*asks)

    levels = durable(_shrunk(durable(resum(cells, "__level", {k: F.lit(v) for k, v in mean.items()})), "__level", fields, "l"))
    joined = attach(cells, levels.withColumnRenamed("rows", "size"), "__level", "size", total, "__period")
    offsets = {f.name: F.lit(mean[f.name]) + F.coalesce(f"l_{f.name}", F.lit(0.0)) for f in fields}
    periods = durable(_shrunk(durable(resum(joined, "__period", offsets)), "__period", fields, "p"))

    placed = attach(rows, levels.withColumnRenamed("rows", "lsize"), "__level", "lsize", total, ident)
    placed = attach(placed, periods.withColumnRenamed("rows", "psize"), "__period", "psize", total, ident)
    base = [
        (F.lit(mean[f.name]) + F.coalesce(f"l_{f.name}", F.lit(0.0)) + F.coalesce(f"p_{f.name}", F.lit(0.0))).alias(f"c_{f.name}")
        for f in fields
    ]
    names = [f.name for f in fields]
    placed = placed.select(ident, "__group", *names, *base)
    by_group = durable(placed.filter("__group is not null").groupBy("__group").agg(count, *_stats(fields, "c")))
    groups = durable(_shrunk(by_group, "__group", fields, "g"))
    done = attach(placed, groups.withColumnRenamed("rows", "gsize"), "__group", "gsize", total, ident)
    out = [F.col(ident)]
    for f in fields:
        guess = F.col(f"c_{f.name}") + F.coalesce(f"g_{f.name}", F.lit(0.0))
        guess = F.round(F.greatest(F.lit(f.low), F.least(F.lit(f.high), guess)), f.decimals)
        out += [F.coalesce(f.name, guess).alias(f.name), F.col(f.name).isNull().alias(f"{f.name}_filled")]
    return done.select(*out)


def _concentration(match: float, base: float) -> float:
    """Dirichlet concentration at which two draws of one source agree with probability ``match``."""
    return min(max((1 - match) / max(match - base, 1e-6), 1e-3), 1e6)


def fill_category(df: DataFrame, ident: str, group: str, category: str, when: str) -> DataFrame:
    """``(ident, <category>, <category>_filled)``: the most probable category where it is missing.

    Missing means null, blank or a word for "unknown". Known values keep their
    writing; filled ones are in lower case. Ties go to the smaller name. If the
    table holds no known category, missing ones stay null and are not marked.
    """
    rows = df.select(
        F.col(ident),
        F.col(category).alias("__written"),
        known_name(F.col(category)).alias("__cat"),
        known_name(F.col(group)).alias("__group"),
        F.coalesce(quarter_index(F.col(when)), F.lit(-1)).alias("__period"),
    )
    known = rows.filter("__cat is not null")
    by_group = durable(known.filter("__group is not null").groupBy("__group", "__cat").agg(F.count("*").alias("n")))
    by_period = durable(known.groupBy("__period", "__cat").agg(F.count("*").alias("m")))
    shares = by_period.groupBy("__cat").agg(F.sum("m").alias("all"))
    figures = shares.agg(F.sum("all").alias("t"), F.sum(F.col("all").cast("double") * F.col("all")).alias("s")).first()
    total = float(figures["t"] or 0)
    base = float(figures["s"] or 0) / (total * total) if total else 1.0

    def match(counts: DataFrame, key: str, n: str) -> float:
        sizes = counts.groupBy(key).agg(F.sum(n).cast("double").alias("t"), F.sum(F.col(n).cast("double") * F.col(n)).alias("q"))
        row = sizes.agg(F.sum(F.col("q") - F.col("t")).alias("same"), F.sum(F.col("t") * (F.col("t") - 1)).alias("pairs")).first()
        return float(row["same"] or 0) / float(row["pairs"]) if row["pairs"] else base

    kg, kp = _concentration(match(by_group, "__group", "n"), base), _concentration(match(by_period, "__period", "m"), base)
    share = F.col("all") / F.lit(total or 1.0)
    in_period = by_period.groupBy("__period").agg(F.sum("m").alias("of"))
    lifts = durable(
        by_period.join(shares, "__cat").join(in_period, "__period").select(
            "__period", "__cat", share.alias("share"),
            F.log((F.col("m") + F.lit(kp) * share) / ((F.col("of") + F.lit(kp)) * share)).alias("lift"),
        )
    )
    prior = F.log(F.lit(kg) * F.col("share")) + F.col("lift")
    best = F.struct((-F.col("score")).alias("s"), F.col("__cat").alias("c"))
    usual = lifts.withColumn("score", prior).groupBy("__period").agg(F.min(best).alias("u"))
    overall = shares.select((-F.col("all")).alias("s"), F.col("__cat").alias("c")).agg(F.min(F.struct("s", "c")).alias("o"))
    first = overall.first()["o"]
    fallback = F.lit(first["c"] if first else None)

    wanted = rows.filter("__cat is null")
    asked = wanted.filter("__group is not null").groupBy("__group", "__period").agg(F.count("*").alias("size"))
    scored = asked.join(by_group, "__group").join(shares, "__cat").join(lifts.select("__period", "__cat", "lift"), ["__period", "__cat"], "left")
    # a category the period has never seen is judged by the period's prior alone
    unseen = in_period.select("__period", F.log(F.lit(kp) / (F.col("of") + F.lit(kp))).alias("none"))
    scored = scored.join(unseen, "__period", "left").withColumn(
        "score", F.log(F.col("n") + F.lit(kg) * share) + F.coalesce("lift", "none", F.lit(0.0))
    )
    own = scored.groupBy("__group", "__period", "size").agg(F.min(best).alias("b"))
    key = F.to_json(F.struct("__group", "__period"))
    own = durable(own.join(usual, "__period", "left").select(
        key.alias("__key"), "size", F.when(F.col("u.s") < F.col("b.s"), F.col("u.c")).otherwise(F.col("b.c")).alias("mine")
    ))
    rows = rows.withColumn("__key", F.when(F.col("__cat").isNull() & F.col("__group").isNotNull(), key))
    asked_total = wanted.count()
    done = attach(rows, own, "__key", "size", asked_total, ident)
    usual = durable(usual.join(in_period, "__period").select("__period", F.col("u.c").alias("common"), F.col("of").alias("psize")))
    done = attach(done, usual, "__period", "psize", int(total), ident)
    guess = F.coalesce("mine", "common", fallback)
    missing = F.col("__cat").isNull()
    return done.select(
        ident,
        F.when(missing, guess).otherwise(F.col("__written")).alias(category),
        (missing & guess.isNotNull()).alias(f"{category}_filled"),
    )
