"""Joining rows to one record per key when some keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds at least this share of the rows, so at most
#: ``1 / HEAVY`` keys are heavy, and of smaller tables at most ``SMALL``: that bounds what is broadcast.
HEAVY, SMALL = 1 / 5_000, 10_000


def attach(left: DataFrame, right: DataFrame, key: str, size: str, total: int, spread: str) -> DataFrame:
    """Left outer join of ``left`` to ``right``, which has one row per ``key``.

    ``size`` is a column of ``right``: how many of the ``total`` rows its key
    holds. Heavy keys are broadcast: at most 5,000 of a table of ``SMALL`` rows or
    more, and all keys of a smaller one, which has fewer than ``SMALL``; their rows
    never move by key. All other keys join by a shuffle in which the rows of
    heavy and null keys are scattered by a hash of ``spread``, so no task gets
    more than its share. Null keys match nothing. ``right`` should be cheap to
    read: it is looked at once to see whether the shuffle is needed at all.
    """
    fields = [c for c in right.columns if c != key]
    packed = right.filter(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.struct(*fields).alias("__r"))
    big = F.col(f"__r.{size}") >= F.lit(max(1, int(total * HEAVY)))
    heavy = packed.filter(big).withColumnsRenamed({"__k": "__hk", "__r": "__h"})
    light = packed.filter(~big).withColumnRenamed("__r", "__l")
    none_light = light.isEmpty()
    out = left.join(F.broadcast(heavy), left[key] == heavy["__hk"], "left")
    if none_light:
        return out.select(*[left[c] for c in left.columns], *[F.col(f"__h.{c}").alias(c) for c in fields])
    scatter = F.when(F.col("__hk").isNotNull() | F.col(key).isNull(), F.xxhash64(spread)).otherwise(F.lit(0))
    out = out.withColumn("__salt", scatter)
    light = light.withColumn("__lsalt", F.lit(0).cast("bigint"))
    out = out.join(light, (out[key] == light["__k"]) & (out["__salt"] == light["__lsalt"]), "left")
    found = [F.coalesce(F.col(f"__h.{c}"), F.col(f"__l.{c}")).alias(c) for c in fields]
    return out.select(*[left[c] for c in left.columns], *found)
