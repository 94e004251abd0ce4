"""Text functions as column expressions; white space is Unicode white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def normalized_title(c: Column) -> Column:
    """Lower case, without ``(...)`` and ``[...]`` (not nested), spaces collapsed; null gives ``""``."""
    low = strip(F.lower(c))
    bare = F.regexp_replace(F.regexp_replace(low, r"\([^)]*\)", ""), r"\[[^\]]*\]", "")
    return F.coalesce(strip(F.regexp_replace(bare, rf"(?U){_SPACE}+", " ")), F.lit(""))


def is_remix(c: Column) -> Column:
    """Contains " remix" in any case, the leading space included; null does not."""
    return F.coalesce(F.lower(c).contains(" remix"), F.lit(False))


def contains_ignoring_case(c: Column, q: str) -> Column:
    """Literal substring in any case; an empty ``q`` is in everything but null."""
    return F.lower(c).contains(q.lower())


def id_from_url(c: Column, host: str) -> Column:
    """The last path segment without parameters, where the text names ``host``; else the text itself."""
    last = F.element_at(F.split(c, "/"), -1)
    return F.when(c.contains(host), F.element_at(F.split(last, r"\?"), 1)).otherwise(c)


def known_or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def shortened(c: Column, n: int) -> Column:
    """At most ``n`` characters, then an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def parse_assignments(text: str) -> dict[str, str]:
    """``A=g, B=g2`` as a dict; parts without ``=`` are ignored, the last of repeated names wins."""
    pairs = (part.split("=", 1) for part in text.split(",") if "=" in part)
    return {a.strip(): g.strip().lower() for a, g in pairs}


def parse_ordinals(text: str, n: int) -> list[int]:
    """``1-3,7`` as ordinals from 1, in order; those beyond ``n`` are dropped, malformed text means all."""
    every = list(range(1, n + 1))
    try:
        chosen: list[int] = []
        for part in text.replace(" ", "").split(","):
            low, dash, high = part.partition("-")
            chosen += range(max(1, int(low)), min(n, int(high if dash else low)) + 1)
    except ValueError:
        return every
    return chosen or every


def best_genre_match(wanted: str, genres: list[str]) -> str | None:
    """The genre itself, or the only one that contains it; null if none or several do."""
    if wanted in genres:
        return wanted
    hits = [g for g in genres if wanted in g]
    return hits[0] if len(hits) == 1 else None
