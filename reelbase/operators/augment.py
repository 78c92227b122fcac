"""Row augmentation as deterministic columns: every draw is a hash of a tag and a row's key, so a row gets the same one wherever and whenever it is read."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelbase.functions.names import stable_hash


def uniform(tag: str, key: Column) -> Column:
    """A draw from (0, 1)."""
    return (stable_hash(F.concat(F.lit(f"{tag}:"), key.cast("string"))) + 0.5) / F.lit(4294967296.0)


def normal(tag: str, key: Column) -> Column:
    """A draw from the standard normal distribution, by two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(f"{tag}0", key))) * F.cos(2 * math.pi * uniform(f"{tag}1", key))


def rewritten_task(task: Column, name: Column, canonical: list[tuple[str, float]], variants: list[str], p: float, key: Column) -> Column:
    """With probability ``p`` a canonical wording by its weight, else one of the variants evenly; a row without a known name keeps its task."""
    v, at, chosen = uniform("v", key), 1.0, None
    for text, weight in reversed(canonical):
        at -= weight
        chosen = F.lit(text) if chosen is None else F.when(v < weight, text).otherwise(chosen)
    other = F.element_at(F.array(*map(F.lit, variants)), F.floor(v * len(variants)).cast("int") + 1)
    wording = F.when(uniform("p", key) < p, chosen).otherwise(other)
    return F.when(name.isNull(), task).otherwise(F.concat(wording, name))


def by_mode(mode: str, raw: Column, canonical: Column, key: Column) -> Column:
    """raw, canonical, or mixed: each with probability one half."""
    if mode == "mixed":
        return F.when(uniform("m", key) < 0.5, canonical).otherwise(raw)
    return raw if mode == "raw" else canonical


def replaced(value: Column, p: float, home: float, jitter: float, home_share: float, key: Column) -> Column:
    """With probability ``p`` the home pose plus jitter (a share ``home_share`` of those rows) or zero."""
    other = F.when(uniform("w", key) < home_share, home + normal("n", key) * jitter).otherwise(0.0)
    return F.when(uniform("r", key) < p, other).otherwise(value)


def drawn(weights: dict[str, float], most: int, key: Column) -> Column:
    """Up to ``most`` of the names, drawn by weight without replacement, in the order drawn: those with the least -ln(u) / weight."""
    ranks = F.array(*[F.struct((-F.log(uniform(f"t{n}", key)) / w).alias("k"), F.lit(n).alias("n")) for n, w in weights.items()])
    return F.transform(F.slice(F.array_sort(ranks), 1, most), lambda r: r["n"])
