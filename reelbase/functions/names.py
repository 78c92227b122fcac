"""Names, hashes and scalar rules as Column -> Column functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slot words and their labels.
SLOTS = ("left", "middle", "right")
IGNORE = -100


def parsed_repo(name: Column, identities: tuple[str, ...]) -> dict[str, Column]:
    """corpus, identity, position of <corpus>_<identity>_<position>_<n>; null where the name has another form."""
    pattern = rf"^(.+)_({'|'.join(identities)})_({'|'.join(SLOTS)})_([0-9]+)$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return {"corpus": part(1), "identity": part(2), "position": part(3)}


def repo_form(name: Column, identities: tuple[str, ...], board: str = "charuco", cut: str = "_v6_truncated") -> dict[str, Column]:
    """form, identity and position of a dataset's name in one of three forms; all null where it has none of them. Fixed values:

    v2 or v2_truncated   dataset_v2_<identity>_<position>_1, with or without ``cut``
    v3                   dataset_v3_<board>_<position>_1, no identity
    v1                   <identity>_1, no position
    """
    who, where = "|".join(identities), "|".join(SLOTS)
    v2, v3, v1 = rf"^dataset_v2_({who})_({where})_1({cut})?$", rf"^dataset_v3_{board}_({where})_1$", rf"^({who})_1$"
    part = lambda pattern, i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    form = F.when(name.rlike(v2), F.when(name.endswith(cut), "v2_truncated").otherwise("v2")).when(name.rlike(v3), "v3").when(name.rlike(v1), "v1")
    return {"form": form, "identity": F.coalesce(part(v2, 1), part(v1, 1)), "position": F.coalesce(part(v2, 2), part(v3, 1))}


def slot_of(name: Column, strict: bool = False) -> Column:
    """The slot that stands in a name as a whole word between underscores; null (or an error when strict) without."""
    slot = F.nullif(F.regexp_extract(name, rf"(?:^|_)({'|'.join(SLOTS)})(?:_|$)", 1), F.lit(""))
    return F.coalesce(slot, F.raise_error(F.concat(F.lit("no slot in "), name)).cast("string")) if strict else slot


def slot_label(slot: Column) -> Column:
    """0, 1, 2 for left, middle, right; -100 otherwise."""
    out = F.lit(IGNORE)
    for i, s in enumerate(SLOTS):
        out = F.when(slot == s, i).otherwise(out)
    return out


def stable_hash(text: Column) -> Column:
    """The first four bytes of the md5, little-endian: 0 .. 2^32 - 1."""
    h = F.md5(text)
    return F.conv(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("long")


def chance(text: Column, p: float) -> Column:
    return stable_hash(text) / F.lit(4294967295.0) < p


def padded_vector(values: Column, size: int = 7) -> Column:
    """Zero-padded to ``size``; an error when it is longer."""
    return F.when(F.size(values) > size, F.raise_error(F.lit("vector too long")).cast("array<double>")).otherwise(F.concat(values, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(values))))


def normalised(x: Column, low: Column, high: Column, clip: bool = True) -> Column:
    """To [-1, 1] by two quantiles; 0 where they coincide."""
    y = F.when(high > low, 2 * (x - low) / (high - low) - 1).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y)) if clip else y


def denormalised(y: Column, low: Column, high: Column) -> Column:
    return (y + 1) / 2 * (high - low) + low


def edges(bins: int = 256) -> list[float]:
    return np.linspace(-1, 1, bins).tolist()


def binned(x: Column, bins: int = 256) -> Column:
    """How many of ``bins`` even edges of [-1, 1] a clipped value reaches, by the exact edges."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return F.size(F.filter(F.array(*map(F.lit, edges(bins))), lambda e: e <= c))


def unbinned(index: Column, bins: int = 256) -> Column:
    """The centre of a bin of :func:`binned`; indexes outside take the nearest bin."""
    e = edges(bins)
    centres = F.array(*[F.lit((a + b) / 2) for a, b in zip(e[:-1], e[1:], strict=True)])
    return F.element_at(centres, F.greatest(F.lit(1), F.least(F.lit(bins - 1), index.cast("int"))))


def color_factor(saturation: Column) -> Column:
    """0.5 below 30, 1 above 60, linear between."""
    return F.when(saturation <= 30, 0.5).when(saturation >= 60, 1.0).otherwise(0.5 + 0.5 * (saturation - 30) / 30.0)


def ramp_down(x: Column, fail: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - x / fail))


def ramp_up(x: Column, target: float) -> Column:
    """x / target held to [0, 1]; 0 where the target is not positive."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / target)) if target > 0 else F.lit(0.0)


def three_way(x: Column, threshold: float = 12.0) -> Column:
    return F.when(x > threshold, "left").when(x < -threshold, "right").otherwise("middle")


def gate(x: Column, passing: float, weak: float = 5.0) -> Column:
    return F.when(x >= passing, "PASS").when(x >= weak, "WEAK").otherwise("FAIL")


def cosine_decay(step: Column, total: float, start: float, end: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), step / total))
    return end + (start - end) * 0.5 * (1 + F.cos(t * 3.141592653589793))


def nearest(x: Column, centroids: dict[str, float]) -> Column:
    """The label of the nearest centroid; of equals the first listed."""
    best = label = None
    for name, c in centroids.items():
        d = F.abs(x - F.lit(float(c)))
        label = F.lit(name) if label is None else F.when(d < best, name).otherwise(label)
        best = d if best is None else F.least(best, d)
    return label


def slug(name: Column) -> Column:
    """Runs of other than ASCII letters and digits become one underscore; trimmed; lower case."""
    return F.lower(F.trim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_")))
