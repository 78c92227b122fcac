"""Texts: slugs, display names, instructions and file names as Column -> Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbase.functions.names import color_factor
from pyspark.sql.types import StringType

from reelbase.functions.names import slug

#: Texts that compatibility decomposition leaves as they are.
PLAIN = "^[\\x00-\\x7F]*$"


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def ascii_folded(text: Column) -> Column:
    """NFKD decomposition without what is not ASCII. Spark has no NFKD, so this is an Arrow function; :func:`ascii_slug` sends it only the distinct texts
    that need it."""
    return _folded(text)


def with_ascii_slug(df: DataFrame, column: str, name: str = "slug") -> DataFrame:
    """Adds ``name``: folded to ASCII, other than letters and digits to one underscore, trimmed, lower case. Texts that are ASCII already, which are most,
    stay in the JVM."""
    plain = F.coalesce(F.col(column).rlike(PLAIN), F.lit(True))
    ready = df.where(plain).withColumn(name, slug(F.col(column)))
    return ready.unionByName(df.where(~plain).withColumn(name, slug(ascii_folded(F.col(column)))))


def display_name(name: Column, overrides: dict[str, str]) -> Column:
    """An override, else in title case if all of it is lower case (a letter after any other sign is large), else as it is."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    title = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")
    out = F.when(name == F.lower(name), title).otherwise(name)
    for k, v in overrides.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def normalised_instruction(text: Column, canonical: list[str], legacy: dict[str, str], pattern: str, template: str, aliases: dict[str, str]) -> dict[str, Column]:
    """raw, normalised, changed, matched. After collapsing white space, in this order: already canonical; a legacy wording; ``pattern``, whose first group,
    lower-cased, names an alias (exactly, or as the first alias that it is a part of), put into ``template`` for {name}. Else unmatched and as collapsed."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    known = flat.isin(canonical)
    old = F.lit(None).cast("string")
    for k, v in legacy.items():
        old = F.when(flat == k, v).otherwise(old)
    said = F.lower(F.trim(F.regexp_extract(flat, pattern, 1)))
    exact = part = F.lit(None).cast("string")
    for k, v in reversed(list(aliases.items())):
        exact = F.when(said == k, v).otherwise(exact)
        part = F.when((F.length(said) >= 3) & F.lit(k).contains(said), v).otherwise(part)
    name = F.coalesce(exact, part)
    filled = F.replace(F.lit(template), F.lit("{name}"), name)
    out = F.when(known, flat).otherwise(F.coalesce(old, F.when(said != "", filled), flat))
    matched = known | old.isNotNull() | (F.coalesce(said != "", F.lit(False)) & name.isNotNull())
    return {"raw": text, "normalised": out, "changed": out != F.when(known, flat).otherwise(text), "matched": matched}


def filled(template: str, name: Column, mark: str = "{name}") -> Column:
    return F.replace(F.lit(template), F.lit(mark), name)


def contains_all(tasks: Column, names: list[str]) -> Column:
    """Whether each name stands in some task, whatever its case."""
    joined = F.lower(F.array_join(tasks, "\n"))
    out = F.lit(True)
    for n in names:
        out = out & joined.contains(n.lower())
    return out


def contains_none(tasks: Column, names: list[str]) -> Column:
    joined = F.lower(F.array_join(tasks, "\n"))
    out = F.lit(True)
    for n in names:
        out = out & ~joined.contains(n.lower())
    return out


def last_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def output_name(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), *parts)


def encoded_path(path: Column) -> Column:
    """Each piece of a path percent-encoded, the slashes kept."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def extension(url: Column) -> Column:
    """The extension of a url's last path part, lower-cased, without query; jpg where there is none."""
    found = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.([A-Za-z0-9]{2,5})$", 1))
    return F.when(found == "", "jpg").otherwise(found)


def suggestion(text: Column, canonical: list[str]) -> dict[str, Column]:
    """verdict (PASS for a canonical text, WARN where the first canonical one that is contained can replace it, else FAIL) and that replacement."""
    found = F.lit(None).cast("string")
    for c in reversed(canonical):
        found = F.when(F.lower(text).contains(c.lower()), c).otherwise(found)
    verdict = F.when(text.isin(canonical), "PASS").when(found.isNotNull(), "WARN").otherwise("FAIL")
    return {"verdict": verdict, "suggested": F.when(~text.isin(canonical), found)}


def joint_index(names: Column, wanted: str, fallback: int) -> Column:
    """Place of a joint among names, from 0, whatever the case and a ``.pos`` at the end; else ``fallback``."""
    at = F.array_position(F.transform(names, lambda n: F.regexp_replace(F.lower(n), r"\.pos$", "")), wanted.lower())
    return F.when(at > 0, at - 1).otherwise(fallback)


def mapped_joints(vector: Column, rules: list[tuple[int, float, float, float, float, float]]) -> Column:
    """Per rule (source, scale, offset, low, high, gain): the scaled source held to the limits, then times the gain."""
    return F.array(*[F.greatest(F.lit(lo), F.least(F.lit(hi), F.element_at(vector, src + 1) * scale + offset)) * gain for src, scale, offset, lo, hi, gain in rules])


def identity_of(name: Column, table: dict[str, str], slugs: list[str]) -> Column:
    """The table's identity for a name, else the longest known slug that it contains (of equals the first listed)."""
    out = F.lit(None).cast("string")
    for s in sorted(reversed(slugs), key=len):
        out = F.when(name.contains(s), s).otherwise(out)
    for k, v in table.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def slot_variants(name: Column) -> dict[str, Column]:
    """The three rules by which names carry a slot: an inner or last part of the basename; also before a last ``_full``; any whole part."""
    base = last_part(name)
    rule = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return {
        "by_suffix": rule(base, "_(left|middle|right)(?:_|$)"),
        "by_full": rule(name, "_(left|middle|right)(?:_full)?$"),
        "by_word": rule(base, "(?:^|_)(left|middle|right)(?:_|$)"),
    }


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def argmax(values: Column) -> Column:
    """The first place of the largest value, from 0."""
    return F.array_position(values, F.array_max(values)) - 1


def cache_key(*parameters: Column) -> Column:
    """The first 16 hex digits of the sha256 over the parameters."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parameters]), 256), 1, 16)


def box_area(box: Column) -> Column:
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])


def merged_boxes(boxes: Column) -> Column:
    """Boxes (x0, y0, x1, y1) in their order. A box that overlaps a kept one by more than half of the smaller area is merged with the first such: the larger of the two stays in its
    place, the kept one of equals. Others are kept too, after it. What comes out depends on the order, and kept boxes may overlap each other."""

    def shared(a, b):
        w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
        h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
        return w * h

    def add(kept, b):
        meets = F.transform(kept, lambda k: F.coalesce(shared(k, b) / F.nullif(F.least(box_area(k), box_area(b)), F.lit(0.0)) > 0.5, F.lit(False)))
        first = F.array_position(meets, True)
        swapped = F.transform(kept, lambda k, i: F.when((i + 1 == first) & (box_area(b) > box_area(k)), b).otherwise(k))
        return F.when(first == 0, F.concat(kept, F.array(b))).otherwise(swapped)

    return F.aggregate(boxes, F.expr("cast(array() as array<struct<x0: double, y0: double, x1: double, y1: double>>)"), add)


def largest_box(boxes: Column) -> Column:
    """The first box of the largest area; null without boxes."""
    areas = F.transform(boxes, box_area)
    return F.get(boxes, F.array_position(areas, F.array_max(areas)).cast("int") - 1)


def dominance(boxes: Column) -> Column:
    """The area of the largest box over that of all, at least 1 being taken for all."""
    areas = F.transform(boxes, box_area)
    return F.array_max(areas) / F.greatest(F.aggregate(areas, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))


def centred(box: Column, width: Column) -> Column:
    """Whether the middle of a box is no further than 30 % of the picture's width from the middle of that."""
    return F.abs((box["x0"] + box["x1"]) / 2 - width / 2.0) <= 0.30 * width


def photo_score(boxes: Column, width: Column, height: Column, saturation: Column) -> Column:
    """Share of the largest box (100 at most), long edge from 300 to 700 (100 at most), 10 if the picture is no wider than high, 10 if the box is centred; times the
    colour factor."""
    box = largest_box(boxes)
    share = F.least(box_area(box) / (width * height), F.lit(1.0)) * 100
    edge = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.greatest(width, height) - 300) / 400.0)) * 100
    return (share + edge + F.when(height / width >= 1, 10).otherwise(0) + F.when(centred(box, width), 10).otherwise(0)) * color_factor(saturation)
