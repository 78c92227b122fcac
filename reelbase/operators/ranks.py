"""Positions inside groups and exact quantiles of groups of any size: rows are dealt by ranges of group and order, so a group that holds most of a table is many tasks.

Bounds of the ranges are drawn by hash from the rows themselves, some thirty times as many as are used, and those that lie evenly are kept: ranges then differ little in size, and the
same rows give the same ranges however they are dealt. Only groups that a bound cuts need what came before a range, so what is sent to all tasks is a row for each range at most.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType, IntegerType, LongType, StringType, TimestampNTZType, TimestampType

from reelbase.sources.storage import written_once

RANGES, DRAWN = 128, 32
SMALL = 4096  # rows that one task may sort without more ado
FEW = 500_000  # distinct values, counted before, of which the same holds


def spread_bounds(rows: DataFrame, keys: list[str], ranges: int = RANGES, small: int = SMALL) -> list[tuple]:
    """At most ``ranges`` - 1 key tuples that cut the rows into ranges of about equal size; of a small table, all of whose rows are drawn, so few that a range has ``small``
    rows. At most 32 tuples a range come to the driver."""
    sample = rows.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(ranges * DRAWN)
    drawn = [tuple(r) for r in sample.orderBy(*keys).collect()]
    if len(drawn) < ranges * DRAWN:
        ranges = min(ranges, -(-len(drawn) // small))
    picked = [drawn[len(drawn) * k // ranges] for k in range(1, ranges)] if drawn else []
    return list(dict.fromkeys(picked))


def literal(value, kind: DataType) -> str:
    """A value as SQL that folds to a constant of that type."""
    name = kind.simpleString()
    if value is None:
        return f"CAST(NULL AS {name})"
    if isinstance(kind, (LongType, IntegerType)):
        return f"{value}L" if isinstance(kind, LongType) and value > -(1 << 63) else f"CAST('{value}' AS {name})" if value == -(1 << 31) or isinstance(kind, LongType) else str(value)
    if isinstance(kind, DoubleType) and math.isfinite(value):
        return f"{value!r}D"
    if isinstance(kind, StringType) and name == "string" and re.fullmatch(r"[\w .:/#-]*", value, re.ASCII):
        return f"'{value}'"
    if isinstance(kind, BinaryType):
        return f"X'{bytes(value).hex()}'"
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        micros = (value.replace(tzinfo=None) - datetime(1970, 1, 1)) // timedelta(microseconds=1) if isinstance(kind, TimestampNTZType) else round(value.timestamp() * 1e6)
        return f"CAST(timestamp_micros({micros}L) AS {name})" if isinstance(kind, TimestampType) else f"CAST('{datetime(1970, 1, 1) + timedelta(microseconds=micros)}' AS {name})"
    return f"CAST(decode(X'{str(value).encode().hex()}', 'UTF-8') AS {name})"


def range_of(rows: DataFrame, keys: list[str], bounds: list[tuple]) -> Column:
    """Which range a row is in, rising with the keys in Spark's order (nulls first), found by halving: a row equal to a bound is in the range after it."""
    if not bounds:
        return F.lit(0)
    kinds = {k: rows.schema[k].dataType for k in keys}
    own = "struct(" + ", ".join(f"`{k.replace('`', '``')}`" for k in keys) + ")"
    cuts = ["struct(" + ", ".join(literal(v, kinds[k]) for k, v in zip(keys, bound, strict=True)) + ")" for bound in bounds]

    def place(lo: int, hi: int) -> str:
        mid = (lo + hi) // 2
        return str(lo) if lo == hi else f"if({own} < {cuts[mid]}, {place(lo, mid)}, {place(mid + 1, hi)})"

    return F.expr(place(0, len(bounds)))  # as text, for it is a hundred comparisons: they compile, and a row meets seven of them


def before_ranges(counts: DataFrame, group: list[str], values: dict[str, str] | None = None) -> DataFrame:
    """Of ``counts``, one row for each group and range ``_p``: what the group's earlier ranges hold together, of each column of ``values`` under its new name. Groups of one range are left out, so there are no
    more rows than ranges, and windows meet them only."""
    some = met(counts, counts.groupBy(*group).agg(F.count(F.lit(1)).alias("_ranges")).where("_ranges > 1").select(*group), group, "left_semi") if group else counts
    w = Window.partitionBy(*group).orderBy("_p")
    return some.select(*group, "_p", *[(F.sum(v).over(w) - F.col(v)).alias(name) for v, name in (values or {"_n": "_before"}).items()])


def met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """``a`` joined with ``b`` on equal keys, null being equal to null; the keys are those of ``a``. ``small``: ``b`` has a row for each range at most and is broadcast."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    other = b.select(*[F.col(k).alias(names[k]) if k in names else F.col(k) for k in b.columns])
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return a.join(F.broadcast(other) if small else other, on, how).drop(*names.values())


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "rank", ranges: int = RANGES) -> DataFrame:
    """Adds ``name``, the place of a row in its group, from 0: row_number() - 1 over (partition by group order by order), without a task that sees a group whole. ``group`` may be
    empty. Nulls come first; rows of one group with equal order keys get places in no fixed order, and only those cannot be split. ``rows`` is read three times: write it first if it is dear."""
    keys = [*group, *order]
    bounds = spread_bounds(rows, keys, ranges)
    if not bounds:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("long"))
    dealt = rows.withColumn("_p", range_of(rows, keys, bounds))
    counts = dealt.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    inside = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_p").orderBy(*order)) - 1)
    place = (F.col("_r") + F.coalesce(F.col("_before"), F.lit(0))).cast("long").alias(name)
    return met(inside, before_ranges(counts, group), [*group, "_p"], "left", small=True).select(*rows.columns, place)


def runs_of(rows: DataFrame, group: list[str], order: list[str], value: str, name: str = "run_end", ranges: int = RANGES) -> DataFrame:
    """Adds ``name``: in the order of its group, the position after the last row of the run of equal ``value`` (null equals null) that a row is in. Inside a range, runs are
    found from changes; a run that goes on over ranges is joined from the first and last values and the first change of each, one row for each range of a group."""
    placed = ranked(rows, group, order, "_at", ranges)
    keys = [*group, *order]
    dealt = placed.withColumn("_p", range_of(rows, keys, spread_bounds(rows, keys, ranges)))
    w = Window.partitionBy(*group, "_p").orderBy(*order)
    whole = Window.partitionBy(*group, "_p")
    change = F.coalesce(~F.lag(value).over(w).eqNullSafe(F.col(value)), F.lit(True)) & (F.row_number().over(w) > 1)
    marked = dealt.withColumn("_run", F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = marked.withColumns({"_end": F.max("_at").over(Window.partitionBy(*group, "_p", "_run")) + 1, "_runs": F.max("_run").over(whole)})
    edges = inside.groupBy(*group, "_p").agg(
        F.min_by(F.struct(F.col(value).alias("v")), "_at").alias("_first"),
        F.max_by(F.struct(F.col(value).alias("v")), "_at").alias("_last"),
        F.min(F.when(F.col("_run") == 0, F.col("_end"))).alias("_first_end"),
        F.max("_runs").alias("_runs"),
    )
    # from the last range back: where the run goes on that begins a range, and where the one that ends it goes on
    back = Window.partitionBy(*group).orderBy(F.desc("_p"))
    ahead = edges.withColumn("_next", F.lead("_first").over(Window.partitionBy(*group).orderBy("_p"))).withColumn("_joins", F.coalesce(F.col("_next").eqNullSafe(F.col("_last")) & F.col("_next").isNotNull(), F.lit(False)))
    # a range that is one run and joins the next passes on; the nearest later range that does not is where the run ends
    stop = F.when(~(F.col("_joins") & (F.col("_runs") == 0)), F.col("_first_end"))
    ahead = ahead.withColumn("_to", F.coalesce(F.first(stop, ignorenulls=True).over(back.rowsBetween(0, 0)), F.last(stop, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))))
    ahead = ahead.withColumn("_tail", F.when(F.col("_joins"), F.lag("_to").over(back)))
    later = ahead.where("_tail IS NOT NULL").select(*group, "_p", "_tail")
    joined = met(inside, later, [*group, "_p"], "left", small=True)
    end = F.when((F.col("_run") == F.col("_runs")) & F.col("_tail").isNotNull(), F.col("_tail")).otherwise(F.col("_end"))
    return joined.select(*rows.columns, end.cast("long").alias(name))


def selected_quantiles(rows: DataFrame, group: list[str], column: str, shares: tuple[float, ...], ranges: int = RANGES // 2, weight: str | None = None) -> DataFrame:
    """Linear quantiles of groups of any size, as columns q0, q1 ...: a histogram over ranges of (group, value) tells which range holds each wanted place, and only rows of
    those ranges are sorted. Null values are skipped; a group without values has no row. No task holds a group, and none its distinct values. ``weight``: how many times
    a row counts, 1 unless given. Equal values are counted once, where they are read, and the counts written."""
    some = rows.where(F.col(column).isNotNull()).select(*group, F.col(column).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).alias("_w"))
    counted = written_once(some.groupBy(*group, "_v").agg(F.sum("_w").alias("_n")), "counted-values")
    keys = [*group, "_v"]
    few = counted.count() <= FEW
    dealt = counted.withColumn("_p", F.lit(0) if few else range_of(counted, keys, spread_bounds(counted, keys, ranges)))
    at = {(i, end): (F.floor if end == "lo" else F.ceil)(F.lit(p) * (F.col("_all") - 1)) for i, p in enumerate(shares) for end in ("lo", "hi")}
    if few:  # a group's values are no more than one task may sort
        near = dealt.withColumns({"_from": F.lit(0), "_all": F.sum("_n").over(Window.partitionBy(*group))})
    else:
        totals = dealt.groupBy(*group, "_p").agg(F.sum("_n").alias("_n"))
        w = Window.partitionBy(*group).orderBy("_p")  # groups times the ranges that each has
        span = totals.withColumns({"_upto": F.sum("_n").over(w), "_all": F.sum("_n").over(Window.partitionBy(*group))}).withColumn("_from", F.col("_upto") - F.col("_n"))
        holds = F.lit(False)
        for x in at.values():
            holds = holds | ((x >= F.col("_from")) & (x < F.col("_upto")))
        near = met(dealt, span.where(holds).select(*group, "_p", "_from", "_all"), [*group, "_p"])
    upto = F.col("_from") + F.sum("_n").over(Window.partitionBy(*group, "_p").orderBy("_v"))
    placed = near.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))
    found = placed.groupBy(*group).agg(F.first("_all").alias("_all"), *[F.max(F.when((x >= F.col("_from")) & (x < F.col("_upto")), F.col("_v"))).alias(f"_{end}{i}") for (i, end), x in at.items()])
    between = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (F.lit(p) * (F.col("_all") - 1) - F.floor(F.lit(p) * (F.col("_all") - 1)))).alias(f"q{i}") for i, p in enumerate(shares)]
    return found.select(*group, *between)


def largest_task_share(rows: DataFrame, group: list[str], order: list[str], ranges: int = RANGES) -> float:
    """The share of all rows in the largest (group, range), which is the largest unit of work of :func:`ranked`."""
    keys = [*group, *order]
    counts = rows.withColumn("_p", range_of(rows, keys, spread_bounds(rows, keys, ranges))).groupBy(*group, "_p").count()
    most, total = counts.agg(F.max("count"), F.sum("count")).first()
    return most / total if total else math.nan
