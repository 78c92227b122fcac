"""Statistics of vector columns in long form, and their merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbase.operators.ranks import met, selected_quantiles

QUANTILES = (0.01, 0.1, 0.5, 0.9, 0.99)


def dimension_stats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """min, max, mean, population std, count and linear quantiles of each dimension in each group, one row per dimension. All dimensions are aggregated in one
    pass, and only the results become rows. Null values are skipped. The quantiles are exact; a group's distinct values are held by one task, so groups are
    episodes or other bounded ones; for whole repos see :func:`large_stats`."""
    q = F.array(*map(F.lit, QUANTILES))
    one = lambda c: F.struct(
        F.lit(c).alias("dim"),
        F.min(F.col(c).cast("double")).alias("min"),
        F.max(F.col(c).cast("double")).alias("max"),
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("std"),
        F.count(c).alias("count"),
        F.percentile(F.col(c).cast("double"), q).alias("q"),
    )
    rows = df.groupBy(*keys).agg(F.array(*map(one, columns)).alias("x")).select(*keys, F.explode("x").alias("x"))
    quantiles = [F.col("x.q")[i].alias(f"q{int(p * 100):02d}") for i, p in enumerate(QUANTILES)]
    return rows.select(*keys, "x.dim", "x.min", "x.max", "x.mean", "x.std", "x.count", *quantiles)


def large_stats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """As :func:`dimension_stats` for groups of any size: moments in one pass, and quantiles by ranges of (group, dimension, value), of which equal ones are counted where they are
    read. No task holds a group's values."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*keys, "x.dim", "x.v")
    by = [*keys, "dim"]
    moments = long.groupBy(*by).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("count"))
    q = selected_quantiles(long, by, "v", QUANTILES).withColumnsRenamed({f"q{i}": f"q{int(p * 100):02d}" for i, p in enumerate(QUANTILES)})
    return met(moments, q, by, "left")


def exact_quantiles(df: DataFrame, keys: list[str], column: str, shares: tuple[float, ...]) -> DataFrame:
    """Linear quantiles of groups of any size, as columns q0, q1 ..., see :func:`reelbase.operators.ranks.selected_quantiles`."""
    return selected_quantiles(df, keys, column, shares)


def merged_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of a union from those of its parts: count-weighted mean, std from second moments, weighted quantiles (approximate, q*_wavg)."""
    n = F.sum("count")
    mean = F.sum(F.col("mean") * F.col("count")) / n
    second = F.sum((F.col("std") * F.col("std") + F.col("mean") * F.col("mean")) * F.col("count")) / n
    return stats.groupBy(*keys).agg(F.min("min").alias("min"), F.max("max").alias("max"), mean.alias("mean"), F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("std"), n.alias("count"), *[(F.sum(F.col(f"q{int(p * 100):02d}") * F.col("count")) / n).alias(f"q{int(p * 100):02d}_wavg") for p in QUANTILES])


def scalar_summary(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """min, max, mean, std, q50, q90, q95, q99; zeros for a group without values."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    c = F.col(column)
    moments = df.groupBy(*keys).agg(z(F.min(c)).alias("min"), z(F.max(c)).alias("max"), z(F.avg(c)).alias("mean"), z(F.stddev_pop(c)).alias("std"))
    shares = (0.5, 0.9, 0.95, 0.99)
    quantiles = exact_quantiles(df, keys, column, shares)
    both = moments.join(quantiles, keys, "left") if keys else moments.crossJoin(quantiles)  # one row each
    return both.select(*keys, "min", "max", "mean", "std", *[z(F.col(f"q{i}")).alias(f"q{int(p * 100)}") for i, p in enumerate(shares)])
