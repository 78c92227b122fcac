"""What registered queries share: the tables of queries and SQL, and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.sources.adapters import FRAMES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EP = ["repo_no", "episode_index"]


def query(name: str, sql: str | None = None):
    """Register a query; SQL that mentions frames gets that view."""

    def add(f):
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            if "frames" in body:
                body = f"WITH {FRAMES_SQL}, {body[5:]}" if body.startswith("WITH ") else f"WITH {FRAMES_SQL} {body}"
            ORACLE_SQL[name] = body
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def compiled_round(x: Column, digits: int) -> Column:
    """round(x, digits) of doubles half away from zero, without a decimal number for each row, for columns of very many pairs; beyond 1e9 as Spark has it."""
    unit = 10.0**digits
    near = F.floor(F.abs(x) * unit + 0.5) / unit
    return F.when(F.abs(x) < 1e9, F.when(x < 0, -near).otherwise(near)).otherwise(F.round(x, digits))


LEN = "length_ AS (SELECT repo_no, episode_index, count(*) AS n FROM frames GROUP BY ALL)"

#: The repo's name and its parts, as SQL over repo_no.
IDENTITY = "['person_a', 'person_b', 'person_c'][CAST(repo_no // 3 AS INT) + 1]"
SLOT = "['left', 'middle', 'right'][CAST(repo_no % 3 AS INT) + 1]"
REPO = f"'dataset_v2_' || {IDENTITY} || '_' || {SLOT} || '_1'"
