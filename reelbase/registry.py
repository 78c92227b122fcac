"""All registered queries of the episode engine and their SQL."""

from __future__ import annotations

from reelbase.queries import core, damaged, datasets, evaluation, folders, gathers, labels, quality, summaries, texts, watching  # noqa: F401
from reelbase.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
