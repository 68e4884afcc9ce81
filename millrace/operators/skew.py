"""Joins in which some keys may stand in a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 10_000


def lookup(rows: DataFrame, table: DataFrame, on: list[str], weight: str, slots: int = SLOTS) -> DataFrame:
    """``rows`` joined with ``table``, whose keys are distinct and whose ``weight`` says how many of ``rows`` have each key.

    Keys that stand in at least one of ``slots`` rows are, as the weights add up to no more than the rows, at most
    ``slots``: they are broadcast, and their rows, however many, are never shuffled. All other keys are
    joined by shuffle, with less than that share of the rows each. ``rows`` is read twice.
    """
    total = rows.count()
    hot = F.col(weight) * slots >= total
    few = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select(*on)), on, "left_anti")
    return rows.join(few, on).unionByName(rest.join(table.where(~hot), on))
