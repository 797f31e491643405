"""First row of an id wins; rows without an id are all kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by_id(events: DataFrame, order: str | Column, id_col: str = "event_id") -> DataFrame:
    """Of rows that share an id, the first in `order`; a null or empty id is nobody's copy.

    One aggregate: a hot id leaves each task as one row, and no rows are sorted. Rows
    without an id get keys of their own, so they neither meet in one task nor shadow
    each other.
    """
    blank = F.coalesce(F.col(id_col).cast("string"), F.lit("")) == ""
    by = F.col(order) if isinstance(order, str) else order
    keyed = events.select(F.when(blank, F.monotonically_increasing_id()).alias("alone"), F.col(id_col).alias("id"), F.struct(by.alias("by")).alias("by"), F.struct("*").alias("row"))
    return keyed.groupBy("id", "alone").agg(F.min_by("row", "by").alias("row")).select("row.*")


def unseen(events: DataFrame, seen: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Rows whose id isn't in `seen` (a table of ids)."""
    return events.join(seen.select(F.col(id_col).alias("__seen")).distinct(), F.col(id_col) == F.col("__seen"), "left_anti")


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest `order`, as one aggregate: partial maxima go through the shuffle, not rows to be sorted."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.col(order)).alias("__row")
    return rows.groupBy(*keys).agg(packed).select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns])
