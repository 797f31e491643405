"""Keyed tables without a database: partial upserts and inserts of what is absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_columns(table: DataFrame, updates: DataFrame, keys: list[str], columns: list[str], arrival: str | None = None) -> DataFrame:
    """`table` with `columns` from `updates` where keys meet, and new rows for other keys.

    Other columns keep their values. Of several updates to a key the one with the largest
    `arrival` counts. Merging the same updates twice changes nothing.
    """
    if arrival is not None:
        updates = updates.groupBy(*keys).agg(*[F.max_by(c, arrival).alias(c) for c in columns])
    fresh = updates.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__new"))
    on = [table[k] == fresh[f"__{k}"] for k in keys]
    met = table.join(fresh, on, "full")

    def pick(name: str):
        if name in keys:
            return F.coalesce(table[name], fresh[f"__{name}"]).alias(name)
        return (F.when(fresh["__new"], fresh[f"__{name}"]).otherwise(table[name]) if name in columns else table[name]).alias(name)

    return met.select(*[pick(c) for c in table.columns])


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`table` and those of `rows` whose key it lacks; of rows with one key, one."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new.select(*table.columns))
