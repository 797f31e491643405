"""Session loads and plan arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strength_load(reps: Column, weight_kg: Column, rpe: Column) -> Column:
    """reps * weight, scaled by effort where it was rated (over 0); null for a negative rating."""
    base = reps.cast("double") * weight_kg
    return F.when(rpe.isNull() | (rpe == 0), base).when(rpe > 0, base * (rpe / 10.0))


def cardio_load(tss: Column, avg_hr: Column, duration_sec: Column) -> Column:
    """The stress score; without one, hours times relative heart rate times 100; else null."""
    return F.coalesce(tss, duration_sec.cast("double") / 3600.0 * (avg_hr.cast("double") / 220.0) * 100.0)


def finite(load: Column) -> Column:
    return load.isNotNull() & ~F.isnan(load) & (F.abs(load) != float("inf"))


def block_weeks(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.datediff(end, start) / 7.0)).cast("int")


def volume_target(targets: Column) -> Column:
    """Sum of the numbers in a JSON object's values, 0 for none; null for what is no JSON object.

    Texts that spell numbers are no numbers; true counts as 1.
    """
    fields = F.from_json(targets, "map<string,variant>")
    is_object = F.schema_of_variant(F.try_parse_json(targets)).startswith("OBJECT")

    def number(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return F.when(kind == "BOOLEAN", v.cast("boolean").cast("int").cast("double")).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|TINYINT|SMALLINT)"), F.try_variant_get(v, "$", "double"))

    total = F.aggregate(F.map_values(fields), F.lit(0.0), lambda acc, v: acc + F.coalesce(number(v), F.lit(0.0)))
    return F.when(is_object, total)


def adherence(sessions: Column, planned: Column, volume: Column, target: Column) -> Column:
    """Half sessions and half volume, each at most 1; sessions alone without a target; null without a plan."""
    by_sessions = F.least(sessions / planned, F.lit(1.0))
    by_volume = F.least(volume / target, F.lit(1.0))
    return F.when(planned > 0, F.when(target > 0, 0.5 * by_sessions + 0.5 * by_volume).otherwise(by_sessions))
