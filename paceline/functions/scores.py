"""Ratios, scores, flags and bands. NaN is made null first: Spark orders it above every number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import HRV_BASELINE, RATIO_DANGER, RATIO_HIGH, RATIO_LOW


def known(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def load_ratio(acute: Column, chronic: Column) -> Column:
    """acute / chronic; null for a chronic load of 0."""
    return F.when(chronic != 0, acute / chronic)


def fatigue(acute: Column, chronic_42: Column) -> Column:
    """0 to 100 for acute over the long load (1 at least) from 0 to 5; null for a long load of 0."""
    a, c = known(acute), known(chronic_42)
    return F.when(a.isNotNull() & (c != 0), clamp(a / F.greatest(c, F.lit(1.0)), 0.0, 5.0) * 20.0)


def readiness(ratio: Column, chronic_28: Column) -> Column:
    """Rises from 40 to 80 up to a ratio of 1, falls to 60 at 1.3 and to 0 beyond."""
    r, c = known(ratio), known(chronic_28)
    rising = F.when(r <= 0.8, 40.0 + r / 0.8 * 20.0).when(r <= 1.0, 60.0 + (r - 0.8) / 0.2 * 20.0)
    falling = F.when(r <= 1.3, 80.0 - (r - 1.0) / 0.3 * 20.0).otherwise(F.greatest(F.lit(0.0), 60.0 - (r - 1.3) / 0.7 * 60.0))
    return F.when(r.isNotNull() & (c != 0), F.least(F.coalesce(rising, falling), F.lit(80.0)))


def ratio_sign(ratio: Column) -> Column:
    """1 over the high threshold, -1 under the low one, 0 between, at either, or for null."""
    r = known(ratio)
    return F.when(r > RATIO_HIGH, 1).when(r < RATIO_LOW, -1).otherwise(0)


def coaching_flags(deload_flag: Column, fatigue_score: Column) -> Column:
    """Array: deload or undertrained by the flag; high_fatigue from 80, else monitor from 70."""
    f = known(fatigue_score)
    by_flag = F.when(deload_flag == 1, "deload").when(deload_flag == -1, "undertrained")
    by_fatigue = F.when(f >= 80, "high_fatigue").when(f >= 70, "monitor")
    return F.array_compact(F.array(by_flag, by_fatigue))


def recovery(hrv: Column, sleep_hours: Column, perceived: Column, baseline: float = HRV_BASELINE) -> Column:
    """0 to 100 from heart-rate variability (50), sleep of 8 h (30) and a 0-10 rating (20); without
    the first, 60 and 40; null where all are. A missing part counts as 0."""
    sleep = clamp(F.coalesce(sleep_hours, F.lit(0.0)) / 8.0, 0.0, 1.0)
    felt = clamp(F.coalesce(perceived.cast("double"), F.lit(0.0)) / 10.0, 0.0, 1.0)
    by_hrv = clamp(hrv / F.lit(max(baseline, 1.0)) - 0.5, 0.0, 1.0)
    full = clamp(by_hrv * 50.0 + sleep * 30.0 + felt * 20.0, 0.0, 100.0)
    part = clamp(sleep * 60.0 + felt * 40.0, 0.0, 100.0)
    return F.when(hrv.isNotNull(), full).when(sleep_hours.isNotNull() | perceived.isNotNull(), part)


def ratio_zone(ratio: Column) -> Column:
    return F.when(ratio > RATIO_DANGER, "danger").when(ratio >= RATIO_HIGH, "caution").when(ratio.isNotNull(), "safe").otherwise("none")


def fatigue_band(score: Column) -> Column:
    return F.when(score >= 80, "danger").when(score >= 60, "warn").when(score.isNotNull(), "ok")


def readiness_band(score: Column) -> Column:
    return F.when(score >= 66, "ok").when(score >= 33, "warn").when(score.isNotNull(), "danger")


def label(name: Column) -> Column:
    """'trail_running' -> 'Trail Running'."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def api_round(x: Column, digits: int = 1) -> Column:
    """The nearest decimal to the exact value of the double, half to even; null stays null.

    `bround` would round the shortest decimal that reads as the double: 242.55 is above
    the middle as a double, but a tie as a decimal.
    """
    return F.call_function("format_number", x, F.lit("0." + "0" * digits)).try_cast("double")


def flags_from_json(text: Column) -> Column:
    """A list of texts; null for what is none."""
    return F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>"))
