"""Formulas against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from paceline.functions import coerce, loads, scores, times


def values(spark, ddl, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_strength_load(spark):
    got = values(spark, "r int, w double, e double", [(8, 100.0, 8.5), (5, 100.0, None), (5, 100.0, 0.0), (5, 100.0, -1.0)], loads.strength_load(F.col("r"), F.col("w"), F.col("e")))
    assert got == [(680.0,), (500.0,), (500.0,), (None,)]


def test_cardio_load(spark):
    got = values(spark, "t double, h int, d int", [(85.0, 155, 3600), (None, 110, 3600), (None, None, 3600)], loads.cardio_load(F.col("t"), F.col("h"), F.col("d")))
    assert got == [(85.0,), (50.0,), (None,)]


@pytest.mark.parametrize(
    ("text", "total"),
    [('{"strength": 3, "cardio": 2}', 5.0), ("not-json", None), ("null", None), ("", None), ("[1]", None), ("{}", 0.0), ('{"a": true, "b": "9", "c": 1.5, "d": null, "e": {"x": 1}}', 2.5), (None, None)],
)
def test_volume_target(spark, text, total):
    assert values(spark, "t string", [(text,)], loads.volume_target(F.col("t"))) == [(total,)]


def test_adherence(spark):
    rows = [(5, 20, 0.0, None), (5, 20, 0.0, 0.0), (10, 20, 300.0, 400.0), (30, 20, 900.0, 400.0), (1, 0, 0.0, None)]
    got = values(spark, "s int, p int, v double, t double", rows, loads.adherence(*[F.col(c) for c in "spvt"]))
    assert got == [(0.25,), (0.25,), (0.625,), (1.0,), (None,)]


def test_block_weeks(spark):
    rows = [("2026-07-01", "2026-07-29"), ("2026-07-01", "2026-07-30"), ("2026-07-01", "2026-07-01")]
    got = values(spark, "a string, z string", rows, loads.block_weeks(F.to_date("a"), F.to_date("z")))
    assert got == [(4,), (5,), (1,)]


def test_fatigue_and_readiness(spark):
    got = values(spark, "a double, c double", [(700.0, 100.0), (100.0, 100.0), (5.0, 0.0), (float("nan"), 1.0), (2.0, 0.5)], scores.fatigue(F.col("a"), F.col("c")))
    assert got == [(100.0,), (20.0,), (None,), (None,), (40.0,)]
    rows = [(r, 1.0) for r in (0.0, 0.8, 1.0, 1.3, 2.0, 5.0)] + [(None, 1.0), (1.0, 0.0), (float("nan"), 1.0)]
    got = [v for (v,) in values(spark, "r double, c double", rows, scores.readiness(F.col("r"), F.col("c")))]
    assert [None if v is None else round(v, 9) for v in got] == [40.0, 60.0, 80.0, 60.0, 0.0, 0.0, None, None, None]


def test_signs_are_strict(spark):
    got = values(spark, "r double", [(1.3,), (0.8,), (1.31,), (0.79,), (None,), (float("nan"),), (math.inf,)], scores.ratio_sign(F.col("r")))
    assert [v for (v,) in got] == [0, 0, 1, -1, 0, 0, 1]


def test_flags_and_bands(spark):
    rows = [(1, 85.0), (-1, 75.0), (0, 70.0), (0, None), (0, 69.9)]
    got = values(spark, "d int, f double", rows, scores.coaching_flags(F.col("d"), F.col("f")))
    assert [v for (v,) in got] == [["deload", "high_fatigue"], ["undertrained", "monitor"], ["monitor"], [], []]
    got = values(spark, "r double", [(1.51,), (1.5,), (1.3,), (1.29,), (None,)], scores.ratio_zone(F.col("r")))
    assert [v for (v,) in got] == ["danger", "caution", "caution", "safe", "none"]
    assert values(spark, "s string", [("martial_arts",)], scores.label(F.col("s"))) == [("Martial Arts",)]
    assert values(spark, "s string", [('["a"]',), ("nope",), (None,)], scores.flags_from_json(F.col("s"))) == [(["a"],), (None,), (None,)]


def test_recovery(spark):
    rows = [(60.0, 8.0, 10.0), (90.0, 8.0, 10.0), (None, 8.0, 5.0), (None, None, None), (30.0, None, None), (None, None, 20.0)]
    got = values(spark, "h double, s double, p double", rows, scores.recovery(F.col("h"), F.col("s"), F.col("p")))
    assert [v for (v,) in got] == [75.0, 100.0, 80.0, None, 0.0, 40.0]


def test_times(spark):
    texts = ["2026-06-20T09:00:00", "2026-06-20 09:00:00+02:00", "2026-06-20", "2026-06-20T09:00:00.5Z", "2026", "", "soon", None, "2026-13-01"]
    got = [v for (v,) in values(spark, "t string", [(t,) for t in texts], times.iso_to_ms(F.col("t")))]
    assert got == [1781946000000, 1781938800000, 1781913600000, 1781946000500, None, None, None, None, None]
    got = values(spark, "t string", [("5",), ("5.0",), ("5.5",), ("2026-06-20",)], times.flexible_ms(F.col("t")))
    assert [v for (v,) in got] == [5, 5, None, 1781913600000]
    assert values(spark, "m bigint", [(1781946000000,), (1781946000000000,), (-1,)], times.day_start_ms(F.col("m"))) == [(1781913600000,), (1781913600000,), (-86400000,)]
    assert values(spark, "d string", [("2026-7-1",), ("2026-02-30",), ("2026-02-28",)], times.iso_date(F.col("d")).isNotNull()) == [(False,), (False,), (True,)]


def test_cells(spark):
    got = values(spark, "c string", [("2400.5",), (" 12 ",), ("",), ("x",), (None,)], coerce.cell_int(F.col("c")))
    assert [v for (v,) in got] == [None, 12, None, None, None]


def test_rounding_is_of_the_exact_double(spark):
    import random

    rng = random.Random(1)
    xs = [242.55, 0.25, 0.35, 2.675, -0.05, 1e-9, 12345678.05, None] + [rng.randrange(-10**6, 10**6) / 200 for _ in range(500)]
    for digits in (1, 3):
        got = [v for (v,) in values(spark, "x double", [(x,) for x in xs], scores.api_round(F.col("x"), digits))]
        assert got == [None if x is None else round(x, digits) for x in xs]
