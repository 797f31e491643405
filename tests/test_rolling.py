"""Rolling loads and streaks against a direct evaluation of their rules."""

import datetime as dt
import random
from collections import defaultdict

from paceline.operators import rolling

START = dt.date(2024, 1, 1)


def brute(days):
    """{(athlete, date): (acute, c28, c42, ratio, flag)} by looking back from every date."""
    by, out = defaultdict(dict), {}
    for a, d, load in days:
        by[a][d] = load
    for a, held in by.items():
        run = sign = 0
        for d in sorted({d + dt.timedelta(k) for d in held for k in range(42)}):
            back = lambda n: [held[x] for k in range(n) if (x := d - dt.timedelta(k)) in held]  # noqa: B023, E731
            mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
            acute, c28, c42 = float(sum(back(7))), mean(back(28)), mean(back(42))
            ratio = acute / c28 if c28 else None
            now = 0 if ratio is None else (ratio > 1.3) - (ratio < 0.8)
            run, sign = (run + 1 if now == sign else 1), now
            out[a, d] = (acute, c28, c42, ratio, sign if run >= 3 else 0)
    return out


def metrics(spark, days):
    rows = rolling.metrics_of_days(spark.createDataFrame(days, "athlete_id string, day date, daily_load double")).collect()
    return {(r.athlete_id, r.metric_date): r for r in rows}


def test_random_sparse_series(spark):
    rng, days = random.Random(2), []
    for a in range(25):
        for k in sorted(rng.sample(range(260), rng.randrange(1, 40))):
            days.append((f"a{a}", START + dt.timedelta(k), float(rng.randrange(0, 500))))
    want, got = brute(days), metrics(spark, days)
    assert set(got) == set(want)
    for key, w in want.items():
        g = got[key]
        assert (g.acute_load, g.chronic_load_28d, g.chronic_load_42d, g.acute_chronic_ratio, g.deload_flag) == w, key


def test_uniform_week(spark):
    got = metrics(spark, [("a", START + dt.timedelta(k), 100.0) for k in range(7)])
    first, fourth, seventh = (got["a", START + dt.timedelta(k)] for k in (0, 3, 6))
    assert (first.acute_chronic_ratio, first.deload_flag) == (1.0, 0) and fourth.deload_flag == 1
    assert (seventh.acute_load, seventh.chronic_load_28d, seventh.chronic_load_42d, seventh.acute_chronic_ratio) == (700.0, 100.0, 100.0, 7.0)
    assert seventh.coaching_flags == '["deload","high_fatigue"]'


def test_gap_without_rows_does_not_end_a_streak(spark):
    got = metrics(spark, [("a", START, 100.0), ("a", START + dt.timedelta(200), 100.0)])
    assert len(got) == 84 and got["a", START + dt.timedelta(41)].acute_chronic_ratio is None


def test_empty(spark):
    assert metrics(spark, []) == {}


def test_sliding_windows_agree_with_rolling_sums(spark):
    days = [("a", START + dt.timedelta(k), float(k)) for k in (0, 3, 50)]
    events = spark.createDataFrame(days, "athlete_id string, d date, session_load double").selectExpr("athlete_id", "cast(d as timestamp) as event_ts", "session_load")
    got = {r.metric_date: r.window_load for r in rolling.sliding_windows(events).collect()}
    assert got[START] == 0 and got[START + dt.timedelta(3)] == 3 and got[START + dt.timedelta(50)] == 50 and len(got) == 45 + 42


def test_the_latest_rows_need_recent_days_only(spark):
    import random

    from paceline.operators import serving

    rng, day = random.Random(3), dt.date(2026, 1, 1)
    rows = {(a, day + dt.timedelta(rng.choice([rng.randrange(400), rng.randrange(60)]))): float(rng.randrange(1, 900)) for a in "abcdefgh" for _ in range(rng.randrange(1, 60))}
    daily = spark.createDataFrame([(a, d, v) for (a, d), v in rows.items()], "athlete_id string, day date, daily_load double")
    some = sorted(map(tuple, serving.latest_metrics(rolling.metrics_of_days(rolling.recent_days(daily))).collect()), key=str)
    assert some == sorted(map(tuple, serving.latest_metrics(rolling.metrics_of_days(daily)).collect()), key=str) and len(some) == 8


def test_steps_give_the_rows_of_the_spine(spark):
    """Sparse and dense series, loads of 0 and none: steps against the windows over every day."""
    from pyspark.sql import functions as F

    rng, days = random.Random(7), []
    for a in range(30):
        span = rng.choice([50, 120, 600])
        for k in sorted(rng.sample(range(span), rng.randrange(1, 48))):
            days.append((f"a{a}", START + dt.timedelta(k), rng.choice([None, 0.0, *[float(rng.randrange(500))] * 8])))
    daily = spark.createDataFrame(days, "athlete_id string, day date, daily_load double")
    want = rolling.deload_flag(rolling.rolling_load(rolling.load_spine(daily), keep_number=True)).drop("daily_load")
    got = rolling.metrics_of_days(daily)
    rows = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert rows(got) == rows(want) and got.where("deload_flag != 0").count() > 50
    loads = rolling.rolling_load_of_days(daily)
    assert rows(loads.withColumn("deload_flag", F.lit(0))) == rows(want.withColumn("deload_flag", F.lit(0)))


def test_only_steps_are_sorted(spark):
    days = spark.createDataFrame([("a", START + dt.timedelta(90 * k), 100.0) for k in range(5)], "athlete_id string, day date, daily_load double")
    metrics = rolling.metrics_of_days(days)
    plan = metrics._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate explode(sequence(") < plan.index("Sort [")  # days are made above the last sort
    assert metrics.count() == 210 and rolling.load_steps(days).count() == 15


def test_days_between_hold_what_a_range_depends_on(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    days = [(f"a{a}", START + dt.timedelta(k), float(rng.randrange(900))) for a in range(20) for k in sorted(rng.sample(range(300), rng.randrange(1, 90)))]
    daily = spark.createDataFrame(days, "athlete_id string, day date, daily_load double")
    ends = [F.lit(START + dt.timedelta(k)) for k in (120, 180)]
    of = lambda d: sorted(map(repr, rolling.metrics_of_days(d).where(F.col("metric_date").between(*ends)).collect()))
    some = rolling.days_between(daily, *ends)
    assert of(some) == of(daily) and 0 < some.count() < daily.count()
