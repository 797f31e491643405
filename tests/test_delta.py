"""Corrections against the batch query, parity by digests against key sets, panes against windows over all events."""

import datetime as dt
import pathlib
import random
import shutil

import pytest
from pyspark.sql import functions as F

from paceline.functions import times
from paceline.operators import delta, parity, rolling
from paceline.schemas import DAY_MS
from paceline.streaming import panes

START = dt.date(2024, 1, 1)
DAILY = "athlete_id string, day date, daily_load double"


def random_days(seed):
    rng, days = random.Random(seed), {}
    for a in range(12):
        for k in sorted(rng.sample(range(420), rng.randrange(1, 60))):
            days[f"a{a}", START + dt.timedelta(k)] = float(rng.randrange(0, 500))
    return days


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corrections(spark, seed):
    rng, before = random.Random(seed), random_days(seed)
    after, changed = dict(before), set()
    for key in rng.sample(sorted(before), 6):  # other loads, and days that go
        changed.add(key)
        if rng.random() < 0.5:
            del after[key]
        else:
            after[key] += 100.0
    for _ in range(6):  # new days, also of new athletes
        key = (f"a{rng.randrange(14)}", START + dt.timedelta(rng.randrange(460)))
        changed.add(key)
        after[key] = after.get(key, 0.0) + 77.0
    frame = lambda days: spark.createDataFrame([(*k, v) for k, v in sorted(days.items())], DAILY)
    old, want = rolling.metrics_of_days(frame(before)), rolling.metrics_of_days(frame(after))
    changes = delta.corrections(old, frame(after), spark.createDataFrame(sorted(changed), "athlete_id string, day date")).cache()
    got = delta.corrected(old, changes)
    rows = lambda df: sorted(map(repr, df.select(*sorted(want.columns)).collect()))
    assert rows(got) == rows(want), [x for x in zip(rows(got), rows(want)) if x[0] != x[1]][:2]
    # No more rows are written than the changed days reach, and each of them differs.
    assert 0 < changes.count() <= len(changed) * (42 + 2) < want.count() / 4
    was, now = set(rows(old)), set(rows(want))
    assert changes.where("not gone").count() == len(now - was)


def test_no_change_no_rows(spark):
    days = spark.createDataFrame([(*k, v) for k, v in random_days(3).items()], DAILY)
    old = rolling.metrics_of_days(days)
    assert delta.corrections(old, days, spark.createDataFrame([], "athlete_id string, day date")).count() == 0
    assert delta.corrections(old, days, days.select("athlete_id", "day").limit(5)).count() == 0


def test_the_last_day_goes(spark):
    days = spark.createDataFrame([("a", START, 5.0)], DAILY)
    changes = delta.corrections(rolling.metrics_of_days(days), days.limit(0), days.select("athlete_id", "day"))
    assert changes.count() == 42 and changes.where("gone").count() == 42


def sides(spark, seed):
    rng = random.Random(seed)
    keys = [(f"a{rng.randrange(40)}", rng.randrange(19_000, 19_200)) for _ in range(3000)]
    pg, lake = list(keys), keys + keys[:500]
    pg = [k for k in pg if k not in set(keys[:3])] + [("a1", 19_500), ("new", 19_031)]
    lake = [k for k in lake if k not in set(keys[10:12])]
    frame = lambda some: spark.createDataFrame([(a, d * DAY_MS) for a, d in some], "athlete_id string, ms long")
    want = {(a, d * DAY_MS, "iceberg_missing") for a, d in set(pg) - set(lake)} | {(a, d * DAY_MS, "pg_missing") for a, d in set(lake) - set(pg)}
    return frame(pg), frame(lake), want


def test_parity_by_digests(spark):
    pg, lake, want = sides(spark, 4)
    got = parity.parity_by_digests(pg, lake, F.col("ms"), times.day_start_ms(F.col("ms")), 16)
    assert set(map(tuple, got.collect())) == want and got.count() == len(want) > 4
    assert parity.parity_by_digests(lake, lake, F.col("ms"), F.col("ms")).count() == 0
    assert parity.parity_by_digests(pg.limit(0), pg.limit(0), F.col("ms"), F.col("ms")).count() == 0


def test_agreeing_buckets_are_not_read_again(spark, tmp_path):
    pg, lake, want = sides(spark, 5)
    for side, rows in (("pg", pg), ("lake", lake)):
        parity.write_coverage(rows, F.col("ms"), str(tmp_path / side), 64)
    folders = [str(tmp_path / side) for side in ("pg", "lake")]
    assert set(map(tuple, parity.stored_parity(spark, *folders).collect())) == want
    unlike = {r.bucket for r in parity.differing(*(spark.read.parquet(f"{f}/digests") for f in folders)).collect()}
    agreeing = [p for f in folders for p in pathlib.Path(f, "masks").glob("bucket=*") if int(p.name.split("=")[1]) not in unlike]
    assert len(agreeing) > 20
    for p in agreeing:  # what is gone can't be read
        shutil.rmtree(p)
    assert set(map(tuple, parity.stored_parity(spark, *folders).collect())) == want


@pytest.mark.parametrize("files", [1, 5])
def test_panes_are_the_windows_over_all_events(spark, tmp_path, files):
    rng, rows = random.Random(files), []
    for a in ("a", "b"):
        for k in sorted(rng.sample(range(70), 25)):
            rows += [(a, dt.datetime.combine(START, dt.time(rng.randrange(24))) + dt.timedelta(k), float(rng.randrange(100))) for _ in range(rng.randrange(1, 4))]
    ddl = "athlete_id string, event_ts timestamp, session_load double"
    rows.sort(key=lambda r: r[1])
    step = -(-len(rows) // files)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", dt.datetime.combine(START, dt.time()) + dt.timedelta(days=400), 1.0)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = panes.rolling_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    got = spark.read.parquet(str(tmp_path / "out")).where("athlete_id != 'z'")
    batch = spark.createDataFrame(rows, ddl)
    daily = batch.groupBy("athlete_id", F.to_date("event_ts").alias("day")).agg(F.sum("session_load").alias("daily_load"))
    want = rolling.rolling_load(rolling.load_spine(daily)).drop("daily_load")
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    sliding = rolling.sliding_windows(batch).select("athlete_id", "metric_date", "window_load")
    assert sorted(map(repr, got.select(*sliding.columns).collect())) == sorted(map(repr, sliding.collect()))


def test_bad_times_take_the_records_time(spark, tmp_path):
    """Rows with times that can't be read advance the stream with their record's time, and none is lost."""
    from paceline.streaming import late

    day = lambda k: 1_704_067_200_000 + k * DAY_MS
    batches = [
        [("good", "2024-01-01T10:00:00Z", day(0)), ("bad", "soon", day(0)), ("none", None, day(0)), ("far", "99999999999999999", day(0))],
        [("ahead", "not a time", day(9))],  # only its record's time moves the watermark
        [("behind", "2024-01-01T11:00:00Z", day(9)), ("lost", None, None)],
    ]
    ddl = "id string, event_time string, record_ms long"
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    timed = late.with_event_time(stream, F.col("event_time"), F.col("record_ms"))
    query = timed.groupBy(F.window("event_ts", "1 day")).agg(F.sort_array(F.collect_set("id")).alias("ids")).writeStream.format("memory").queryName("timed").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = [r.ids for r in spark.table("timed").collect()]
    assert {"bad", "far", "good", "none"} <= set(got[0]) and not any("ahead" in ids for ids in got)  # closed by the row ahead
    flat = late.with_event_time(spark.createDataFrame([x for b in batches for x in b], ddl), F.col("event_time"), F.col("record_ms"))
    assert {r.id: r.event_ts.isoformat() for r in flat.collect()}["lost"].startswith("1970-01-01") and flat.count() == 7


def test_corrections_broadcast_no_rows(spark, tmp_path):
    """Sizes are guessed from the small tables that many rows are made of: nothing made of them may go through the driver."""
    spark.createDataFrame([(*k, v) for k, v in random_days(6).items()], DAILY).write.parquet(str(tmp_path / "daily"))
    daily = spark.read.parquet(str(tmp_path / "daily"))
    old = rolling.metrics_of_days(daily.where("daily_load > 100"))
    changes = delta.corrections(old, daily, daily.where("daily_load <= 100").select("athlete_id", "day"))
    got = delta.corrected(old, changes)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    want = rolling.metrics_of_days(daily)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
