"""State a key: first copies within a time, streaks day by day, over restarts."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from paceline.operators import rolling
from paceline.streaming import state

DAY0 = dt.date(2024, 1, 1)


def run(spark, out, folder):
    """Runs what is there now and gives all rows so far."""
    query = state.started(out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").outputMode("append").trigger(availableNow=True), spark)
    assert query.awaitTermination(120)
    return spark.read.parquet(f"{folder}/out").collect()


def put(spark, rows, ddl, folder, parts=1):
    spark.createDataFrame(rows, ddl).coalesce(parts).write.mode("append").parquet(f"{folder}/in")


def stream(spark, ddl, folder, files=1):
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


EVENTS = "event_id string, athlete_id string, at long, note string"


def test_first_copy_wins_over_restarts(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, [("a", "x", 2, "second"), ("a", "x", 1, "first"), ("b", "x", 3, "b"), (None, "x", 4, "n"), ("", "y", 5, "blank"), (None, "x", 4, "n")], EVENTS, folder)
    of = lambda: state.first_copies(stream(spark, EVENTS, folder), ["at"])
    assert sorted(r.note for r in run(spark, of(), folder)) == ["b", "blank", "first", "n", "n"]
    put(spark, [("a", "x", 0, "too late"), ("c", "z", 7, "c"), ("c", "z", 8, "again")], EVENTS, folder)
    assert sorted(r.note for r in run(spark, of(), folder)) == ["b", "blank", "c", "first", "n", "n"]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", "true") == "true"


def test_an_id_comes_again_when_it_is_forgotten(spark, tmp_path):
    folder = str(tmp_path)
    of = lambda: state.first_copies(stream(spark, EVENTS, folder), ["at"], ttl_ms=1500)
    put(spark, [("a", "x", 1, "one")], EVENTS, folder)
    run(spark, of(), folder)
    time.sleep(2)
    put(spark, [("a", "x", 2, "two")], EVENTS, folder)
    assert sorted(r.note for r in run(spark, of(), folder)) == ["one", "two"]


def test_an_id_is_its_owners(spark, tmp_path):
    folder = str(tmp_path)
    of = lambda: state.first_copies_within(stream(spark, EVENTS, folder), ["at"], "athlete_id")
    put(spark, [("p", "x", 2, "x late"), ("p", "x", 1, "x"), ("p", "y", 3, "y"), ("p", None, 4, "nobody"), ("", "x", 5, "blank")], EVENTS, folder)
    run(spark, of(), folder)
    put(spark, [("p", "x", 6, "again"), ("p", None, 7, "again"), ("q", "x", 8, "q")], EVENTS, folder)
    assert sorted(r.note for r in run(spark, of(), folder)) == ["blank", "nobody", "q", "x", "y"]


def test_a_hot_id_is_one_row(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, [("hot", "x", i, "h") for i in range(5000)] + [(f"e{i}", "x", i, "e") for i in range(200)], EVENTS, folder)
    rows = run(spark, state.first_copies(stream(spark, EVENTS, folder), ["at"]), folder)
    assert len(rows) == 201 and [r.at for r in rows if r.event_id == "hot"] == [0]


ROLLED = "athlete_id string, metric_date date, acute_chronic_ratio double, acute_load double"


def ratios(seed, days=30):
    rng = random.Random(seed)
    return [(a, DAY0 + dt.timedelta(k), rng.choice([1.5, 1.5, 1.5, 0.5, 0.5, 1.0, None]), float(k)) for a in ("a", "b", "c") for k in range(days) if rng.random() < 0.9]


@pytest.mark.parametrize("cuts", [(30,), (7, 8, 20, 30), tuple(range(6, 31, 6))])
def test_streaks_in_any_split_are_the_batch_querys(spark, tmp_path, cuts):
    """Each cut is a file, and the query starts anew after it; within a file rows come in any order."""
    folder, rows, done = str(tmp_path), ratios(len(cuts)), 0
    for cut in cuts:
        some = [r for r in rows if done <= (r[1] - DAY0).days < cut]
        random.Random(cut).shuffle(some)
        put(spark, some, ROLLED, folder, 1)
        state.deload_job(stream(spark, ROLLED, folder), f"{folder}/out", f"{folder}/ck").awaitTermination(120)
        done = cut
    want = rolling.deload_flag(spark.createDataFrame(rows, ROLLED))
    got = spark.read.parquet(f"{folder}/out").select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.where("deload_flag != 0").count() > 5


def test_late_and_repeated_days_change_nothing(spark, tmp_path):
    folder = str(tmp_path)
    day = lambda k, ratio: ("a", DAY0 + dt.timedelta(k), ratio, 1.0)
    for rows in ([day(1, 1.5), day(2, 1.5), day(2, 0.5)], [day(2, 0.5), day(0, 0.5), day(3, 1.5)], [day(1, 0.1), day(4, 1.5)]):
        put(spark, rows, ROLLED, folder)
        state.deload_job(stream(spark, ROLLED, folder), f"{folder}/out", f"{folder}/ck").awaitTermination(120)
    got = spark.read.parquet(f"{folder}/out").orderBy("metric_date").collect()
    assert [((r.metric_date - DAY0).days, r.deload_flag) for r in got] == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_a_streak_is_forgotten(spark, tmp_path):
    folder = str(tmp_path)
    of = lambda: state.deload_stream(stream(spark, ROLLED, folder), ttl_ms=1500)
    put(spark, [("a", DAY0, 1.5, 1.0), ("a", DAY0 + dt.timedelta(1), 1.5, 1.0)], ROLLED, folder)
    run(spark, of(), folder)
    time.sleep(2)
    put(spark, [("a", DAY0 + dt.timedelta(k), 1.5, 1.0) for k in (0, 60, 61, 62)], ROLLED, folder)
    got = sorted(((r.metric_date - DAY0).days, r.deload_flag) for r in run(spark, of(), folder))
    assert got == [(0, 0), (0, 0), (1, 0), (60, 0), (61, 1), (62, 1)]


def test_null_ratios_end_streaks(spark):
    rows = [("a", DAY0 + dt.timedelta(k), r, 0.0) for k, r in enumerate([1.5, 1.5, None, 1.5, 1.5, 1.5])]
    want = [r.deload_flag for r in rolling.deload_flag(spark.createDataFrame(rows, ROLLED)).orderBy("metric_date").collect()]
    assert want == [0, 0, 0, 0, 0, 1] and rolling.deload_flag(spark.createDataFrame([], ROLLED)).select(F.count("*")).first()[0] == 0
