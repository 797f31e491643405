"""Streams over folders end where batches do."""

import datetime as dt
import json

from pyspark.sql import functions as F

from paceline.operators import rolling
from paceline.schemas import DAY_MS, WELLNESS_DDL
from paceline.sources import topics
from paceline.streaming import jobs

T0 = 1_704_067_200_000


def raw(event_id, day, load, athlete="a"):
    iso = dt.datetime.fromtimestamp((T0 + day * DAY_MS) / 1000, dt.UTC).isoformat()
    return json.dumps({"event_id": event_id, "event_time": iso, "ingest_time": iso, "source": "s", "athlete_id": athlete, "payload": {"reps": load, "weight_kg": 1}})


def put(spark, root, values, offset):
    topics.write_batch(spark.createDataFrame([("a", v) for v in values], "key string, value string").coalesce(1), root, "raw.strength", offset)


def test_from_raw_to_metrics(spark, tmp_path):
    root, ck = str(tmp_path / "topics"), str(tmp_path / "ck")
    put(spark, root, [raw("e0", 0, 100), raw("e0", 0, 100), raw("e1", 1, 100), "{broken", json.dumps({"event_id": ""})], 0)

    def run():
        jobs.canonicalize_job(spark, root, "strength", "canonical.training_event", "dlq.canonical.training_event", f"{ck}/canon", files_per_trigger=1).awaitTermination()
        jobs.metrics_job(spark, root, f"{ck}/metrics", files_per_trigger=1).awaitTermination()

    run()
    put(spark, root, [raw("e1", 1, 100), raw("e2", 6, 300)], 10)
    run()
    put(spark, root, [raw("late", 1, 500), raw("ok", 4, 50)], 20)
    run()

    table = jobs.KeyedTable(spark, f"{ck}/metrics/metrics", jobs.METRICS_ROWS).read()
    days = [("a", dt.date(2024, 1, 1) + dt.timedelta(k), v) for k, v in ((0, 100.0), (1, 100.0), (4, 50.0), (6, 300.0))]
    want = rolling.metrics_of_days(spark.createDataFrame(days, "athlete_id string, day date, daily_load double")).select(*table.columns)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, want.collect()))
    letters = spark.read.schema(topics.SHAPE).option("recursiveFileLookup", True).parquet(f"{root}/dlq.canonical.training_event")
    kinds = sorted(r[0] for r in letters.select(F.get_json_object("value", "$.error_type")).collect())
    assert kinds == ["LATE_DATA", "TRANSFORM_ERROR", "VALIDATION_FAILURE"]


def test_wellness_job(spark, tmp_path):
    root = str(tmp_path)
    event = {"athlete_id": "a", "event_time": T0, "ingest_time": 1, "hrv": 60.0}
    rows = [("a", json.dumps(event)), ("a", json.dumps({**event, "ingest_time": 2, "hrv": 90.0}))]
    topics.write_batch(spark.createDataFrame(rows, "key string, value string"), root, "canonical.wellness_event")
    jobs.wellness_job(spark, root, f"{root}/ck", WELLNESS_DDL).awaitTermination()
    (r,) = jobs.KeyedTable(spark, f"{root}/ck/recovery", "athlete_id STRING, metric_date DATE, recovery_score DOUBLE").read().collect()
    assert r.recovery_score == 50.0


def test_built_in_stream_forms(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("x", "a", 0, 5.0), ("x", "a", 0, 5.0), ("y", "a", 0, 2.0), ("z", "a", 9, 1.0)]
    df = spark.createDataFrame(rows, "event_id string, athlete_id string, day int, session_load double").selectExpr("*", "timestamp_millis(1704067200000 + day * 86400000L) as event_ts")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)

    def run(out, name):
        out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.sql(f"select * from {name}").collect()

    assert sorted(r.event_id for r in run(jobs.dedup_stream(stream), "dedup_out")) == ["x", "y", "z"]
    assert {(str(r.day), r.daily_load) for r in run(jobs.daily_stream(stream), "daily_out")} == {("2024-01-01", 12.0)}


def test_files_to_raw_once(spark, tmp_path):
    inbox, root = tmp_path / "inbox" / "recovery", str(tmp_path / "topics")
    inbox.mkdir(parents=True)
    (inbox / "a.csv").write_text("athlete_id,date,sleep_hours,resting_hr,hrv,steps,body_weight_kg\na,2026-01-01,7.5,50,60,1,70\na,soon,7.5,50,60,1,70\n")
    for _ in range(2):
        jobs.run_connectors(spark, str(tmp_path / "inbox"), root, str(tmp_path / "ck"), None, ("recovery",))["recovery"].awaitTermination()
    raws = topics.read_batch(spark, root, "raw.recovery").collect()
    assert len(raws) == 1 and json.loads(raws[0].value)["payload"]["sleep_hours"] == 7.5


def test_command_line(spark, tmp_path):
    from paceline import cli

    root = str(tmp_path)
    assert "dlq.canonical.training_event" in topics.create_topics(spark, root) and topics.create_topics(spark, root) == []
    good = {"original_topic": "raw.strength", "original_value": "eA==", "error_type": "LATE_DATA", "timestamp": T0}
    topics.write_batch(spark.createDataFrame([("k", json.dumps(good)), ("k", "{"), ("k", json.dumps({**good, "error_type": "ODD"}))], "key string, value string"), root, "dlq.canonical.training_event")
    out = cli.main(["quality", root, "--now", "2024-01-08T12:00:00"], spark)
    assert out["scan"] == [{"scanned": 3, "corrupt": 1}] and out["warnings"] == [{"topic": "dlq.canonical.training_event", "n": 2}]
    dry = cli.main(["replay", root, "--error-type", "LATE_DATA", "--dry-run"], spark)
    assert dry["replayed_to"] == {"raw.strength": 1} and topics.read_batch(spark, root, "raw.strength").count() == 0
    cli.main(["replay", root], spark)
    assert [r.value for r in topics.read_batch(spark, root, "raw.strength").collect()] == ["x", "x"]
    assert cli.parse_time("5") == 5 and cli.parse_time("2024-01-01") == T0 == cli.parse_time("2024-01-01T01:00:00+01:00")


def test_offsets_of_streamed_letters(spark, tmp_path):
    """Each letter has an offset of its own, so that depth and bounded replays count letters."""
    from paceline import cli
    from paceline.operators import quality

    root, ck = str(tmp_path / "topics"), str(tmp_path / "ck")
    topics.create_topics(spark, root)
    for k in range(2):
        put(spark, root, ["{broken %d" % (10 * k + i) for i in range(10)], 0)
        jobs.canonicalize_job(spark, root, "strength", "canonical.training_event", "dlq.canonical.training_event", f"{ck}/s").awaitTermination()
    (d,) = [r for r in quality.depth(topics.offsets(spark, root)).collect() if r.topic == "dlq.canonical.training_event"]
    assert d.depth == 20 and d.status == "warning"
    found = cli.letters(spark, root, ["dlq.canonical.training_event"])
    assert found.select(*topics.ORDER).distinct().count() == 20
    for count in (1, 7, 30):
        assert quality.replay_plan(found, topics.ORDER, max_count=count).count() == min(count, 20)
    # A replay appends to the topic the letters came from, where both readers find it.
    before = topics.read_batch(spark, root, "raw.strength").count()
    cli.main(["replay", root, "--max-count", "3"], spark)
    assert topics.read_batch(spark, root, "raw.strength").count() == before + 3


def test_keyed_tables_compact(spark, tmp_path):
    table = jobs.KeyedTable(spark, str(tmp_path / "t"), "k STRING, v BIGINT")
    for n in range(40):
        table.write(spark.createDataFrame([(f"k{n % 3}", n), ("all", n)], "k string, v long"), n)
    want = {"all": 39, "k0": 39, "k1": 37, "k2": 38}
    assert {r.k: r.v for r in table.read().collect()} == want
    assert {r.k: r.v for r in table.read(only=spark.createDataFrame([("k1",)], "k string")).collect()} == {"k1": 37}
    assert {r.k: r.v for r in table.read(before=39).collect()}["all"] == 38
    assert len(list((tmp_path / "t").iterdir())) < 2 * table.COMPACT + 4


def test_columns_in_any_order(spark, tmp_path):
    """Files are read by their own header, in streams as in batches; rows that break a rule are kept apart."""
    from paceline.sources import files

    inbox, root = tmp_path / "inbox" / "strength", str(tmp_path / "topics")
    inbox.mkdir(parents=True)
    (inbox / "a.csv").write_text("athlete_id,workout_id,exercise_id,reps,set_number,weight_kg,rpe,rir,timestamp\na,w,squat,9,1,100,8,2,2026-06-20T09:00:00\n")
    (inbox / "b.csv").write_text('﻿timestamp,extra,athlete_id,weight_kg,workout_id,exercise_id,set_number,reps\n2026-06-20,"x,y",b,50,w,press,2,7\n2026-06-20,,b,50,w,press,2,7.5\n')
    batch = {(r.athlete_id, r.set_number, r.reps): r.error for r in files.read_rows(spark, str(inbox), "strength").collect()}
    assert batch[("a", 1, 9)] is None and batch[("b", 2, 7)] is None and "7.5" in batch[("b", 2, None)]
    jobs.ingest_job(spark, str(inbox), root, "strength", str(tmp_path / "ck")).awaitTermination()
    got = {r.key: json.loads(r.value)["payload"] for r in topics.read_batch(spark, root, "raw.strength").collect()}
    assert {k: (p["set_number"], p["reps"]) for k, p in got.items()} == {"a": (1, 9), "b": (2, 7)}
    (bad,) = spark.read.parquet(f"{root}/rejected.strength").collect()
    assert bad.file.endswith("b.csv") and "7.5" in bad.error
    (one, two) = files.summaries(files.read_rows(spark, str(inbox), "strength")).orderBy("file").collect()
    assert (one.published, one.skipped, two.published, two.skipped) == (1, 0, 1, 1)


def test_plans_from_files_to_their_table(spark, tmp_path):
    inbox, root, ck = tmp_path / "inbox", str(tmp_path / "topics"), str(tmp_path / "ck")
    inbox.mkdir()
    plan = {"athlete_id": "a", "block_id": "b", "goal": "g", "start_date": "2026-07-01", "end_date": "2026-09-30", "planned_sessions_per_week": 4, "weekly_volume_targets": {"x": 500}}
    (inbox / "p.json").write_text(json.dumps(plan))
    (inbox / "q.yaml").write_text("athlete_id: a\nblock_id: y\ngoal: g\nstart_date: 2026-07-01\nend_date: 2026-09-30\nplanned_sessions_per_week: 4\nweekly_volume_targets:\n  x: 500\n")
    (inbox / "r.csv").write_text('block_id,athlete_id,goal,start_date,end_date,planned_sessions_per_week,weekly_volume_targets\nc,a,"two\nlines",2026-07-01,2026-07-30,4,"{""x"": 500}"\nd,a,g,2026-07-01,2026-06-30,4,{}\n')
    for _ in range(2):
        jobs.ingest_job(spark, str(inbox), root, "planning", f"{ck}/in").awaitTermination()
        jobs.canonicalize_job(spark, root, "planning", "canonical.planning_block", "dlq.canonical.planning_block", f"{ck}/canon", key="$.athlete_id").awaitTermination()
        jobs.plans_job(spark, root, f"{ck}/plans").awaitTermination()
    plans = jobs.KeyedTable(spark, f"{ck}/plans/plans", jobs.PLANS_DDL).read()
    assert sorted((r.block_id, r.start_date, r.goal) for r in plans.collect()) == [("b", dt.date(2026, 7, 1), "g"), ("c", dt.date(2026, 7, 1), "two\nlines"), ("y", dt.date(2026, 7, 1), "g")]
    assert spark.read.parquet(f"{root}/rejected.planning").count() == 1

    events = spark.createDataFrame([("a", T0 + (912 + k) * DAY_MS, 100.0) for k in range(0, 60, 2)], "athlete_id string, event_time long, session_load double")
    table = spark.createDataFrame([("a", dt.date(2026, 7, 30), 5.0, None)], "athlete_id string, metric_date date, acute_load double, adherence_score double")
    made = {r.metric_date: r for r in jobs.adherence_batch(table, plans, events, F.lit("2026-08-30").cast("date")).collect()}
    assert made[dt.date(2026, 7, 30)].acute_load == 5.0 and made[dt.date(2026, 7, 30)].adherence_score > 0 and made[dt.date(2026, 8, 30)].acute_load is None


def test_days_as_they_grow(spark, tmp_path):
    src, shape = str(tmp_path / "src"), "athlete_id string, session_load double, event_ts timestamp"
    at = lambda day: dt.datetime(2024, 1, 1 + day)
    for rows in ([("a", 5.0, at(0)), ("b", 1.0, at(0))], [("a", 2.0, at(0)), ("a", 3.0, at(1))]):
        spark.createDataFrame(rows, shape).write.mode("append").parquet(src)
        jobs.daily_updates_job(spark.readStream.schema(shape).parquet(src), f"{src}-days", f"{src}-ck").awaitTermination()
    got = jobs.KeyedTable(spark, f"{src}-days", "athlete_id STRING, day DATE, daily_load DOUBLE").read().collect()
    assert sorted((r.athlete_id, str(r.day), r.daily_load) for r in got) == [("a", "2024-01-01", 7.0), ("a", "2024-01-02", 3.0), ("b", "2024-01-01", 1.0)]


def test_commands_of_the_log(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"k{i}", str(i)) for i in range(40)]
    topics.write_batch(spark.createDataFrame(rows[:25], "key string, value string"), root, "raw.cardio")
    topics.write_batch(spark.createDataFrame(rows[25:], "key string, value string"), root, "raw.cardio")
    log = topics.read_batch(spark, root, "raw.cardio")
    assert log.select("partition", "offset").distinct().count() == 40 == topics.offsets(spark, root, ("raw.cardio",)).selectExpr("sum(latest - earliest)").first()[0]
    assert topics.read_batch(spark, root, "raw.cardio", start_offset=1, end_offset=2).count() == log.where("offset = 1").count()
    middle = log.agg(F.max("timestamp")).first()[0]
    assert topics.read_batch(spark, root, "raw.cardio", start_timestamp=middle).count() >= 15
