"""Files, topics, the lake, merges, duplicates, late data and the serving queries."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from paceline.functions import times
from paceline.operators import adherence, dedup, merge, parity, serving, wellness
from paceline.schemas import DAY_MS, TRAINING_DDL
from paceline.sources import demo, files, lake, topics
from paceline.streaming import late


def test_strength_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("athlete_id,workout_id,exercise_id,set_number,reps,weight_kg,rpe,rir,timestamp\nathlete-1,w,squat,1,5,100.0,8.0,,2026-06-20T09:00:00\n,w,squat,1,5,100.0,,,2026-06-20T09:00:00\n")
    (tmp_path / "b.csv").write_text("timestamp,athlete_id,workout_id,exercise_id,set_number,reps,weight_kg,rpe\nlater,a,w,x,1,5,1,\n2026-06-20,a,w,x,1,5.5,1,\n2026-06-20,a,w,x,1,5,1,hard\n")
    (tmp_path / "skip.txt").write_text("x")
    rows = [files.read_rows(spark, str(tmp_path / n), "strength") for n in ("a.csv", "b.csv")]
    got = [tuple(r) for df in rows for r in df.select("athlete_id", "reps", "weight_kg", "rir", "error").collect()]
    assert got[0] == ("athlete-1", 5, 100.0, None, None)
    assert [g[-1] and g[-1].split(":")[0] for g in got[1:]] == ["missing required field", "unparseable timestamp for 'timestamp'", "unparseable int for 'reps'", "unparseable double for 'rpe'"]


def test_cardio_alias_and_dates(spark, tmp_path):
    (tmp_path / "c.csv").write_text("athlete_id,activity_type,duration_sec,start_date,avg_hr\na,run,60,2026-01-01T00:00:00,\n")
    assert files.read_rows(spark, str(tmp_path), "cardio").first().timestamp == "2026-01-01T00:00:00"
    cells = spark.createDataFrame([("a", "2026-02-30"), ("a", "2026-02-28")], "athlete_id string, date string").selectExpr("*", "cast(null as string) calories", "'' protein_g", "'1.5' carbs_g", "null fat_g", "null adherence_score")
    assert [r.error is None for r in files.typed_rows(cells, "nutrition").collect()] == [False, True]


def test_plans_in_three_formats(spark, tmp_path):
    plan = {"athlete_id": "a", "block_id": "b", "goal": "g", "start_date": "2026-07-01", "end_date": "2026-09-30", "planned_sessions_per_week": 4, "weekly_volume_targets": {"x": 500}}
    (tmp_path / "p.json").write_text(json.dumps(plan, indent=1))
    (tmp_path / "q.yaml").write_text("athlete_id: a\nblock_id: y\ngoal: g\nstart_date: 2026-07-01\nend_date: 2026-09-30\nplanned_sessions_per_week: 4\nweekly_volume_targets:\n  x: 500\n")
    (tmp_path / "bad.yml").write_text("a: [1\n")
    (tmp_path / "r.csv").write_text('athlete_id,block_id,goal,start_date,end_date,planned_sessions_per_week,weekly_volume_targets\na,c,g,2026-07-01,2026-06-30,4,"{""x"": 500}"\n')
    got = {r.block_id: r for r in files.read_plans(spark, str(tmp_path)).collect()}
    assert got["b"].error is None and got["y"].error is None and "before" in got["c"].error and "missing" in got[None].error
    assert json.loads(got["y"].weekly_volume_targets) == {"x": 500} and got["y"].start_date == "2026-07-01"


def test_envelopes_repeat_their_ids(spark):
    rows = spark.createDataFrame([("a", "2026-01-01", 7.5)], "athlete_id string, date string, sleep_hours double").selectExpr("*", "50 as resting_hr", "60.0 as hrv", "1 as steps", "70.0 as body_weight_kg")
    one, two = (json.loads(files.envelopes(rows, "recovery", F.lit(n)).first().value) for n in (1, 2))
    assert one["event_id"] == two["event_id"] and one["event_time"] == 1767225600000 and one["payload"]["sleep_hours"] == 7.5 and "athlete_id" not in one["payload"]


def test_topics(spark, tmp_path):
    root = str(tmp_path)
    topics.write_batch(spark.createDataFrame([("k", "1"), ("k", "2")], "key string, value string"), root, "raw.strength")
    topics.write_batch(spark.createDataFrame([("k", "3")], "key string, value string"), root, "raw.strength", first_offset=1 << 40)
    assert topics.read_batch(spark, root, "raw.strength").count() == 3
    assert [r.value for r in topics.read_batch(spark, root, "raw.strength", start_offset=1 << 40).collect()] == ["3"]
    assert topics.read_batch(spark, root, "raw.strength", start_timestamp=1 << 50).count() == 0
    with pytest.raises(ValueError):
        topics.path_of(root, "other")
    log = spark.createDataFrame([("k", "1", "raw.strength", 0, 0), ("k", "2", "raw.strength", 1, 5 * DAY_MS), ("k", "3", "raw.planning", 0, 0), ("j", "4", "raw.strength", 2, 0)], topics.SHAPE)
    assert sorted(r.value for r in topics.expired(log, 8 * DAY_MS).collect()) == ["1", "4"]
    assert sorted(r.value for r in topics.compacted(log).collect()) == ["2", "3", "4"]
    (r,) = topics.offsets(spark, root, ("raw.strength",)).collect()
    assert 0 <= r.earliest < 1 << 40 < r.latest


def training(spark, rows):
    return spark.createDataFrame([(f"e{i}", t, t, "s", 1, a, "STRENGTH_SET", *[None] * 12, load) for i, (a, t, load) in enumerate(rows)], TRAINING_DDL)


def test_lake(spark, tmp_path):
    path, to = str(tmp_path / "lake"), str(tmp_path / "small")
    lake.append(training(spark, [("a", 5, 1.0), ("b", DAY_MS + 5, 2.0)]), path)
    lake.append(training(spark, [("a", 6, 3.0)]), path)
    assert lake.read(spark, path).count() == 3
    plan = lake.read(spark, path).where("event_day = date'1970-01-02'")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(event_day" in plan._jdf.queryExecution().toString()
    lake.compact(spark, path, to)
    assert lake.read(spark, to).count() == 3 and len(list((tmp_path / "small").glob("event_day=1970-01-01/*.parquet"))) <= 2
    lake.expire_before(spark, to, "1970-01-02", str(tmp_path / "late"))
    assert [r.athlete_id for r in lake.read(spark, str(tmp_path / "late")).collect()] == ["b"]
    some = sorted(str(p) for p in (tmp_path / "small").glob("*/*.parquet"))[:1]
    (tmp_path / "manifest.json").write_text(json.dumps(some))
    assert 0 < lake.read_files(spark, str(tmp_path / "manifest.json")).count() < 3


def test_first_by_id_keeps_rows_without_ids(spark):
    rows = [("a", 2), ("a", 1), ("", 3), ("", 4), (None, 5), (None, 6), ("b", 7)]
    got = dedup.first_by_id(spark.createDataFrame(rows, "event_id string, n int"), "n").collect()
    assert sorted(r.n for r in got) == [1, 3, 4, 5, 6, 7]
    seen = spark.createDataFrame([("b",)], "event_id string")
    assert dedup.unseen(spark.createDataFrame(rows, "event_id string, n int"), seen).count() == 6


def test_late_rule(spark):
    rows = [(0, 3 * DAY_MS), (1, DAY_MS - 1), (2, DAY_MS), (3, 0), (250_000, 0), (250_001, 9 * DAY_MS), (250_002, 6 * DAY_MS)]
    got = late.late_by_arrival(spark.createDataFrame(rows, "n long, event_time long"), "n").orderBy("n").collect()
    assert [r.late for r in got] == [False, True, False, True, True, False, True]


def test_upsert_is_idempotent(spark):
    table = spark.createDataFrame([("a", 1, 10.0, None), ("b", 1, 20.0, 5.0)], "k string, d int, x double, y double")
    new = spark.createDataFrame([("a", 1, 7.0, 1), ("a", 1, 8.0, 2), ("c", 1, 9.0, 1), ("b", 1, None, 1)], "k string, d int, y double, at int")
    once = merge.upsert_columns(table, new, ["k", "d"], ["y"], arrival="at")
    assert sorted(map(tuple, once.collect())) == [("a", 1, 10.0, 8.0), ("b", 1, 20.0, None), ("c", 1, None, 9.0)]
    assert sorted(map(tuple, merge.upsert_columns(once, new, ["k", "d"], ["y"], arrival="at").collect())) == sorted(map(tuple, once.collect()))
    again = merge.insert_absent(table, table.unionByName(table.withColumn("k", F.lit("z"))), ["k", "d"])
    assert again.count() == 3


def test_parity(spark):
    pg = spark.createDataFrame([("a", 0), ("b", 0)], "athlete_id string, ms long")
    held = spark.createDataFrame([("a", 5), ("c", DAY_MS + 5), ("c", DAY_MS + 6)], "athlete_id string, ms long")
    got = parity.parity(pg, held, F.col("ms"), times.day_start_ms(F.col("ms"))).collect()
    assert sorted(map(tuple, got)) == [("b", 0, "iceberg_missing"), ("c", DAY_MS, "pg_missing")]


def test_adherence_revisions(spark):
    day = dt.date(2026, 7, 1)
    plans = [("a", "b", n, "g", day, day + dt.timedelta(28), psw, "{}") for n, psw in ((1, 3), (2, 5))] + [("z", "b", 1, "g", day, day + dt.timedelta(28), 2, "bad"), ("n", "b", 1, "g", day, day, 0, "{}")]
    plans = spark.createDataFrame(plans, "athlete_id string, block_id string, ingest_time long, goal string, start_date date, end_date date, planned_sessions_per_week int, weekly_volume_targets string")
    daily = spark.createDataFrame([("a", day + dt.timedelta(k), 10.0) for k in (0, 3, 5, 9, 28, 29)], "athlete_id string, day date, daily_load double")
    got = {r.athlete_id: r for r in adherence.adherence_scores(plans, daily, F.lit("2027-01-01").cast("date")).collect()}
    assert (got["a"].adherence_score, got["a"].actual_sessions, got["z"].adherence_score) == (0.25, 5, 0.0) and "n" not in got
    early = {r.athlete_id: r for r in adherence.adherence_scores(plans, daily, F.lit("2026-07-04").cast("date")).collect()}
    assert early["a"].actual_sessions == 2 and early["a"].metric_date == dt.date(2026, 7, 4)


def test_recovery_last_arrival(spark):
    rows = [("a", 5, 1, 60.0, None, None), ("a", 6, 2, None, None, None), ("a", 7, 0, 120.0, None, None)]
    got = wellness.recovery_scores(spark.createDataFrame(rows, "athlete_id string, event_time long, ingest_time long, hrv double, sleep_hours double, perceived_recovery int")).collect()
    assert [(r.athlete_id, r.recovery_score) for r in got] == [("a", 25.0)]


def test_serving(spark):
    day = lambda n: dt.date(2026, 1, n)
    rows = [("a", day(1), 1.0, 1.0, 1.2, 10.0, 20.0), ("a", day(4), 3.0, 1.0, 1.4, 30.0, 40.0), ("b", day(2), None, None, None, None, None), ("x", day(2), 9.0, 1.0, 9.0, 1.0, 1.0)]
    metrics = spark.createDataFrame(rows, "athlete_id string, metric_date date, acute_load double, chronic_load_28d double, acute_chronic_ratio double, fatigue_score double, readiness_score double")
    people = spark.createDataFrame([("a", "Ann", "run"), ("b", "Bo", "run"), ("c", "Cy", None)], "athlete_id string, name string, sport string")
    (s,) = serving.by_sport(metrics, people).collect()
    assert (s.sport, s.athlete_count, s.avg_acute_load, s.avg_acr) == ("run", 2, 3.0, 1.4)
    (r,) = serving.risk_distribution(metrics, people).collect()
    assert (r.safe, r.caution, r.danger, r.unknown) == (0, 1, 0, 1)
    assert {x.athlete_id: x.sport for x in serving.athlete_directory(metrics, people).collect()} == {"a": "run", "b": "run", "x": None}
    assert [x.athlete_id for x in serving.athlete_search(people, "N").collect()] == ["a"]
    assert [x.athlete_id for x in serving.athlete_search(people, "", "Other").collect()] == ["c"]
    dense = serving.densify(metrics.where("athlete_id = 'a'"), ["acute_load"]).orderBy("metric_date").collect()
    assert [x.acute_load for x in dense] == [1.0, None, None, 3.0]
    ranked = serving.sport_ranking(spark.createDataFrame([("p", None), ("q", 2.0), ("r", 1.0)], "sport string, v double"), "v").collect()
    assert [x.sport for x in ranked] == ["q", "r", "p"]
    assert serving.chart_domain(metrics).first().upper == 10.0 and serving.chart_domain(metrics.limit(0)).first().upper == 200.0
    assert serving.sport_exists(people, "run") and not serving.sport_exists(people, "golf")
    both = serving.athlete_vs_sport(metrics, people, "a", F.lit("2026-01-01").cast("date"), F.lit("2026-01-31").cast("date"))
    assert both.count() == 2


def test_demo_repeats(spark):
    squad = demo.athletes(spark, 24)
    once, twice = (sorted(map(tuple, demo.metrics(spark, squad, "2026-01-31", 10).collect())) for _ in range(2))
    assert once == twice and len(once) == 240 and squad.select("sport").distinct().count() == 12


def test_a_squad_of_six_digits(spark):
    squad = demo.athletes(spark, 100_020).where("athlete_id >= 'demo-09998'")
    ids = [r.athlete_id for r in squad.select("athlete_id").collect()]
    assert len(set(ids)) == len(ids) and "demo-100019" in ids and "demo-10001" in ids
    some = squad.where("athlete_id in ('demo-10001', 'demo-100018', 'demo-100019')")
    metrics = demo.metrics(spark, some, "2026-01-31", 10)
    assert metrics.join(some, "athlete_id").count() == 30
    # The noise is that of the first five digits, so these three differ by their base loads only.
    ratio = {(r.athlete_id, r.metric_date): r.acute_chronic_ratio for r in metrics.collect()}
    assert all(ratio["demo-100018", d] == pytest.approx(ratio[a, d], rel=1e-12) for a, d in ratio)


def test_messages_of_metrics(spark):
    from paceline.operators import serialize

    rows = [("a", dt.date(2024, 1, 1), 1.0, 2.0, 3.0, float("nan"), 0, None, 5.0, '["monitor"]'), ("b", dt.date(2024, 1, 1), float("inf"), 2.0, 3.0, None, 0, None, None, "[]"), ("c", dt.date(2024, 1, 1), None, 2.0, 3.0, None, 0, None, None, "[]")]
    metrics = spark.createDataFrame(rows, "athlete_id string, metric_date date, acute_load double, chronic_load_28d double, chronic_load_42d double, acute_chronic_ratio double, deload_flag int, fatigue_score double, readiness_score double, coaching_flags string")
    (m,) = serialize.metrics_messages(metrics).collect()
    assert json.loads(m.value) == {"athlete_id": "a", "metric_date": 1704067200000, "acute_load": 1.0, "chronic_load_28d": 2.0, "chronic_load_42d": 3.0, "acute_chronic_ratio": None, "fatigue_score": None, "readiness_score": 5.0, "deload_flag": 0, "coaching_flags": ["monitor"]}
    assert sorted(r.original_key for r in serialize.metrics_rejected(metrics).collect()) == ["b", "c"]


def test_files_of_any_width(spark, tmp_path):
    from paceline.sources import files

    extra = [f"x{i}" for i in range(95)]
    columns = ["athlete_id", *extra, "date", "sleep_hours", "resting_hr", "hrv", "steps", "body_weight_kg"]
    cells = ["a", *['"q, ""w"""' if i % 3 else "" for i in range(95)], "2026-01-01", "7.5", "50", "", "1", '"70"']
    (tmp_path / "wide.csv").write_text(",".join(columns) + "\n" + ",".join(cells) + "\n" + ",".join([*cells[:-1], ""]) + "\n")
    (tmp_path / "narrow.csv").write_text("date,athlete_id,hrv\n2026-01-02,b,61\n")
    rows = sorted(files.read_rows(spark, str(tmp_path), "recovery").collect(), key=lambda r: (r.athlete_id, r.body_weight_kg or 0))
    assert [(r.athlete_id, r.sleep_hours, r.hrv, r.steps, r.body_weight_kg, r.error) for r in rows] == [("a", 7.5, None, 1, None, None), ("a", 7.5, None, 1, 70.0, None), ("b", None, 61.0, None, None, None)]
    (wide,) = [r for r in files._lines(spark.read, str(tmp_path), "recovery").collect() if "7.5" in r.cells and "70" in r.cells]
    assert len(wide.cells) == len(columns) and wide.cells[1] is None and wide.cells[2] == 'q, "w"'


def test_densify_joins_no_days(spark, tmp_path):
    """Gaps within a block of days, over its border and over whole blocks; days before 1970; an athlete of one day."""
    days = {"a": [-130, -61, -60, -59, -1, 0, 1, 59, 60, 61, 400], "b": [19_800], "c": [19_799, 19_801]}
    epoch = dt.date(1970, 1, 1)
    rows = [(a, epoch + dt.timedelta(k), float(k), None if k % 2 else k) for a, held in days.items() for k in held]
    spark.createDataFrame([*rows, ("c", None, 5.0, 1)], "athlete_id string, metric_date date, x double, n int").write.parquet(str(tmp_path / "m"))
    dense = serving.densify(spark.read.parquet(str(tmp_path / "m")), ["x", "n"])
    assert "Join" not in dense._jdf.queryExecution().executedPlan().toString()  # a join of days broadcast one side
    known = {(a, d): (x, n) for a, d, x, n in rows}
    want = {(a, d): known.get((a, d), (None, None)) for a, held in days.items() for k in range(held[0], held[-1] + 1) for d in [epoch + dt.timedelta(k)]}
    got = dense.collect()
    assert len(got) == len(want) and {(r.athlete_id, r.metric_date): (r.x, r.n) for r in got} == want
