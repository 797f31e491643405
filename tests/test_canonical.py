import base64
import json

import pytest
from pyspark.sql import functions as F

from paceline.functions import dlq
from paceline.operators import canonical, quality
from paceline.schemas import TRAINING_DDL, is_backward_compatible, struct

STRENGTH = {"event_id": "e", "event_time": "2026-06-20T09:00:00", "ingest_time": "2026-06-20T10:00:00", "source": "s", "athlete_id": "a", "payload": {"reps": 8, "weight_kg": 100, "rpe": 8.5, "set_number": 1}}
CARDIO = {"event_id": "e", "event_time": 5, "ingest_time": 6, "source": "s", "athlete_id": "a", "payload": {"activity_type": " run ", "duration_sec": 3600, "tss": 85.0}}
PLAN = {"block_id": "b", "goal": "g", "start_date": "2026-07-01", "end_date": "2026-09-30", "planned_sessions_per_week": 4, "weekly_volume_targets": '{"x": 500}'}


def run(spark, domain, *raws):
    rows = [(r if isinstance(r, str) else json.dumps(r),) for r in raws]
    return canonical.canonicalize(spark.createDataFrame(rows, "value string"), domain).collect()


def changed(raw, path, value):
    out = json.loads(json.dumps(raw))
    *way, last = path.split(".")
    at = out
    for k in way:
        at = at[k]
    at[last] = value
    return out


def test_strength_record(spark):
    (r,) = run(spark, "strength", STRENGTH)
    assert r.error is None and (r.record.session_load, r.record.event_type, r.record.event_time, r.record.reps) == (680.0, "STRENGTH_SET", 1781946000000, 8)
    assert [f.name for f in struct(TRAINING_DDL)] == list(r.record.asDict())


@pytest.mark.parametrize(
    ("path", "value", "kind"),
    [
        ("event_id", None, "VALIDATION_FAILURE"), ("payload", [1], "VALIDATION_FAILURE"), ("payload.reps", None, "VALIDATION_FAILURE"), ("payload.reps", True, "TRANSFORM_ERROR"), ("payload.reps", "x", "TRANSFORM_ERROR"),
        ("payload.reps", 5.5, "TRANSFORM_ERROR"), ("event_time", "soon", "TRANSFORM_ERROR"), ("payload.rpe", -1, "VALIDATION_FAILURE"), ("payload.weight_kg", "nan", "VALIDATION_FAILURE"), ("payload.set_number", "1.5", "TRANSFORM_ERROR"),
    ],
)
def test_strength_failures(spark, path, value, kind):
    (r,) = run(spark, "strength", changed(STRENGTH, path, value))
    assert r.record is None and r.error.error_type == kind


def test_first_failure_wins_and_garbage_is_no_object(spark):
    both = changed(changed(STRENGTH, "event_id", None), "payload.reps", "x")
    got = run(spark, "strength", both, "{broken", "[1]", "", "5")
    assert "event_id" in got[0].error.error_message and {r.error.error_message for r in got[1:]} == {"not a JSON object"}


def test_cardio(spark):
    ok, by_heart, none, text = run(spark, "cardio", CARDIO, changed(changed(CARDIO, "payload.tss", None), "payload.avg_hr", 110), changed(CARDIO, "payload.tss", None), changed(CARDIO, "payload.activity_type", 5))
    assert (ok.record.activity_type, ok.record.session_load, by_heart.record.session_load) == ("run", 85.0, 50.0)
    assert none.error.error_type == text.error.error_type == "VALIDATION_FAILURE"


def test_wellness_family(spark):
    base = {**{k: CARDIO[k] for k in ("event_id", "event_time", "ingest_time", "source", "athlete_id")}, "payload": {"hrv": "61.5", "calories": 2000, "adherence_score": 0.9, "steps": 10}}
    (w,) = run(spark, "wellness", base)
    (n,) = run(spark, "nutrition", base)
    (r,) = run(spark, "recovery", base)
    assert (w.record.event_type, n.record.event_type, r.record.event_type) == ("WELLNESS_DAILY", "NUTRITION_DAILY", "RECOVERY_SNAPSHOT")
    assert (w.record.hrv, n.record.nutrition_adherence, r.record.steps, n.record.steps) == (61.5, 0.9, 10, None)
    (bad,) = run(spark, "wellness", changed(base, "payload.event_type", "OTHER"))
    assert bad.error.error_type == "VALIDATION_FAILURE"


def test_planning_in_both_shapes(spark):
    head = {k: CARDIO[k] for k in ("event_id", "event_time", "ingest_time", "source", "athlete_id")}
    nested, flat = run(spark, "planning", {**head, "payload": PLAN}, {**head, **PLAN})
    assert nested.record == flat.record and nested.record.start_date == 1782864000000 and json.loads(nested.record.weekly_volume_targets) == {"x": 500}
    for path, value in (("end_date", "2026-06-01"), ("planned_sessions_per_week", 0), ("weekly_volume_targets", "{"), ("goal", None)):
        (r,) = run(spark, "planning", {**head, "payload": changed(PLAN, path, value)})
        assert r.error.error_type == "VALIDATION_FAILURE", path


def test_letters_round_trip(spark):
    raw = spark.createDataFrame([("{broken é",), (json.dumps(STRENGTH),)], "value string")
    bad = canonical.rejected(canonical.canonicalize(raw, "strength"), "raw.strength", F.lit(7))
    letters = dlq.decode(bad.select(F.lit("dlq.canonical.training_event").alias("topic"), F.to_json(F.struct("*")).alias("value"))).collect()
    assert [bytes(r.payload).decode() for r in letters] == ["{broken é"] and letters[0].original_topic == "raw.strength" and letters[0].timestamp == 7


def test_corrupt_letters_and_replay(spark):
    good = {"original_topic": "raw.strength", "original_value": base64.b64encode(b"x").decode(), "original_key": None, "error_type": "LATE_DATA", "timestamp": 1}
    rows = [good, {**good, "original_value": None}, {"original_value": "eA=="}, {**good, "original_topic": "dlq.canonical.training_event"}, {**good, "original_value_truncated": True}, {**good, "original_value": ""}, {**good, "original_value": base64.b64encode(b"x" * 50).decode()}]
    values = [json.dumps(r) for r in rows] + ["nope"]
    letters = dlq.decode(spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], "topic string, offset long, value string"))
    planned = quality.replay_plan(letters, "offset", max_bytes=20)
    assert [r.outcome for r in planned.orderBy("offset").collect()] == ["replayed", *["skipped_unrecoverable"] * 5, "skipped_oversized", "skipped_unrecoverable"]
    few = quality.replay_plan(letters, "offset", max_bytes=20, max_count=2)
    assert few.count() == 2 and quality.replay_report(planned).first().skipped_oversized == 1
    assert quality.replay_plan(letters, "offset", max_count=100).count() == len(values)


def test_age_fenceposts(spark):
    day, now = 86_400_000, 10**12
    ages = [(-1, "clock_skew"), (0, "<1d"), (day - 1, "<1d"), (day, "1-3d"), (3 * day, "3-6d"), (6 * day - 1, "3-6d"), (6 * day, ">6d"), (7 * day - 1, ">6d"), (7 * day, "expired")]
    df = spark.createDataFrame([(now - a,) for a, _ in ages] + [(None,)], "t long")
    assert [r[0] for r in df.select(dlq.age_bucket(F.col("t"), F.lit(now))).collect()] == [b for _, b in ages] + ["null_ts"]


def test_oversized_payloads_are_dropped_and_marked(spark):
    made = dlq.envelope(F.lit("t"), F.lit("k"), F.col("v"), F.lit("e"), F.lit("m"), F.lit(1), max_bytes=3)
    rows = spark.createDataFrame([("abc",), ("abcd",), (None,), ("éé",)], "v string").select(*made).collect()
    assert [(r.original_value, r.original_value_truncated, r.original_value_size_bytes) for r in rows] == [("YWJj", False, 3), ("", True, 4), ("", False, 0), ("", True, 4)]


def test_schema_evolution():
    old = struct("a STRING, b INT")
    assert is_backward_compatible(old, struct("a STRING, b INT, c DOUBLE"))
    assert not is_backward_compatible(old, struct("a STRING")) and not is_backward_compatible(old, struct("a STRING, b BIGINT"))


def test_times_of_any_form_and_no_cast_of_iso_texts(spark):
    from pyspark.sql import functions as F

    from paceline.functions import times

    texts = ["2024-02-01T00:00:01Z", "2024-02-01", "2024-13-01", "2024-", "2024", "-2024", "-5", "3.0", "3.5", "1e3", " 7 ", "soon", "", None, " 2024-02-01", "99999999999999999999"]
    ms = times.flexible_ms(F.col("t"))
    got = [r.ms for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ms.alias("ms")).collect()]
    assert got == [1706745601000, 1706745600000, None, None, 2024, -2024, -5, 3, None, 1000, 7, None, None, None, None, None]
    # An ISO text is told before anything is cast to a number.
    plan = spark.createDataFrame([("x",)], "t string").select(ms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CASE WHEN RLIKE(t") < plan.index("double") and "coalesce(" not in plan.lower()
