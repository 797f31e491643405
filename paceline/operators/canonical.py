"""Raw JSON envelopes -> canonical records, with what is wrong with the rest.

Each domain is one projection: the envelope is parsed to VARIANT once, the checks are
an ordered list whose first failure wins, and the record's columns are typed
expressions. Nothing shuffles; valid and rejected rows are two filters of one frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import loads, times
from ..functions.coerce import Json
from ..functions.dlq import envelope
from ..schemas import (
    CARDIO_ACTIVITY,
    NUTRITION_DAILY,
    PLANNING_DDL,
    RECOVERY_SNAPSHOT,
    STRENGTH_SET,
    TRAINING_DDL,
    TRAINING_TYPES,
    WELLNESS_DAILY,
    WELLNESS_DDL,
    WELLNESS_TYPES,
    struct,
)

VALIDATION, TRANSFORM = "VALIDATION_FAILURE", "TRANSFORM_ERROR"
DOMAINS = ("strength", "cardio", "wellness", "nutrition", "recovery", "planning")
_ENVELOPE = ("event_id", "event_time", "ingest_time", "source", "athlete_id", "payload")


def _failure(condition: Column, kind: str, message: str) -> Column:
    return F.when(condition, F.struct(F.lit(kind).alias("error_type"), F.lit(message).alias("error_message")))


def _missing(j: Json, path: str) -> Column:
    return _failure(j.absent(path), VALIDATION, f"missing required field: '{path}'")


def _required(j: Json, paths: tuple[str, ...], payload: tuple[str, ...] = ()) -> list[Column]:
    checks = [_missing(j, p) for p in paths]
    if "payload" in paths:
        checks.append(_failure(~j.is_object("payload"), VALIDATION, "payload must be an object"))
    return checks + [_missing(j, f"payload.{p}") for p in payload]


def _times(j: Json) -> list[Column]:
    return [_failure(_time(j, f).isNull(), TRANSFORM, f"unparseable time: '{f}'") for f in ("event_time", "ingest_time")]


def _time(j: Json, path: str) -> Column:
    return j.millis(path)


def _typed(j: Json, path: str, kind: str) -> Column:
    """A value that is there must be of its kind."""
    made = j.int(path) if kind == "int" else j.double(path)
    return _failure(~j.absent(path) & made.isNull(), TRANSFORM, f"cannot read '{path}' as {kind}")


def _head(j: Json, event_type: Column, schema_version: int) -> dict[str, Column]:
    return {
        "event_id": j.text("event_id"), "event_time": _time(j, "event_time"), "ingest_time": _time(j, "ingest_time"), "source": j.text("source"),
        "schema_version": F.lit(schema_version), "athlete_id": j.text("athlete_id"), "event_type": event_type,
    }


def _fields(j: Json, kinds: dict[str, str], rename: dict[str, str] | None = None) -> dict[str, Column]:
    read = {"int": j.int, "double": j.double, "string": j.text}
    return {(rename or {}).get(name, name): read[kind](f"payload.{name}") for name, kind in kinds.items()}


def _checks(j: Json, kinds: dict[str, str]) -> list[Column]:
    return [_typed(j, f"payload.{name}", kind) for name, kind in kinds.items() if kind != "string"]


_BODY = {"sleep_hours": "double", "resting_hr": "int", "hrv": "double", "steps": "int", "body_weight_kg": "double"}
_FOOD = {"calories": "int", "protein_g": "double", "carbs_g": "double", "fat_g": "double"}
_FEEL = {"energy": "int", "soreness": "int", "mood": "int", "stress": "int", "perceived_recovery": "int"}


def _strength(j: Json, version: int):
    kinds = {"workout_id": "string", "exercise_id": "string", "set_number": "int", "reps": "int", "weight_kg": "double", "rpe": "double", "rir": "double"}
    record = _head(j, F.lit(STRENGTH_SET), version) | _fields(j, kinds)
    record["session_load"] = loads.strength_load(record["reps"], record["weight_kg"], record["rpe"])
    checks = _required(j, _ENVELOPE, ("reps", "weight_kg")) + _times(j) + _checks(j, kinds)
    checks += [_failure(record["rpe"] < 0, VALIDATION, "rpe must not be negative"), _failure(~loads.finite(record["session_load"]), VALIDATION, "session_load must be a finite number")]
    return TRAINING_DDL, record, checks


def _cardio(j: Json, version: int):
    kinds = {"duration_sec": "int", "distance_km": "double", "avg_hr": "int", "tss": "double"}
    record = _head(j, F.lit(CARDIO_ACTIVITY), version) | _fields(j, kinds) | {"activity_type": F.trim(j.text("payload.activity_type"))}
    record["session_load"] = loads.cardio_load(record["tss"], record["avg_hr"], record["duration_sec"])
    checks = _required(j, _ENVELOPE, ("activity_type", "duration_sec")) + _times(j)
    checks += [_failure(~j.is_text("payload.activity_type"), VALIDATION, "activity_type must be a string"), *_checks(j, kinds)]
    checks += [_failure(record["session_load"].isNull(), VALIDATION, "session_load needs tss or avg_hr"), _failure(~loads.finite(record["session_load"]), VALIDATION, "session_load must be a finite number")]
    return TRAINING_DDL, record, checks


def _wellness(j: Json, version: int):
    """The event type is the payload's; a payload that names none is a daily wellness record."""
    kinds = _BODY | _FOOD | {"nutrition_adherence": "double"} | _FEEL
    event_type = F.when(j.absent("payload.event_type"), F.lit(WELLNESS_DAILY)).otherwise(j.text("payload.event_type"))
    record = _head(j, event_type, version) | _fields(j, kinds)
    known = F.coalesce(j.is_text("payload.event_type") | j.absent("payload.event_type"), F.lit(False)) & event_type.isin(*WELLNESS_TYPES)
    checks = _required(j, _ENVELOPE) + _times(j) + _checks(j, kinds) + [_failure(~F.coalesce(known, F.lit(False)), VALIDATION, "unknown event_type")]
    return WELLNESS_DDL, record, checks


def _nutrition(j: Json, version: int):
    kinds = _FOOD | {"adherence_score": "double"}
    record = _head(j, F.lit(NUTRITION_DAILY), version) | _fields(j, kinds, {"adherence_score": "nutrition_adherence"})
    return WELLNESS_DDL, record, _required(j, _ENVELOPE) + _times(j) + _checks(j, kinds)


def _recovery(j: Json, version: int):
    record = _head(j, F.lit(RECOVERY_SNAPSHOT), version) | _fields(j, _BODY)
    return WELLNESS_DDL, record, _required(j, _ENVELOPE) + _times(j) + _checks(j, _BODY)


def _planning(j: Json, version: int):
    """A plan's fields are read from the payload or, without one, from the top level."""
    names = ("block_id", "goal", "start_date", "end_date", "planned_sessions_per_week", "weekly_volume_targets")
    at = lambda name: F.coalesce(j.text(f"payload.{name}"), j.text(name))
    sessions_text = F.trim(at("planned_sessions_per_week"))
    sessions = F.when(sessions_text.rlike(r"^[+-]?\d+(\.0+)?$"), sessions_text.try_cast("double").try_cast("int"))
    targets = F.try_parse_json(at("weekly_volume_targets"))
    record = {k: c for k, c in _head(j, F.lit(None), version).items() if k != "event_type"} | {
        "block_id": at("block_id"), "goal": at("goal"), "start_date": times.iso_to_ms(at("start_date")), "end_date": times.iso_to_ms(at("end_date")),
        "planned_sessions_per_week": sessions, "weekly_volume_targets": F.to_json(targets),
    }
    checks = _required(j, tuple(f for f in _ENVELOPE if f != "payload")) + [_failure(at(n).isNull(), VALIDATION, f"missing required field: '{n}'") for n in names]
    checks += [
        _failure(targets.isNull(), VALIDATION, "weekly_volume_targets is not valid JSON"),
        _failure(at("end_date") < at("start_date"), VALIDATION, "end_date must not be before start_date"),
        _failure(sessions.isNull(), VALIDATION, "planned_sessions_per_week must be a whole number"),
        _failure(sessions <= 0, VALIDATION, "planned_sessions_per_week must be over 0"),
        _failure(record["start_date"].isNull() | record["end_date"].isNull(), TRANSFORM, "unparseable date"),
        *_times(j),
    ]
    return PLANNING_DDL, record, checks


_BUILD = {"strength": _strength, "cardio": _cardio, "wellness": _wellness, "nutrition": _nutrition, "recovery": _recovery, "planning": _planning}


def canonicalize(raw: DataFrame, domain: str, schema_version: int = 1, value: str = "value") -> DataFrame:
    """`raw` (a JSON text a row) with `error` (null for valid rows) and `record` (null for rejected ones)."""
    j = Json()
    ddl, record, checks = _BUILD[domain](j, schema_version)
    unreadable = _failure(~F.col("is_object"), TRANSFORM, "not a JSON object")
    columns = [record.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(ddl)]
    judged = F.struct(F.coalesce(unreadable, *checks).alias("error"), F.struct(*columns).alias("record"))
    # As with the values: filters on `error` don't copy the checks.
    read = j.read(raw, value).select(*raw.columns, F.inline(F.array(judged)))
    return read.withColumn("record", F.when(F.col("error").isNull(), F.col("record")))


def valid_records(canonical: DataFrame) -> DataFrame:
    return canonical.where("error is null").select("record.*")


def rejected(canonical: DataFrame, topic: str, now_ms: Column | None = None, value: str = "value", key: str = "$.event_id") -> DataFrame:
    """Dead-letter envelopes of the rows that broke a rule."""
    bad = canonical.where("error is not null")
    of_key = F.coalesce(F.get_json_object(F.col(value), key), F.lit(""))
    return bad.select(*envelope(F.lit(topic), of_key, F.col(value), F.col("error.error_type"), F.col("error.error_message"), now_ms))


def validate_training(events: DataFrame) -> DataFrame:
    """`events` with `error` for canonical training records that must not go on."""
    required = ("event_id", "event_time", "ingest_time", "source", "schema_version", "athlete_id", "event_type", "session_load")
    checks = [_failure(F.col(c).isNull(), VALIDATION, f"missing required field: '{c}'") for c in required]
    checks += [_failure(~F.col("event_type").isin(*TRAINING_TYPES), VALIDATION, "unknown event_type"), _failure(~loads.finite(F.col("session_load")), VALIDATION, "session_load must be a finite number")]
    return events.withColumn("error", F.coalesce(*checks))


def validate_raw(raw: DataFrame, domain: str, value: str = "value") -> DataFrame:
    """The stand-alone check of raw cardio, nutrition and recovery envelopes."""
    paths = {"cardio": ("event_id", "event_time", "athlete_id"), "nutrition": ("athlete_id", "event_time"), "recovery": ("athlete_id", "event_time")}[domain]
    payload = ("activity_type", "duration_sec") if domain == "cardio" else ()
    j = Json()
    checks = [_missing(j, p) for p in paths]
    if payload:
        checks += [_failure(~j.is_object("payload"), VALIDATION, "payload must be an object")] + [_missing(j, f"payload.{p}") for p in payload]
    unreadable = _failure(~F.col("is_object"), VALIDATION, "not a JSON object")
    return j.read(raw, value).select(*raw.columns, F.inline(F.array(F.struct(F.coalesce(unreadable, *checks).alias("error")))))
