"""Command line: reports over dead letters, and their replay.

    python -m paceline.cli quality TOPICS_ROOT [--now TIME] [--topic NAME ...] [--start-offset N] [--start-time TIME]
    python -m paceline.cli replay TOPICS_ROOT [--error-type T] [--max-count N] [--max-bytes N] [--dry-run]

A TIME is epoch milliseconds or an ISO text (UTC where it has no offset).
"""

from __future__ import annotations

import argparse
import json
import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dlq
from .operators import quality
from .schemas import DLQ_TOPICS, MAX_REPLAY_BYTES
from .sources import topics


def parse_time(text: str) -> int:
    """Epoch milliseconds of a whole number or an ISO text."""
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    when = datetime.fromisoformat(text)
    return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() * 1000)


def safe_name(text: str) -> str:
    """A name for paths and topics: letters, digits, dots, dashes, slashes, underscores and colons only."""
    if not re.fullmatch(r"[\w./:-]+", text):
        raise ValueError(f"not a plain name: {text!r}")
    return text


def letters(spark: SparkSession, root: str, names: list[str], start_offset: int | None = None, start_time: int | None = None) -> DataFrame:
    """Decoded letters of the topics, with `topic`, `partition` and `offset`."""
    out = None
    for name in names:
        one = topics.read_batch(spark, root, name, start_offset, start_time).select(*topics.ORDER, "value")
        out = one if out is None else out.unionByName(one)
    return dlq.decode(out)


def quality_report(found: DataFrame, now_ms: int) -> dict[str, list[dict]]:
    """All reports; each has a row a topic and class at most, so they fit the driver."""
    aged = quality.ages(found, F.lit(now_ms))
    parts = {"scan": quality.scan_counters(found), "error_types": quality.error_types(found), "ages": aged, "triage": quality.triage(found), "warnings": quality.retention_warning(aged), "samples": quality.samples(found, *topics.ORDER)}
    return {name: [r.asDict() for r in df.collect()] for name, df in parts.items()}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("quality", "replay"))
    parser.add_argument("root", type=safe_name)
    parser.add_argument("--topic", action="append", type=safe_name)
    parser.add_argument("--now", type=parse_time)
    parser.add_argument("--start-offset", type=int)
    parser.add_argument("--start-time", type=parse_time)
    parser.add_argument("--error-type")
    parser.add_argument("--max-count", type=int)
    parser.add_argument("--max-bytes", type=int, default=MAX_REPLAY_BYTES)
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = letters(spark, args.root, args.topic or list(DLQ_TOPICS), args.start_offset, args.start_time)
    if args.command == "quality":
        now = args.now if args.now is not None else int(datetime.now(UTC).timestamp() * 1000)
        out = quality_report(found, now)
    else:
        planned = quality.replay_plan(found, topics.ORDER, args.error_type, args.max_count, args.max_bytes)
        out = {"report": [r.asDict() for r in quality.replay_report(planned).collect()], "replayed_to": topics.replay(planned, args.root, args.dry_run), "dry_run": args.dry_run}
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
