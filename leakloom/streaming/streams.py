"""The same detection and redaction on streams of appended lines, and deduplication within a lateness bound."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.detect import detect_all
from ..operators.redact import redact_all


def detect_stream(lines: DataFrame, text: str = "text", now: int = 0) -> DataFrame:
    """detect_all on a stream; it keeps no state."""
    return detect_all(lines, text, now=now)


def redact_stream(lines: DataFrame, text: str = "text") -> DataFrame:
    """redact_all on a stream; it keeps no state."""
    return redact_all(lines, text)


def dedup_stream(findings: DataFrame, event_time: str = "ts", lateness: str = "10 minutes", keys: tuple[str, ...] = ("host_id", "fingerprint")) -> DataFrame:
    """The first finding of each fingerprint within the lateness bound. Locations of later ones are not gathered, unlike the batch form."""
    return findings.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(keys))
