"""What all detectors share.

A detector is a function ``(requests, profile, cfg) -> DataFrame`` that returns
sessions with a typed ``evidence`` struct. Single-address detectors return one row
per address. A session that ties several addresses together carries its key, its
smallest address and how many there are; the addresses are rows of the member table.
Paths behind the evidence are rows of ``evidence_counts``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.config import Config
from tracewarden.functions.net import is_internal_ip
from tracewarden.operators.profile import span_seconds

SESSION_COLUMNS = (
    "attack_type", "session_key", "ip", "ip_count", "start_time", "end_time", "duration_seconds",
    "request_count", "total_bytes", "layer", "is_internal", "mitre_id", "evidence", "ip_rotation_detected",
    "coordinated", "shared_user_agent",
)


def basic_totals(*more: Column) -> list[Column]:
    """Totals of a group from its (address, agent) totals."""
    return [
        F.min("first_seen").alias("start_time"),
        F.max("last_seen").alias("end_time"),
        F.sum("total_requests").alias("request_count"),
        F.sum("total_bytes").alias("total_bytes"),
        *more,
    ]


def join_on(keys, first: DataFrame, *others: DataFrame) -> DataFrame:
    """Left joins of per-group parts; every part has one row per group."""
    return reduce(lambda left, right: left.join(right, keys, "left"), others, first)


def as_sessions(df: DataFrame, attack_type: str, cfg: Config) -> DataFrame:
    """Bring a detector's findings into the session schema."""
    ip = F.col("ip")
    defaults = {
        "session_key": ip,
        "ip_count": F.lit(1).cast("bigint"),
        "is_internal": is_internal_ip(ip),
        "duration_seconds": span_seconds(F.col("start_time"), F.col("end_time")),
        "ip_rotation_detected": F.lit(False),
        "coordinated": F.lit(False),
        "shared_user_agent": F.lit(None).cast("string"),
    }
    filled = df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
    return filled.withColumns(
        {"attack_type": F.lit(attack_type), "mitre_id": F.lit(cfg.mitre_ids[attack_type])}
    ).select(*SESSION_COLUMNS)
