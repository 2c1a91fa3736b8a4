"""Failed logins of several external addresses within one five-minute bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.operators.detectors.base import as_sessions, join_on
from tracewarden.operators.facts import Facts, lazy_facts

ATTACK_TYPE = "distributed_credential_stuffing"


def session_key():
    return F.unix_seconds("bucket").cast("string")


def flagged_buckets(clients: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    per_ip = clients.groupBy("bucket", "ip").agg(F.sum("failures").alias("failures"), F.sum("bytes").alias("bytes"))
    totals = per_ip.groupBy("bucket").agg(
        F.sum("failures").alias("request_count"),
        F.sum("bytes").alias("total_bytes"),
        F.count("*").alias("ip_count"),
    )
    many = (F.col("request_count") >= cfg.distributed_min_failures) | (F.col("ip_count") >= cfg.distributed_many_ips)
    return totals.where((F.col("ip_count") >= cfg.distributed_min_ips) & many)


def members(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, facts: Facts | None = None) -> DataFrame:
    """Every address of every flagged bucket, one per row, with the time it was first seen there."""
    clients = (facts or lazy_facts(requests, cfg)).clients
    return (
        clients.join(flagged_buckets(clients, cfg).select("bucket"), "bucket", "left_semi")
        .groupBy("bucket", "ip")
        .agg(F.min("seen").alias("seen"))
        .select(
            F.lit(ATTACK_TYPE).alias("attack_type"), session_key().alias("session_key"), "ip",
            F.col("seen.timestamp").alias("seen"),
        )
    )


def detect(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, facts: Facts | None = None) -> DataFrame:
    return sessions_of((facts or lazy_facts(requests, cfg)).clients, cfg)


def sessions_of(clients: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One session per flagged bucket."""
    flagged = flagged_buckets(clients, cfg)
    smallest = clients.groupBy("bucket").agg(F.min("ip").alias("ip"))
    # most addresses first, then the smaller agent
    shared = (
        clients.groupBy("bucket", "user_agent")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= cfg.distributed_agent_ips)
        .groupBy("bucket")
        .agg(F.min(F.struct((-F.col("n")).alias("minus_n"), "user_agent"))["user_agent"].alias("shared_user_agent"))
    )
    found = join_on("bucket", flagged, smallest, shared)
    seconds = cfg.distributed_window_seconds
    coordinated = F.col("shared_user_agent").isNotNull()
    evidence = F.struct(
        F.col("ip_count").alias("unique_ip_count"),
        coordinated.alias("coordinated"),
        "shared_user_agent",
    )
    sessions = found.select(
        session_key().alias("session_key"),
        "ip",
        "ip_count",
        F.col("bucket").alias("start_time"),
        (F.col("bucket") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("end_time"),
        F.lit(float(seconds)).alias("duration_seconds"),
        "request_count",
        "total_bytes",
        F.lit("L1_burst").alias("layer"),
        F.lit(False).alias("is_internal"),
        F.lit(True).alias("ip_rotation_detected"),
        coordinated.alias("coordinated"),
        "shared_user_agent",
        evidence.alias("evidence"),
    )
    return as_sessions(sessions, ATTACK_TYPE, cfg)
