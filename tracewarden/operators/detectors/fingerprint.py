"""Addresses that behave alike: same main agent, same top paths, same rhythm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.operators.detectors.base import as_sessions
from tracewarden.operators.facts import Facts, lazy_facts
from tracewarden.operators.ranking import counts, ranked

ATTACK_TYPE = "distributed_fingerprint"


def fingerprints(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, facts: Facts | None = None) -> DataFrame:
    """One row per address with its fingerprint. Only addresses with enough requests have one."""
    facts = facts or lazy_facts(requests, cfg)
    busy = profile.where(F.col("total_requests") >= cfg.fingerprint_min_requests)
    top = ranked(counts(facts.paths, ["ip"], "url_path"), ["ip"], [F.desc("n"), F.asc("value")], cfg.fingerprint_top_paths)
    paths = top.groupBy("ip").agg(F.array_sort(F.collect_list("value")).alias("common_endpoints"))
    fast = F.coalesce(F.col("interval_cv") < cfg.rhythm_cv, F.lit(False))
    parts = ["dominant_user_agent", F.array_join("common_endpoints", "\n"), "rhythm_class"]
    return (
        busy.join(paths, "ip")
        .withColumn("rhythm_class", F.when(fast, "fast").otherwise("normal"))
        .withColumn("session_key", F.sha2(F.concat_ws("\n", *parts), 256))
        .select(
            "session_key", "ip", "dominant_user_agent", "common_endpoints", "rhythm_class", "is_internal",
            "first_seen", "last_seen", "total_requests", "total_bytes",
        )
    )


def groups(prints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Fingerprints shared by several addresses, from the per-address totals."""
    return prints.groupBy("session_key", "dominant_user_agent", "common_endpoints", "rhythm_class").agg(
        F.count("*").alias("ip_count"),
        F.min("ip").alias("ip"),
        F.min("first_seen").alias("start_time"),
        F.max("last_seen").alias("end_time"),
        F.sum("total_requests").alias("request_count"),
        F.sum("total_bytes").alias("total_bytes"),
        F.bool_and("is_internal").alias("is_internal"),
    ).where(F.col("ip_count") >= cfg.fingerprint_min_ips)


def members(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, facts: Facts | None = None) -> DataFrame:
    """Every address of every shared fingerprint, one per row."""
    prints = fingerprints(requests, profile, cfg, facts)
    return prints.join(groups(prints, cfg).select("session_key"), "session_key", "left_semi").select(
        F.lit(ATTACK_TYPE).alias("attack_type"), "session_key", "ip", F.col("first_seen").alias("seen")
    )


def detect(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, facts: Facts | None = None) -> DataFrame:
    prints = fingerprints(requests, profile, cfg, facts)
    found = groups(prints, cfg)
    evidence = F.struct(
        "ip_count",
        F.col("dominant_user_agent").alias("dominant_ua"),
        "common_endpoints",
        "rhythm_class",
    )
    sessions = found.withColumns(
        {
            "layer": F.lit("L4_fingerprint"),
            "evidence": evidence,
        }
    )
    return as_sessions(sessions, ATTACK_TYPE, cfg)
