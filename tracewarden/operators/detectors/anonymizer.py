"""Automated or anonymised clients, by user agent and rhythm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.operators.detectors.base import as_sessions, join_on
from tracewarden.operators.facts import Facts, lazy_facts
from tracewarden.operators.profile import bot_rhythm
from tracewarden.operators.ranking import top_counts

ATTACK_TYPE = "anonymizer"


def detect(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, facts: Facts | None = None) -> DataFrame:
    facts = facts or lazy_facts(requests, cfg)
    ratio = F.col("bot_requests") / F.col("total_requests")
    signs = profile.where(F.col("total_requests") >= cfg.anonymizer_min_requests).withColumns(
        {
            "many_bots": ratio >= cfg.anonymizer_bot_ratio,
            "tor": F.col("tor_requests") > 0,
            "rotates": F.col("unique_user_agents") >= cfg.anonymizer_min_agents,
            "rhythm": bot_rhythm(cfg),
        }
    ).where("many_bots OR tor OR rotates OR rhythm")
    found = join_on(
        "ip",
        signs,
        top_counts(facts.agents.withColumnRenamed("total_requests", "n"), ["ip"], "user_agent", 3, "user_agents"),
        top_counts(facts.paths, ["ip"], "url_path", 5, "endpoints_targeted"),
    )
    percent = F.bround(ratio * 100, 0).cast("bigint")
    signals = F.array(
        F.when(F.col("many_bots"), F.format_string("bot_ua_ratio=%d%%(%d)", percent, "bot_requests")),
        F.when(F.col("tor"), F.format_string("tor_ua(%d)", "tor_requests")),
        F.when(F.col("rotates"), F.format_string("ua_rotation(%d)", "unique_user_agents")),
        F.when(F.col("rhythm"), F.format_string("regular_interval(CV=%.2f)", F.bround("interval_cv", 2))),
    )
    evidence = F.struct(
        F.array_compact(signals).alias("signals"),
        F.col("bot_requests").alias("bot_ua_count"),
        F.bround(ratio, 3).alias("bot_ratio"),
        F.col("tor_requests").alias("tor_ua_count"),
        "unique_user_agents",
        F.when(F.col("interval_cv") != 0, F.bround("interval_cv", 3)).alias("interval_cv"),
        "user_agents",
        "endpoints_targeted",
    )
    sessions = found.select(
        "ip",
        F.col("first_seen").alias("start_time"),
        F.col("last_seen").alias("end_time"),
        F.col("total_requests").alias("request_count"),
        "total_bytes",
        "is_internal",
        F.lit("L4_fingerprint").alias("layer"),
        evidence.alias("evidence"),
    )
    return as_sessions(sessions, ATTACK_TYPE, cfg)
