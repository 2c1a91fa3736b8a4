"""Many logins of one address with a high share of failures.

The rule is inferred from the published thresholds and example findings, because
its source is not public; every number is a setting:

* a trailing three hours with enough logins and failures: ``L1_burst``
* else totals over the log: ``L2_session``, then ``L3_long_term``
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.operators.detectors.base import as_sessions, basic_totals
from tracewarden.operators.facts import Facts, lazy_facts
from tracewarden.operators.trailing import trailing_hits

ATTACK_TYPE = "credential_stuffing"


def login_bursts(logins: DataFrame, cfg: Config = DEFAULT, slices: DataFrame | None = None) -> DataFrame:
    """Addresses with a trailing window of enough logins at the failure ratio; ``slices`` are the facts', if at hand."""
    failed = F.col("is_failed_login").cast("bigint")
    return trailing_hits(
        logins,
        "ip",
        {"failed": failed, "others": 1 - failed},
        cfg.burst_seconds,
        cfg.slice_seconds,
        hit=lambda t: _enough(t, t, cfg),
        # fewest failures among the most other logins, and the reverse
        surely=lambda low, high: (low["failed"] + low["others"] >= cfg.burst_logins) & _ratio(low, high, cfg),
        possibly=lambda low, high: (high["failed"] + high["others"] >= cfg.burst_logins) & _ratio(high, low, cfg),
        slices=slices,
    )


def _ratio(failed_of, others_of, cfg: Config):
    failed, others = failed_of["failed"], others_of["others"]
    return F.coalesce(failed / F.nullif(failed + others, F.lit(0)) >= cfg.burst_failure_ratio, F.lit(False))


def _enough(failed_of, others_of, cfg: Config):
    count = failed_of["failed"] + others_of["others"]
    return (count >= cfg.burst_logins) & _ratio(failed_of, others_of, cfg)


def detect(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, facts: Facts | None = None) -> DataFrame:
    facts = facts or lazy_facts(requests, cfg)
    per_agent = facts.kind("is_login").groupBy("ip", "user_agent").agg(
        *basic_totals(
            F.sum("failed_logins").alias("failed"),
            F.sum("successful_logins").alias("succeeded"),
            F.bool_or(F.col("bot_requests") > 0).alias("bot"),
        )
    )
    totals = per_agent.groupBy("ip").agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.sum("request_count").alias("request_count"),
        F.sum("total_bytes").alias("total_bytes"),
        F.sum("failed").alias("failed_logins"),
        F.sum("succeeded").alias("successful_logins"),
        F.count("user_agent").alias("unique_user_agents"),
        F.bool_or("bot").alias("bot_ua_used"),
    )
    bursts = login_bursts(requests.where("is_login"), cfg, facts.stored_slices).withColumn("burst", F.lit(True))
    n, ratio = F.col("request_count"), F.col("failed_logins") / F.col("request_count")
    layer = (
        F.when(F.col("burst"), "L1_burst")
        .when((n >= cfg.session_logins) & (ratio >= cfg.session_failure_ratio), "L2_session")
        .when((n >= cfg.long_logins) & (ratio >= cfg.long_failure_ratio), "L3_long_term")
    )
    found = totals.join(bursts, "ip", "left").withColumn("layer", layer).where("layer IS NOT NULL")
    evidence = F.struct(
        "failed_logins",
        "successful_logins",
        F.bround(ratio, 3).alias("failure_ratio"),
        "unique_user_agents",
        "bot_ua_used",
    )
    return as_sessions(found.withColumn("evidence", evidence), ATTACK_TYPE, cfg)
