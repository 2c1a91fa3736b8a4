"""Injection payloads of one address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.operators.detectors.base import as_sessions, basic_totals, join_on
from tracewarden.operators.facts import Facts, lazy_facts
from tracewarden.operators.profile import span_seconds
from tracewarden.operators.ranking import as_list

ATTACK_TYPE = "sql_injection"


def detect(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, facts: Facts | None = None) -> DataFrame:
    facts = facts or lazy_facts(requests, cfg)
    totals = facts.kind("sqli_match").groupBy("ip").agg(
        *basic_totals(
            F.sum("ok_responses").alias("successful_responses"),
            F.bool_or(F.lower("user_agent").contains("sqlmap")).alias("uses_sqlmap"),
        )
    ).where(F.col("request_count") >= cfg.sqli_min_payloads)
    own = F.col("attack_type") == ATTACK_TYPE
    found = join_on(
        "ip",
        totals,
        as_list(facts.samples.where(own), ["ip"], 5, "sample_payloads"),
        as_list(facts.agent_order.where(own), ["ip"], 5, "user_agents"),
    )
    duration = span_seconds(F.col("start_time"), F.col("end_time"))
    evidence = F.struct(
        F.col("request_count").alias("payload_count"),
        "successful_responses",
        "sample_payloads",
        "user_agents",
        "uses_sqlmap",
    )
    layer = F.when(duration < cfg.sqli_burst_seconds, "L1_burst").otherwise("L3_long_term")
    return as_sessions(found.withColumns({"layer": layer, "evidence": evidence}), ATTACK_TYPE, cfg)
