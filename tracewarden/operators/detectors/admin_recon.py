"""Visits of one address to admin and internal paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.operators.detectors.base import as_sessions, basic_totals, join_on
from tracewarden.operators.facts import Facts, lazy_facts
from tracewarden.operators.ranking import as_list

ATTACK_TYPE = "admin_recon"


def detect(requests: DataFrame, profile: DataFrame, cfg: Config = DEFAULT, facts: Facts | None = None) -> DataFrame:
    facts = facts or lazy_facts(requests, cfg)
    totals = facts.kind("is_admin").groupBy("ip").agg(
        *basic_totals(
            F.sum("deep_admin_hits").alias("deep_admin_hits"),
            F.sum("recon_responses").alias("successful_admin_access"),
        )
    ).where((F.col("request_count") >= cfg.recon_min_hits) | (F.col("deep_admin_hits") >= 1))
    agents = facts.agent_order.where(F.col("attack_type") == ATTACK_TYPE)
    found = join_on("ip", totals, as_list(agents, ["ip"], 3, "user_agents"))
    evidence = F.struct("deep_admin_hits", "successful_admin_access", "user_agents")
    return as_sessions(found.withColumns({"layer": F.lit("L2_session"), "evidence": evidence}), ATTACK_TYPE, cfg)
