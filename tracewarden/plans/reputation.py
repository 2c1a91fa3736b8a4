"""Cumulative suspicion score per address and the reasons behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, Config
from tracewarden.functions.sql import quoted
from tracewarden.functions.text import severity

# --- Fixed values: texts of the reasons ---
REASON_TEXTS = {
    "failed_login": "{count} failed logins (+{w} each)",
    "sqli_payload": "{count} SQL injection payloads (+{w} each)",
    "sensitive_api_200": "{count} successful sensitive API requests (+{w} each)",
    "admin_endpoint_hit": "{count} hits to /admin (+{w} each)",
    "deep_admin_hit": "{count} deep admin paths (/admin/users, /admin/export...) +{w} each",
    "bot_user_agent": "Uses bot User-Agent (curl, sqlmap, Postman, python-requests) +{w}",
    "per_mb_api_traffic": "{count} MB sensitive API traffic (+{w} per MB)",
    "off_hours_activity": "{count} off-hours requests (22:00-07:00) +{w} each",
    "high_request_rate": "High request rate (>5/min) +{w}",
    "regular_interval": "Bot rhythm — perfectly regular intervals (CV<0.3) +{w}",
    "ua_rotation": "Frequently rotates User-Agent ({count} variants) +{w}",
}
# --- end of fixed values ---


def signal_units(cfg: Config = DEFAULT) -> dict[str, str]:
    """How often each signal counts, as SQL over the profile, in the order reasons are listed."""
    rhythm = f"interval_cv < {cfg.rhythm_cv}D AND total_requests >= {cfg.rhythm_min_requests}"
    return {
        "failed_login": "failed_logins",
        "sqli_payload": "sqli_payloads",
        "sensitive_api_200": "sensitive_ok",
        "admin_endpoint_hit": "admin_hits",
        "deep_admin_hit": "deep_admin_hits",
        "bot_user_agent": "if(bot_requests > 0, 1L, 0L)",
        "per_mb_api_traffic": "sensitive_bytes div 1000000",
        "off_hours_activity": "off_hours_requests",
        "high_request_rate": f"if(request_rate > {cfg.fast_requests_per_minute}D, 1L, 0L)",
        "regular_interval": f"if({rhythm}, 1L, 0L)",
        "ua_rotation": f"if(unique_user_agents >= {cfg.anonymizer_min_agents}, 1L, 0L)",
    }


def ip_reputation(profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Score, severity and the non-zero parts of the score per address."""
    points = {name: f"({units}) * {cfg.weights[name]}" for name, units in signal_units(cfg).items()}
    parts = ", ".join(f"{quoted(name)}, {value}" for name, value in points.items())
    return profile.select(
        "ip",
        "is_internal",
        "total_requests",
        F.expr(f"{' + '.join(points.values())} AS score"),
        F.expr(f"map_filter(map({parts}), (k, v) -> v <> 0) AS breakdown"),
    ).select("ip", "score", severity(F.col("score"), cfg).alias("severity"), "is_internal", "total_requests", "breakdown")


def score_reasons(profile: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per address and signal with its text and points."""
    rows = []
    for position, (name, units) in enumerate(signal_units(cfg).items()):
        before, _, after = REASON_TEXTS[name].replace("{w}", str(cfg.weights[name])).partition("{count}")
        count = "unique_user_agents" if name == "ua_rotation" else units
        shown = f"concat({quoted(before)}, {count}, {quoted(after)})" if after else quoted(before)
        rows.append(
            f"struct({position} AS position, {quoted(name)} AS signal, {shown} AS text, "
            f"({units}) * {cfg.weights[name]} AS points)"
        )
    return profile.select("ip", F.expr(f"inline(array({', '.join(rows)}))")).where("points <> 0")


def ranked_reasons(reasons: DataFrame) -> DataFrame:
    """Reasons of each address, most points first."""
    return reasons.orderBy("ip", F.desc("points"), "position")


def by_score(reputation: DataFrame) -> DataFrame:
    return reputation.orderBy(F.desc("score"), "ip")
