"""Digests of whole tables, column by column and row by row, on both sides of the comparison.

A table becomes one row for each of its columns and one (``*``) for its rows put together:
how many values there are, and the sum of a hash of each. Times are compared in microseconds, doubles
to three places. Lists and maps are texts by then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SESSION = {
    "s": "attack_type session_key ip ip_count request_count total_bytes layer is_internal mitre_id ip_rotation_detected "
    "coordinated shared_user_agent score severity country via_tor via_proxy",
    "t": "start_time end_time",
    "d": "duration_seconds",
}
_CHAIN = {
    "s": "chain_type ip stages_count stage_types is_internal total_requests total_bytes max_severity critical_combo",
    "t": "first_seen last_seen",
    "d": "total_duration",
}
#: Columns of each table by kind: text, whole numbers and truth values; times; doubles.
SPECS: dict[str, dict[str, str]] = {
    "profile": {
        "s": "ip dominant_user_agent unique_user_agents total_requests total_bytes failed_logins successful_logins sqli_payloads "
        "sensitive_ok sensitive_bytes admin_hits deep_admin_hits bot_requests tor_requests off_hours_requests min_bytes max_bytes is_internal",
        "t": "first_seen last_seen",
        "d": "interval_cv request_rate span_seconds",
    },
    "sessions": _SESSION,
    "members": {"s": "attack_type session_key ip", "t": "seen"},
    "evidence_counts": {"s": "attack_type ip url_path n"},
    "reputation": {"s": "ip score severity is_internal total_requests breakdown"},
    "reasons": {"s": "ip position signal text points"},
    "chains": _CHAIN,
    "chain": _CHAIN,
    "damage": {
        "s": "estimated_records exfil_bytes dark_market_loss_usd compliance_fine_usd reputation_loss_usd fraud_potential_usd "
        "suspicious_transfers total_loss_usd total_loss_uzs",
        "d": "exfil_mb",
    },
    "cohorts": {"s": "ip cohort"},
    "baseline": {"s": "cohort total_requests unique_ips", "d": "avg_session_duration avg_request_rate avg_bytes_per_ip"},
    "paths": {"s": "ip url_path n rank"},
    "agents": {"s": "ip user_agent n rank"},
    "hours": {"s": "ip hour_local n"},
    "statuses": {"s": "ip status n"},
    "mitre": {"s": "ip mitre_ids"},
    "attacks_csv": {
        "s": "attack_type severity score ip country tor ip_rotation coordination internal duration_s duration requests bytes layer mitre",
        "t": "start end",
    },
    "attacks_json": _SESSION | {"s": "attack_type ip request_count total_bytes layer is_internal mitre_id score severity country via_tor via_proxy"},
    "narrative_text": {"s": "value"},
}
SPECS["ip_reputation_csv"] = {"s": "ip score severity is_internal total_requests breakdown"}
SPECS["attack_chains_json"] = _CHAIN
SPECS["economic_damage_json"] = SPECS["damage"]
NOTHING = "∅"


def _columns(name: str) -> list[tuple[str, str]]:
    return sorted((column, kind) for kind, columns in SPECS[name].items() for column in columns.split())


def _text(column: str, kind: str) -> Column:
    if kind == "t":
        return F.unix_micros(F.col(column).cast("timestamp")).cast("string")
    if kind == "d":
        return F.floor(F.col(column).cast("double") * 1000 + 0.5).cast("string")
    return F.nullif(F.col(column).cast("string"), F.lit(""))


def digest(name: str, table: DataFrame) -> DataFrame:
    """``name, column_name, n, digest`` of one table."""
    texts = [(column, _text(column, kind)) for column, kind in _columns(name)]
    whole = F.concat_ws("|", *[F.coalesce(text, F.lit(NOTHING)) for _, text in texts])
    parts = [F.struct(F.lit(c).alias("column_name"), text.alias("text")) for c, text in [*texts, ("*", whole)]]
    number = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(NOTHING))), 1, 8), 16, 10).cast("bigint")
    rows = table.select(F.lit(name).alias("name"), F.inline(F.array(*parts)))
    return rows.groupBy("name", "column_name").agg(F.count("text").alias("n"), F.sum(number).alias("digest"))


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [digest(name, table) for name, table in tables.items()])


def _sql_text(column: str, kind: str) -> str:
    if kind == "t":
        return f'epoch_us("{column}")::VARCHAR'
    if kind == "d":
        return f'floor("{column}" * 1000 + 0.5)::BIGINT::VARCHAR'
    return f"nullif(\"{column}\"::VARCHAR, '')"


def digest_sql(name: str, select: str) -> str:
    """The same for the result of a statement."""
    texts = [(column, _sql_text(column, kind)) for column, kind in _columns(name)]
    whole = "concat_ws('|', " + ", ".join(f"coalesce({text}, '{NOTHING}')" for _, text in texts) + ")"
    packed = ", ".join(f"{{c: '{c}', v: {text}}}" for c, text in [*texts, ("*", whole)])
    return f"""SELECT '{name}' AS name, u.c AS column_name, count(u.v) AS n,
      sum(('0x' || left(md5(coalesce(u.v, '{NOTHING}')), 8))::BIGINT)::BIGINT AS digest
      FROM (SELECT unnest([{packed}]) AS u FROM ({select})) GROUP BY u.c"""


def digests_sql(selects: dict[str, str]) -> str:
    return " UNION ALL ".join(digest_sql(name, select) for name, select in selects.items())
