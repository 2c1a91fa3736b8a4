"""Columns of the tables, as DDL where a table is read or made."""

from __future__ import annotations

# Column names of the request table.
REQUEST_COLUMNS = (
    "lineno", "timestamp", "timestamp_local", "ip", "method", "url_full", "url_path", "url_query", "url_decoded",
    "status", "bytes", "user_agent", "is_sensitive", "is_admin", "is_deep_admin", "is_transaction",
    "is_exfil_target", "is_login", "is_failed_login", "is_success_login", "is_bot_ua", "is_tor_ua",
    "hour_local", "is_off_hours", "sqli_match",
)

ENDPOINTS = "category STRING, path STRING"
COUNTRY_NETWORKS = "network STRING, country STRING"
COUNTRY_RANGES = "ip_from BIGINT, ip_to BIGINT, country STRING"
IP_ACTIONS = "ip STRING, action STRING, note STRING, set_at TIMESTAMP"
ENDPOINT_CHANGES = "category STRING, path STRING, change STRING, set_at TIMESTAMP"
