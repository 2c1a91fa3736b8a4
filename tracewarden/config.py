"""Settings of the analysis.

Everything a deployment may tune sits in :class:`Config`; the defaults are the
published rules of the detectors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: path lists, patterns, ids and weights the results depend on ---

LOGIN_PATHS = ("/login", "/api/login", "/api/v1/login", "/api/v2/login", "/auth/login")

SENSITIVE_PREFIXES = (
    "/api/accounts", "/api/transactions", "/api/transfer", "/api/payment", "/api/export", "/api/report",
    "/api/users", "/api/search", "/api/cards", "/api/profile", "/api/settings", "/api/download",
    "/api/v1/accounts", "/api/v1/clients", "/api/v1/transactions", "/api/v1/transfer", "/api/v1/payment",
    "/api/v1/export", "/api/v1/users", "/api/v1/search", "/api/v1/cards", "/api/v1/profile",
)

TRANSACTION_PREFIXES = ("/api/transfer", "/api/payment", "/api/v1/transfer", "/api/v1/payment")

EXFIL_PREFIXES = (
    "/api/export", "/api/report", "/api/download", "/api/transactions", "/api/accounts", "/api/users",
    "/admin/export", "/api/v1/clients/export", "/api/v1/clients", "/api/v1/accounts/list", "/api/v1/accounts",
    "/api/v1/transactions", "/api/v1/users", "/api/v1/export", "/api/v1/report", "/api/v1/download",
)

ADMIN_PREFIXES = ("/admin", "/admin/users", "/admin/export", "/internal/audit", "/internal")

DEEP_ADMIN_PREFIXES = ("/admin/users", "/admin/export", "/internal/audit", "/internal")

SQLI_PATTERNS = (
    r"union\s+select",
    r"%20union%20select",
    r"or\s+1\s*=\s*1",
    r"%27\s*or\s*%271",
    r"'\s*or\s*'1'\s*=\s*'1",
    r"--(?:\s|$)",
    r";\s*drop\s+table",
    r"information_schema",
    r"sleep\s*\(\s*\d+\s*\)",
    r"benchmark\s*\(",
    r"xp_cmdshell",
    r"%27",
    r"\bselect\s+.+\s+from\b",
    r"waitfor\s+delay",
    r"concat\s*\(",
    r"load_file\s*\(",
    r"into\s+outfile",
)

BOT_AGENT_PATTERNS = (
    r"sqlmap", r"^curl/", r"python-requests", r"PostmanRuntime", r"nikto", r"nmap", r"masscan", r"wget",
    r"go-http-client", r"libwww-perl", r"scrapy",
)

TOR_AGENT_PATTERN = r"Mozilla/5\.0 \([^)]+; rv:\d+\.0\) Gecko/20100101 Firefox/\d+\.0$"

MITRE_IDS = {
    "credential_stuffing": "T1110.004",
    "distributed_credential_stuffing": "T1110.004",
    "sql_injection": "T1190",
    "data_exfiltration": "T1041",
    "anonymizer": "T1090",
    "admin_recon": "T1087",
    "distributed_fingerprint": "T1583.003",
}

SCORE_WEIGHTS = {
    "failed_login": 5,
    "sqli_payload": 15,
    "sensitive_api_200": 1,
    "admin_endpoint_hit": 8,
    "deep_admin_hit": 30,
    "bot_user_agent": 25,
    "per_mb_api_traffic": 10,
    "off_hours_activity": 1,
    "high_request_rate": 15,
    "regular_interval": 20,
    "ua_rotation": 15,
}

CAMPAIGN_SEQUENCES = (
    ("credential_stuffing", "sql_injection", "data_exfiltration"),
    ("credential_stuffing", "data_exfiltration"),
    ("sql_injection", "data_exfiltration"),
    ("admin_recon", "credential_stuffing", "data_exfiltration"),
    ("admin_recon", "sql_injection", "data_exfiltration"),
    ("credential_stuffing", "sql_injection"),
)

# --- end of fixed values ---

ENDPOINT_CATEGORIES = {
    "login_paths": LOGIN_PATHS,
    "exfil_targets": EXFIL_PREFIXES,
    "sensitive_prefixes": SENSITIVE_PREFIXES,
    "transaction": TRANSACTION_PREFIXES,
    "admin_endpoints": ADMIN_PREFIXES,
}

DETECTOR_ORDER = (
    "credential_stuffing",
    "distributed_credential_stuffing",
    "sql_injection",
    "data_exfiltration",
    "anonymizer",
    "admin_recon",
    "distributed_fingerprint",
)

IP_ACTIONS = ("watchlist", "ignore", "block")

# A character (or "--") that every pattern of SQLI_PATTERNS needs. Clean URLs leave after
# this one cheap scan; functions.text.sqli_match uses it for these patterns only.
SQLI_PRECHECK = r"[%'(_\s]|--"


# The numbers below are fixed values, too: results must equal the published rules'.


@dataclass(frozen=True)
class Config:
    # Layer 1: trailing three hours
    burst_seconds: int = 3 * 3600
    burst_logins: int = 15
    burst_failure_ratio: float = 0.5
    burst_exfil_bytes: int = 5_000_000
    burst_exfil_requests: int = 30
    # Layer 2: totals over the analysed log
    session_logins: int = 30
    session_failure_ratio: float = 0.3
    session_exfil_bytes: int = 10_000_000
    session_exfil_requests: int = 100
    # Layer 3: low and slow
    long_logins: int = 50
    long_failure_ratio: float = 0.15
    long_exfil_bytes: int = 30_000_000
    # Layer 4: behaviour
    fingerprint_min_requests: int = 20
    fingerprint_min_ips: int = 2
    fingerprint_top_paths: int = 5
    rhythm_cv: float = 0.3
    rhythm_min_requests: int = 20
    rhythm_min_rows: int = 5
    # SQL injection
    sqli_min_payloads: int = 1
    sqli_burst_seconds: int = 600
    # Anonymizer
    anonymizer_min_requests: int = 30
    anonymizer_bot_ratio: float = 0.20
    anonymizer_min_agents: int = 4
    # Admin reconnaissance
    recon_min_hits: int = 5
    recon_success_statuses: tuple[int, ...] = (200, 302, 304)
    # Distributed logins
    distributed_window_seconds: int = 300
    distributed_min_failures: int = 15
    distributed_many_ips: int = 4
    distributed_min_ips: int = 2
    distributed_agent_ips: int = 2
    distributed_fail_statuses: tuple[int, ...] = (401, 403)
    # Requests
    failed_login_statuses: tuple[int, ...] = (401, 403, 400)
    local_offset_hours: int = 5
    off_hours_start: int = 22
    off_hours_end: int = 7
    deep_admin_prefixes: tuple[str, ...] = DEEP_ADMIN_PREFIXES
    sqli_patterns: tuple[str, ...] = SQLI_PATTERNS
    bot_agent_patterns: tuple[str, ...] = BOT_AGENT_PATTERNS
    tor_agent_pattern: str = TOR_AGENT_PATTERN
    # Score
    weights: dict[str, int] = field(default_factory=lambda: dict(SCORE_WEIGHTS))
    fast_requests_per_minute: float = 5.0
    medium_score: int = 80
    high_score: int = 200
    critical_score: int = 500
    mitre_ids: dict[str, str] = field(default_factory=lambda: dict(MITRE_IDS))
    # Chains
    campaign_gap_seconds: int = 3 * 3600
    campaign_sequences: tuple[tuple[str, ...], ...] = CAMPAIGN_SEQUENCES
    # Damage
    record_bytes: int = 512
    record_usd: int = 5
    fine_usd: int = 50
    total_multiplier: float = 3.0
    transfer_usd: int = 250
    payment_usd: int = 80
    uzs_per_usd: int = 12_650
    # Scale: width of the time slices hot addresses are cut into
    slice_seconds: int = 60


DEFAULT = Config()
