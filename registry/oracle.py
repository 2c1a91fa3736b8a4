"""Equivalent SQL of the registered queries, over the same given tables.

Every statement is put together from the named parts it uses.
"""

from __future__ import annotations

import re

from registry.digests import digests_sql
from registry.fixture import ANDROID, COUNTRIES, FIREFOX, NETWORKS, SQLI_URL
from tracewarden import config as C
from tracewarden.plans.reputation import REASON_TEXTS

W = C.SCORE_WEIGHTS


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _below(column: str, prefixes) -> str:
    return f"regexp_full_match({column}, '({'|'.join(prefixes)})(/.*)?')"


_LOGIN = ", ".join(map(_quoted, C.LOGIN_PATHS))
_SQLI = _quoted("(?i)" + "|".join(f"(?:{p})" for p in C.SQLI_PATTERNS))
_BOT = _quoted("(?i)" + "|".join(f"(?:{p})" for p in C.BOT_AGENT_PATTERNS))
_TOR = _quoted("^" + C.TOR_AGENT_PATTERN)
_GEO = ", ".join(f"({a}, {a + n - 1}, {_quoted(c)})" for a, n, c in COUNTRIES)
_DEFAULTS = ", ".join(f"({_quoted(c)}, {_quoted(p)})" for c, paths in C.ENDPOINT_CATEGORIES.items() for p in paths)
_CATEGORIES = "[" + ", ".join(map(_quoted, C.ENDPOINT_CATEGORIES)) + "]"


def _bytes_text(b: str) -> str:
    return (
        f"CASE WHEN {b} < 1024 THEN printf('%d B', ({b})::BIGINT) "
        f"WHEN {b} < 1048576 THEN printf('%.1f KB', {b} / 1024.0::DOUBLE) "
        f"WHEN {b} < 1073741824 THEN printf('%.1f MB', {b} / 1048576.0::DOUBLE) "
        f"ELSE printf('%.2f GB', {b} / 1073741824.0::DOUBLE) END"
    )


def _duration_text(x: str) -> str:
    s = f"trunc({x})::BIGINT"
    return (
        f"CASE WHEN {s} = 0 THEN '0 s' ELSE concat_ws(' ', CASE WHEN {s} >= 86400 THEN ({s} // 86400) || ' d' END, "
        f"CASE WHEN {s} % 86400 >= 3600 THEN ({s} % 86400 // 3600) || ' h' END, "
        f"CASE WHEN {s} % 3600 >= 60 THEN ({s} % 3600 // 60) || ' m' END, "
        f"CASE WHEN {s} < 3600 AND {s} % 60 > 0 THEN ({s} % 60) || ' s' END) END"
    )


def _duration_hms(x: str) -> str:
    s = f"trunc({x})::BIGINT"
    return (
        f"CASE WHEN {s} >= 3600 THEN printf('%dh %dm %ds', {s} // 3600, {s} % 3600 // 60, {s} % 60) "
        f"WHEN {s} >= 60 THEN printf('%dm %ds', {s} // 60, {s} % 60) ELSE printf('%ds', {s}) END"
    )


def _severity(x: str) -> str:
    return f"CASE WHEN {x} >= 500 THEN 'CRITICAL' WHEN {x} >= 200 THEN 'HIGH' WHEN {x} >= 80 THEN 'MEDIUM' ELSE 'LOW' END"


def _rank(x: str) -> str:
    return f"CASE {x} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


def _internal(ip: str) -> str:
    return (
        f"({ip} LIKE '10.%' OR {ip} LIKE '127.%' OR {ip} LIKE '192.168.%' "
        f"OR regexp_matches({ip}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"
    )


_SESSION = (
    "attack_type, session_key, ip, ip_count, start_time, end_time, duration_seconds, request_count, total_bytes, layer, "
    "is_internal, mitre_id, ip_rotation_detected, coordinated, shared_user_agent"
)


def _single(name: str, start: str, end: str, n: str, size: str, layer: str, more: str, source: str) -> str:
    """A single-address session with its evidence columns."""
    return f"""SELECT '{name}' AS attack_type, ip AS session_key, ip, 1::BIGINT AS ip_count, {start} AS start_time,
      {end} AS end_time, (epoch_us({end}) - epoch_us({start})) / 1e6 AS duration_seconds, {n} AS request_count,
      {size} AS total_bytes, {layer} AS layer, {_internal('ip')} AS is_internal, '{C.MITRE_IDS[name]}' AS mitre_id,
      FALSE AS ip_rotation_detected, FALSE AS coordinated, NULL::VARCHAR AS shared_user_agent{more} FROM {source}"""


def _counted(part: str, column: str, keys: str = "ip", k: int = 10) -> str:
    return f"""SELECT {keys}, string_agg(v || '=' || n, ', ' ORDER BY n DESC, v) AS t FROM (
      SELECT {keys}, {column} AS v, count(*) AS n, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {column}) AS r
      FROM {part} GROUP BY {keys}, {column}) WHERE r <= {k} GROUP BY {keys}"""


def _samples(part: str, column: str, k: int) -> str:
    return f"""SELECT ip, string_agg(v, ', ' ORDER BY r) AS t FROM (
      SELECT ip, {column} AS v, row_number() OVER (PARTITION BY ip ORDER BY timestamp, lineno) AS r FROM {part})
      WHERE r <= {k} GROUP BY ip"""


def _seen(part: str, column: str, k: int) -> str:
    return f"""SELECT ip, string_agg(v, ', ' ORDER BY r) AS t FROM (
      SELECT ip, v, row_number() OVER (PARTITION BY ip ORDER BY ts, ln) AS r FROM (
        SELECT ip, {column} AS v, min(timestamp) AS ts, arg_min(lineno, (timestamp, lineno)) AS ln FROM {part} GROUP BY ip, {column}))
      WHERE r <= {k} GROUP BY ip"""


PARTS: dict[str, str] = {}

PARTS["ev"] = """SELECT event_id, user_id, value, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS d,
  event_id % 12 AS p, event_id // 12 AS k FROM events"""

PARTS["raw"] = f"""SELECT event_id AS lineno, make_timestamp((1704067200000000 + CASE p
    WHEN 0 THEN 9 * 3600000000 + d // 360 WHEN 1 THEN 41400000000 + d // 720 WHEN 2 THEN 13 * 3600000000 + d // 360
    WHEN 3 THEN 8 * 3600000000 + d // 720 WHEN 5 THEN 10 * 3600000000 + d // 1440
    WHEN 7 THEN event_id * 7000000 + (k % 5) * 1000000 ELSE d // 10 END)::BIGINT) AS timestamp,
  CASE p WHEN 0 THEN '185.23.44.12' WHEN 1 THEN '91.199.12.77' WHEN 2 THEN '103.44.55.66' WHEN 3 THEN '10.0.0.5'
    WHEN 4 THEN '176.88.14.201' WHEN 5 THEN '45.142.0.' || (k % 8) WHEN 6 THEN '62.122.55.' || (k % 3)
    WHEN 7 THEN '10.0.3.' || (k % 2) ELSE '78.140.' || (user_id // 256) || '.' || (user_id % 256) END AS ip,
  CASE WHEN p IN (0, 5) THEN 'POST' ELSE 'GET' END AS method,
  CASE p WHEN 0 THEN '/api/v1/login' WHEN 1 THEN '{SQLI_URL}'
    WHEN 2 THEN CASE WHEN k % 20 = 0 THEN '/admin/users' ELSE '/api/v1/clients/export' END
    WHEN 3 THEN CASE k % 4 WHEN 0 THEN '/admin/users' WHEN 1 THEN '/internal/audit' ELSE '/admin' END
    WHEN 5 THEN '/auth/login' WHEN 6 THEN '/api/v1/cards' WHEN 7 THEN '/api/v1/profile'
    ELSE CASE k % 5 WHEN 0 THEN '/' WHEN 1 THEN '/dashboard' WHEN 2 THEN '/api/v1/accounts' WHEN 3 THEN '/api/transfer'
      ELSE '/api/payment' END END AS url_full,
  (CASE WHEN p IN (0, 5) THEN CASE WHEN k % 5 = 0 THEN 200 ELSE 401 END WHEN p = 3 AND k % 3 = 0 THEN 403 ELSE 200 END)::INTEGER AS status,
  floor(value * CASE WHEN p = 2 THEN 10000 ELSE 100 END)::BIGINT AS bytes,
  CASE p WHEN 0 THEN 'python-requests/2.31.0' WHEN 1 THEN 'sqlmap/1.7.2#stable' WHEN 2 THEN 'curl/8.0.1'
    WHEN 4 THEN 'Client-' || (k % 6) || '/1.0' WHEN 5 THEN 'okhttp/4.9' WHEN 7 THEN '{FIREFOX}' ELSE '{ANDROID}' END AS user_agent
  FROM ev"""

PARTS["pathed"] = """SELECT *, split_part(url_full, '?', 1) AS url_path,
  CASE WHEN contains(url_full, '?') THEN substr(url_full, strpos(url_full, '?') + 1) ELSE '' END AS url_query,
  lower(url_decode(url_decode(url_full))) AS url_decoded, timestamp + INTERVAL 5 HOURS AS timestamp_local FROM raw"""

PARTS["req"] = f"""SELECT *, {_below('url_path', C.SENSITIVE_PREFIXES)} AS is_sensitive,
  {_below('url_path', C.ADMIN_PREFIXES)} AS is_admin, {_below('url_path', C.DEEP_ADMIN_PREFIXES)} AS is_deep_admin,
  {_below('url_path', C.TRANSACTION_PREFIXES)} AS is_transaction, {_below('url_path', C.EXFIL_PREFIXES)} AS is_exfil_target,
  method = 'POST' AND url_path IN ({_LOGIN}) AS is_login,
  method = 'POST' AND url_path IN ({_LOGIN}) AND status IN (400, 401, 403) AS is_failed_login,
  method = 'POST' AND url_path IN ({_LOGIN}) AND status = 200 AS is_success_login,
  regexp_matches(user_agent, {_BOT}) AS is_bot_ua, regexp_matches(user_agent, {_TOR}) AS is_tor_ua,
  hour(timestamp_local)::INTEGER AS hour_local, hour(timestamp_local) >= 22 OR hour(timestamp_local) < 7 AS is_off_hours,
  regexp_matches(url_decoded, {_SQLI}) OR regexp_matches(lower(url_full), {_SQLI}) AS sqli_match FROM pathed"""

PARTS["lines"] = """SELECT lineno, CASE WHEN (lineno // 12) % 2 = 0
    THEN ip || ' - - [' || strftime(timestamp, '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || method || ' ' || url_full
      || ' HTTP/1.1" ' || status || ' ' || bytes || ' "-" "' || user_agent || '"'
    ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') || ' ' || ip || ' ' || method || ' ' || url_full || ' ' || status
      || ' ' || bytes || ' ' || user_agent END AS value FROM raw
  UNION ALL SELECT lineno, 'garbage ' || lineno FROM raw WHERE lineno % 97 = 0
  UNION ALL SELECT lineno, '# comment ' || lineno FROM raw WHERE lineno % 97 = 0
  UNION ALL SELECT lineno, '   ' FROM raw WHERE lineno % 97 = 0"""

# The two line formats.
_COMBINED = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(.*?)\s+HTTP/\S+"\s+(\d+)\s+(\d+)\s+"[^"]*"\s+"([^"]*)"'
_CUSTOM = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\d+)\s+(.+)$"

PARTS["matched"] = f"""SELECT lineno, value, regexp_matches(value, '^\\S+\\s+\\S+\\s+\\S+\\s+\\[') AS combined,
  regexp_matches(value, '{_COMBINED}') AS m1, regexp_matches(value, '{_CUSTOM}') AS m2,
  regexp_extract(value, '{_COMBINED}', ['ip', 'ts', 'method', 'url', 'status', 'bytes', 'ua']) AS f1,
  regexp_extract(value, '{_CUSTOM}', ['ts', 'ip', 'method', 'url', 'status', 'bytes', 'ua']) AS f2
  FROM lines WHERE trim(value) <> '' AND NOT starts_with(value, '#')"""

PARTS["parsed"] = """SELECT lineno, CASE WHEN combined THEN strptime(f1.ts[:20], '%d/%b/%Y:%H:%M:%S')
    ELSE strptime(f2.ts, '%Y-%m-%dT%H:%M:%SZ') END AS timestamp, CASE WHEN combined THEN f1.ip ELSE f2.ip END AS ip,
  CASE WHEN combined THEN upper(f1.method) ELSE f2.method END AS method, CASE WHEN combined THEN f1.url ELSE f2.url END AS url_full,
  (CASE WHEN combined THEN f1.status ELSE f2.status END)::INTEGER AS status,
  (CASE WHEN combined THEN f1.bytes ELSE f2.bytes END)::BIGINT AS bytes, CASE WHEN combined THEN f1.ua ELSE trim(f2.ua) END AS user_agent
  FROM matched WHERE (combined AND m1) OR (NOT combined AND m2)"""

PARTS["gaps"] = """SELECT ip, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY ip ORDER BY timestamp) AS g FROM req"""

PARTS["cv"] = """SELECT ip, CASE WHEN count(*) >= 5 AND avg(g) <> 0 THEN stddev_samp(g) / avg(g) END AS interval_cv FROM gaps GROUP BY ip"""

PARTS["agents"] = "SELECT ip, user_agent, count(*) AS n FROM req GROUP BY ip, user_agent"

PARTS["prof"] = f"""SELECT ip, (SELECT user_agent FROM agents a WHERE a.ip = r.ip ORDER BY n DESC, user_agent LIMIT 1) AS dominant_user_agent,
  count(DISTINCT user_agent) AS unique_user_agents, count(*) AS total_requests, sum(bytes)::BIGINT AS total_bytes,
  count(*) FILTER (is_failed_login) AS failed_logins, count(*) FILTER (is_success_login) AS successful_logins,
  count(*) FILTER (sqli_match) AS sqli_payloads, count(*) FILTER (is_sensitive AND status = 200) AS sensitive_ok,
  coalesce(sum(bytes) FILTER (is_sensitive), 0)::BIGINT AS sensitive_bytes, count(*) FILTER (is_admin) AS admin_hits,
  count(*) FILTER (is_deep_admin) AS deep_admin_hits, count(*) FILTER (is_bot_ua) AS bot_requests,
  count(*) FILTER (is_tor_ua) AS tor_requests, count(*) FILTER (is_off_hours) AS off_hours_requests,
  min(bytes) AS min_bytes, max(bytes) AS max_bytes, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS span_seconds,
  CASE WHEN count(*) >= 2 AND max(timestamp) > min(timestamp)
    THEN count(*) / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 / 60) ELSE 0.0::DOUBLE END AS request_rate,
  {_internal('ip')} AS is_internal FROM req r GROUP BY ip"""

PARTS["profile"] = "SELECT prof.*, interval_cv, coalesce(interval_cv < 0.3, FALSE) AND total_requests >= 20 AS rhythm FROM prof JOIN cv USING (ip)"

_UNITS = {
    "failed_login": "failed_logins", "sqli_payload": "sqli_payloads", "sensitive_api_200": "sensitive_ok",
    "admin_endpoint_hit": "admin_hits", "deep_admin_hit": "deep_admin_hits",
    "bot_user_agent": "(bot_requests > 0)::BIGINT", "per_mb_api_traffic": "sensitive_bytes // 1000000",
    "off_hours_activity": "off_hours_requests", "high_request_rate": "(request_rate > 5)::BIGINT",
    "regular_interval": "rhythm::BIGINT", "ua_rotation": "(unique_user_agents >= 4)::BIGINT",
}

PARTS["reasons"] = " UNION ALL ".join(
    f"SELECT ip, {i} AS position, '{name}' AS signal, "
    + "replace(" + _quoted(REASON_TEXTS[name].replace("{w}", str(W[name])))
    + f", '{{count}}', ({'unique_user_agents' if name == 'ua_rotation' else unit})::VARCHAR) AS text, ({unit}) * {W[name]} AS points "
    + f"FROM profile WHERE ({unit}) <> 0"
    for i, (name, unit) in enumerate(_UNITS.items())
)

PARTS["rep"] = f"""SELECT ip, score, {_severity('score')} AS severity, is_internal, total_requests, breakdown FROM (
  SELECT ip, is_internal, total_requests, coalesce((SELECT sum(points) FROM reasons x WHERE x.ip = p.ip), 0)::BIGINT AS score,
    coalesce((SELECT string_agg(signal || '=' || points, ', ' ORDER BY signal) FROM reasons x WHERE x.ip = p.ip), '') AS breakdown
  FROM profile p)"""

# ---- detectors
_TRAIL = "(PARTITION BY ip ORDER BY timestamp RANGE BETWEEN INTERVAL 10799999999 MICROSECONDS PRECEDING AND CURRENT ROW)"

PARTS["logins"] = "SELECT * FROM req WHERE is_login"
PARTS["burst1"] = f"""SELECT DISTINCT ip FROM (SELECT ip, count(*) OVER w AS c, count(*) FILTER (is_failed_login) OVER w AS f
  FROM logins WINDOW w AS {_TRAIL}) WHERE c >= 15 AND f::DOUBLE / c >= 0.5"""
PARTS["tot1"] = """SELECT ip, min(timestamp) AS s, max(timestamp) AS e, count(*) AS n, sum(bytes)::BIGINT AS b,
  count(*) FILTER (is_failed_login) AS failed_logins, count(*) FILTER (is_success_login) AS successful_logins,
  count(DISTINCT user_agent) AS unique_user_agents, bool_or(is_bot_ua) AS bot_ua_used,
  count(*) FILTER (is_failed_login)::DOUBLE / count(*) AS ratio FROM logins GROUP BY ip"""
PARTS["lay1"] = """SELECT *, CASE WHEN ip IN (SELECT ip FROM burst1) THEN 'L1_burst' WHEN n >= 30 AND ratio >= 0.3 THEN 'L2_session'
  WHEN n >= 50 AND ratio >= 0.15 THEN 'L3_long_term' END AS layer FROM tot1"""
PARTS["d1"] = _single(
    "credential_stuffing", "s", "e", "n", "b", "layer",
    ", failed_logins, successful_logins, round_even(ratio, 3) AS failure_ratio, unique_user_agents, bot_ua_used",
    "lay1 WHERE layer IS NOT NULL",
)

PARTS["fails"] = f"""SELECT *, time_bucket(INTERVAL 300 SECONDS, timestamp) AS bucket FROM req
  WHERE method = 'POST' AND contains(lower(url_path), '/login') AND status IN (401, 403) AND NOT {_internal('ip')}"""
PARTS["flagged"] = """SELECT bucket, count(*) AS request_count, sum(bytes)::BIGINT AS total_bytes, count(DISTINCT ip) AS ip_count
  FROM fails GROUP BY bucket HAVING count(DISTINCT ip) >= 2 AND (count(*) >= 15 OR count(DISTINCT ip) >= 4)"""
PARTS["bucket_ips"] = "SELECT bucket, min(ip) AS ip FROM fails GROUP BY bucket"
PARTS["bucket_agent"] = """SELECT bucket, user_agent FROM (SELECT bucket, user_agent, row_number() OVER (PARTITION BY bucket
  ORDER BY count(DISTINCT ip) DESC, user_agent) AS r, count(DISTINCT ip) AS c FROM fails GROUP BY bucket, user_agent) WHERE r = 1 AND c >= 2"""
PARTS["d2"] = """SELECT 'distributed_credential_stuffing' AS attack_type, epoch(f.bucket)::BIGINT::VARCHAR AS session_key, ip, ip_count,
  f.bucket AS start_time, f.bucket + INTERVAL 300 SECONDS AS end_time, 300.0::DOUBLE AS duration_seconds, request_count, total_bytes,
  'L1_burst' AS layer, FALSE AS is_internal, 'T1110.004' AS mitre_id, TRUE AS ip_rotation_detected,
  a.user_agent IS NOT NULL AS coordinated, a.user_agent AS shared_user_agent, ip_count AS unique_ip_count
  FROM flagged f JOIN bucket_ips i ON f.bucket = i.bucket LEFT JOIN bucket_agent a ON f.bucket = a.bucket"""

PARTS["sqli"] = "SELECT * FROM req WHERE sqli_match"
PARTS["tot3"] = """SELECT ip, min(timestamp) AS s, max(timestamp) AS e, count(*) AS n, sum(bytes)::BIGINT AS b,
  count(*) FILTER (status = 200) AS successful_responses, bool_or(contains(lower(user_agent), 'sqlmap')) AS uses_sqlmap FROM sqli GROUP BY ip"""
PARTS["samples3"] = _samples("sqli", "url_query", 5)
PARTS["agents3"] = _seen("sqli", "user_agent", 5)
PARTS["all3"] = """SELECT tot3.*, samples3.t AS sample_payloads, agents3.t AS user_agents
  FROM tot3 JOIN samples3 USING (ip) JOIN agents3 USING (ip)"""
PARTS["d3"] = _single(
    "sql_injection", "s", "e", "n", "b",
    "CASE WHEN epoch_us(e) - epoch_us(s) < 600000000 THEN 'L1_burst' ELSE 'L3_long_term' END",
    ", n AS payload_count, successful_responses, sample_payloads, user_agents, uses_sqlmap", "all3",
)

PARTS["downloads"] = "SELECT * FROM req WHERE is_exfil_target AND status = 200"
PARTS["burst4"] = f"""SELECT DISTINCT ip FROM (SELECT ip, count(*) OVER w AS c, sum(bytes) OVER w AS b FROM downloads
  WINDOW w AS {_TRAIL}) WHERE c >= 30 AND b >= 5000000"""
PARTS["tot4"] = """SELECT ip, min(timestamp) AS s, max(timestamp) AS e, count(*) AS n, sum(bytes)::BIGINT AS b,
  max(bytes) AS max_single_response_bytes FROM downloads GROUP BY ip"""
PARTS["lay4"] = """SELECT *, CASE WHEN ip IN (SELECT ip FROM burst4) THEN 'L1_burst' WHEN b >= 10000000 AND n >= 100 THEN 'L2_session'
  WHEN b >= 30000000 THEN 'L3_long_term' END AS layer FROM tot4"""
PARTS["samples4"] = _samples("downloads", "url_full", 5)
PARTS["all4"] = """SELECT lay4.*, samples4.t AS sample_payloads FROM lay4
  JOIN samples4 USING (ip) WHERE layer IS NOT NULL"""
PARTS["d4"] = _single(
    "data_exfiltration", "s", "e", "n", "b", "layer",
    ", max_single_response_bytes, b // n AS avg_response_bytes, b // 512 AS estimated_records, sample_payloads",
    "all4",
)

PARTS["signs"] = """SELECT *, bot_requests::DOUBLE / total_requests AS ratio, bot_requests::DOUBLE / total_requests >= 0.2 AS many_bots,
  tor_requests > 0 AS tor, unique_user_agents >= 4 AS rotates FROM profile WHERE total_requests >= 30"""
PARTS["agents5"] = _counted("req", "user_agent", k=3)
PARTS["paths5"] = _counted("req", "url_path", k=5)
PARTS["all5"] = """SELECT signs.*, agents5.t AS user_agents, paths5.t AS endpoints_targeted,
  concat_ws(', ', CASE WHEN many_bots THEN 'bot_ua_ratio=' || round_even(ratio * 100, 0)::BIGINT || '%(' || bot_requests || ')' END,
    CASE WHEN tor THEN 'tor_ua(' || tor_requests || ')' END, CASE WHEN rotates THEN 'ua_rotation(' || unique_user_agents || ')' END,
    CASE WHEN rhythm THEN 'regular_interval(CV=' || printf('%.2f', interval_cv) || ')' END) AS signals
  FROM signs JOIN agents5 USING (ip) JOIN paths5 USING (ip) WHERE many_bots OR tor OR rotates OR rhythm"""
PARTS["d5"] = _single(
    "anonymizer", "first_seen", "last_seen", "total_requests", "total_bytes", "'L4_fingerprint'",
    ", signals, bot_requests AS bot_ua_count, round_even(ratio, 3) AS bot_ratio, tor_requests AS tor_ua_count, unique_user_agents, "
    "CASE WHEN interval_cv <> 0 THEN round_even(interval_cv, 3) END AS interval_cv, user_agents, endpoints_targeted",
    "all5",
)

PARTS["admin"] = "SELECT * FROM req WHERE is_admin"
PARTS["tot6"] = """SELECT ip, min(timestamp) AS s, max(timestamp) AS e, count(*) AS n, sum(bytes)::BIGINT AS b,
  count(*) FILTER (is_deep_admin) AS deep_admin_hits, count(*) FILTER (status IN (200, 302, 304)) AS successful_admin_access
  FROM admin GROUP BY ip HAVING count(*) >= 5 OR count(*) FILTER (is_deep_admin) >= 1"""
PARTS["agents6"] = _seen("admin", "user_agent", 3)
PARTS["all6"] = "SELECT tot6.*, agents6.t AS user_agents FROM tot6 JOIN agents6 USING (ip)"
PARTS["d6"] = _single(
    "admin_recon", "s", "e", "n", "b", "'L2_session'",
    ", deep_admin_hits, successful_admin_access, user_agents", "all6",
)

PARTS["top_paths"] = """SELECT ip, string_agg(url_path, ', ' ORDER BY url_path) AS common_endpoints,
  string_agg(url_path, chr(10) ORDER BY url_path) AS keyed FROM (SELECT ip, url_path,
  row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, url_path) AS r FROM req GROUP BY ip, url_path) WHERE r <= 5 GROUP BY ip"""
PARTS["prints"] = """SELECT sha256(dominant_user_agent || chr(10) || keyed || chr(10) || rhythm_class) AS session_key, * EXCLUDE (keyed) FROM (
  SELECT ip, dominant_user_agent, common_endpoints, keyed, CASE WHEN interval_cv < 0.3 THEN 'fast' ELSE 'normal' END AS rhythm_class,
    is_internal, first_seen, last_seen, total_requests, total_bytes FROM profile JOIN top_paths USING (ip) WHERE total_requests >= 20)"""
PARTS["d7"] = """SELECT 'distributed_fingerprint' AS attack_type, session_key, min(ip) AS ip, count(*) AS ip_count,
  min(first_seen) AS start_time, max(last_seen) AS end_time, (epoch_us(max(last_seen)) - epoch_us(min(first_seen))) / 1e6 AS duration_seconds,
  sum(total_requests)::BIGINT AS request_count, sum(total_bytes)::BIGINT AS total_bytes, 'L4_fingerprint' AS layer,
  bool_and(is_internal) AS is_internal, 'T1583.003' AS mitre_id, FALSE AS ip_rotation_detected, FALSE AS coordinated,
  NULL::VARCHAR AS shared_user_agent, dominant_user_agent AS dominant_ua,
  common_endpoints, rhythm_class FROM prints GROUP BY session_key, dominant_user_agent, common_endpoints, rhythm_class HAVING count(*) >= 2"""

PARTS["members"] = """SELECT 'distributed_credential_stuffing' AS attack_type, epoch(bucket)::BIGINT::VARCHAR AS session_key, ip,
    min(timestamp) AS seen FROM fails WHERE bucket IN (SELECT bucket FROM flagged) GROUP BY bucket, ip
  UNION ALL SELECT 'distributed_fingerprint', session_key, ip, first_seen FROM prints WHERE session_key IN (SELECT session_key FROM d7)"""

PARTS["found"] = " UNION ALL ".join(f"SELECT {_SESSION}, {i} AS detector_order FROM d{i + 1}" for i in range(7))

PARTS["ipnum"] = """SELECT ip, split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536
  + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT AS ip_number FROM (SELECT DISTINCT ip FROM req)"""
PARTS["geo"] = f"""SELECT i.ip, coalesce(g.country, 'Unknown') AS country FROM ipnum i
  LEFT JOIN (VALUES {_GEO}) g(a, b, country) ON i.ip_number BETWEEN g.a AND g.b"""
_NETWORKS = ", ".join(
    f"({4 if ':' not in n else 6}, {a}, {b}, {_quoted(c)})" for n, a, b, c in (*NETWORKS, *(("", a, a + n - 1, c) for a, n, c in COUNTRIES))
)
PARTS["derived"] = """SELECT DISTINCT unnest([
    {ip: '62.122.' || (user_id % 60) || '.' || (event_id % 5), v: 4, n: 62 * 16777216 + 122 * 65536 + user_id % 60 * 256 + event_id % 5},
    {ip: '78.140.' || (user_id // 256) || '.' || (user_id % 256), v: 4, n: 78 * 16777216 + 140 * 65536 + user_id},
    {ip: '2001:db8:' || (user_id % 5) || '::' || lower(to_hex(event_id % 64)), v: 6, n: user_id % 5 * 65536 + event_id % 64}]) AS a FROM events"""
PARTS["net"] = """SELECT ip, ip = '185.23.44.12' AS via_tor, ip = '103.44.55.66' AS via_proxy FROM (SELECT DISTINCT ip FROM req)"""

PARTS["sess"] = f"""SELECT f.*, coalesce(r.score, 0) AS score, coalesce(r.severity, 'LOW') AS severity, country, via_tor, via_proxy
  FROM (SELECT *, ip AS first_ip FROM found) f LEFT JOIN (SELECT ip AS rip, score, severity FROM rep) r ON first_ip = rip
  JOIN (SELECT ip AS gip, country FROM geo) g ON first_ip = gip JOIN (SELECT ip AS nip, via_tor, via_proxy FROM net) n ON first_ip = nip"""

# ---- chains
PARTS["one"] = "SELECT * FROM sess WHERE ip_count = 1"
PARTS["single"] = f"""SELECT 'single_ip' AS chain_type, ip, count(DISTINCT attack_type)::INTEGER AS stages_count,
  (SELECT string_agg(DISTINCT t.attack_type, ', ' ORDER BY t.attack_type) FROM one t WHERE t.ip = one.ip) AS stage_types,
  bool_or(is_internal) AS is_internal, min(start_time) AS first_seen,
  arg_max(end_time, (start_time, detector_order)) AS last_seen, sum(request_count)::BIGINT AS total_requests,
  sum(total_bytes)::BIGINT AS total_bytes, min(severity) AS max_severity,
  bool_or(attack_type = 'data_exfiltration') AND bool_or(attack_type IN ('sql_injection', 'credential_stuffing', 'admin_recon')) AS critical_combo
  FROM one GROUP BY ip HAVING count(DISTINCT attack_type) >= 2"""
PARTS["single_done"] = "SELECT *, (epoch_us(last_seen) - epoch_us(first_seen)) / 1e6 AS total_duration FROM single"

PARTS["hop"] = """SELECT ft, fip, tt, tip FROM (SELECT a.attack_type AS ft, a.ip AS fip, b.attack_type AS tt, b.ip AS tip,
  row_number() OVER (PARTITION BY a.attack_type, a.ip, b.attack_type ORDER BY b.start_time, b.ip) AS r
  FROM one a JOIN one b ON b.start_time >= a.end_time AND epoch_us(b.start_time) - epoch_us(a.end_time) <= 10800000000) WHERE r = 1"""


def _campaign(i: int, kinds) -> str:
    if len(kinds) == 2:
        return (
            f"SELECT {i} AS seq, fip || ' → ' || tip AS ip, [fip, tip] AS ips, ['{kinds[0]}', '{kinds[1]}'] AS kinds "
            f"FROM hop WHERE ft = '{kinds[0]}' AND tt = '{kinds[1]}'"
        )
    return (
        f"SELECT {i} AS seq, a.fip || ' → ' || a.tip || ' → ' || b.tip AS ip, [a.fip, a.tip, b.tip] AS ips, "
        f"['{kinds[0]}', '{kinds[1]}', '{kinds[2]}'] AS kinds FROM hop a JOIN hop b ON a.tt = b.ft AND a.tip = b.fip "
        f"WHERE a.ft = '{kinds[0]}' AND a.tt = '{kinds[1]}' AND b.tt = '{kinds[2]}'"
    )


PARTS["camp"] = " UNION ALL ".join(_campaign(i, s) for i, s in enumerate(C.CAMPAIGN_SEQUENCES))
PARTS["camp_row"] = "SELECT seq, ip AS chain_ip, array_to_string(kinds, ', ') AS stage_types, unnest(ips) AS sip, unnest(kinds) AS kind, generate_subscripts(ips, 1) - 1 AS position FROM camp"
PARTS["camp_step"] = """SELECT c.seq, c.chain_ip, c.stage_types, c.position, s.* FROM camp_row c JOIN one s ON s.ip = c.sip AND s.attack_type = c.kind"""
PARTS["camp_done"] = f"""SELECT 'multi_ip_campaign' AS chain_type, chain_ip AS ip, count(*)::INTEGER AS stages_count, stage_types, FALSE AS is_internal,
  min(start_time) AS first_seen, arg_max(end_time, position) AS last_seen, sum(request_count)::BIGINT AS total_requests,
  sum(total_bytes)::BIGINT AS total_bytes, arg_max(severity, {_rank('severity')}) AS max_severity, TRUE AS critical_combo,
  (epoch_us(arg_max(end_time, position)) - epoch_us(min(start_time))) / 1e6 AS total_duration FROM camp_step GROUP BY seq, chain_ip, stage_types, arg_first"""
PARTS["camp_done"] = PARTS["camp_done"].replace(", arg_first", "")

_CHAIN = (
    "chain_type, ip, stages_count, stage_types, is_internal, first_seen, last_seen, round(total_duration, 6) AS total_duration, "
    "total_requests, total_bytes, max_severity, critical_combo"
)
PARTS["chains"] = f"SELECT {_CHAIN} FROM single_done UNION ALL SELECT {_CHAIN} FROM camp_done"
PARTS["steps"] = """SELECT 'single_ip' AS chain_type, o.ip AS chain_ip, c.stage_types,
    (row_number() OVER (PARTITION BY o.ip ORDER BY start_time, detector_order) - 1)::INTEGER AS position, attack_type AS stage, o.ip,
    start_time AS "start", end_time AS "end", duration_seconds AS duration, request_count AS requests, o.total_bytes AS bytes, mitre_id AS mitre
    FROM one o JOIN single c ON o.ip = c.ip
  UNION ALL SELECT 'multi_ip_campaign', chain_ip, stage_types, position::INTEGER, attack_type, ip, start_time, end_time, duration_seconds,
    request_count, total_bytes, mitre_id FROM camp_step"""

# ---- damage, baseline
PARTS["suspect"] = "SELECT DISTINCT ip FROM sess WHERE severity IN ('HIGH', 'CRITICAL') AND ip_count = 1"
PARTS["moved"] = """SELECT count(*) AS n, count(*) FILTER (url_path = '/api/transfer') * 250 + count(*) FILTER (url_path = '/api/payment') * 80 AS fraud
  FROM req WHERE is_transaction AND status = 200 AND ip IN (SELECT ip FROM suspect)"""
PARTS["stolen"] = "SELECT coalesce(sum(total_bytes), 0)::BIGINT AS b FROM sess WHERE attack_type = 'data_exfiltration'"
PARTS["money"] = """SELECT b // 512 AS estimated_records, b AS exfil_bytes, round_even(b / 1e6, 2) AS exfil_mb, b // 512 * 5 AS dark_market_loss_usd,
  b // 512 * 50 AS compliance_fine_usd, (b // 512 * 55 * 2)::BIGINT AS reputation_loss_usd, fraud AS fraud_potential_usd, n AS suspicious_transfers,
  b // 512 * 55 * 3 + fraud AS total_loss_usd, (b // 512 * 55 * 3 + fraud) * 12650 AS total_loss_uzs FROM stolen, moved"""

PARTS["cohort"] = "SELECT ip, CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 'attacker' ELSE 'normal' END AS cohort FROM rep"
PARTS["base"] = """SELECT c.cohort, coalesce(avg(span_seconds), 0) AS avg_session_duration, coalesce(avg(request_rate) FILTER (request_rate > 0), 0) AS avg_request_rate,
  coalesce(avg(total_bytes), 0) AS avg_bytes_per_ip, coalesce(sum(total_requests), 0)::BIGINT AS total_requests, count(ip) AS unique_ips
  FROM (VALUES ('normal'), ('attacker')) c(cohort) LEFT JOIN (SELECT cohort AS co, profile.* FROM profile JOIN cohort USING (ip)) ON co = c.cohort GROUP BY c.cohort"""
PARTS["creq"] = "SELECT cohort, req.* FROM req JOIN cohort USING (ip)"
PARTS["part_of"] = "SELECT attack_type, session_key, ip FROM one UNION ALL SELECT attack_type, session_key, ip FROM members"

# ---- actions and endpoints
PARTS["actions"] = """SELECT ip, ['watchlist', 'ignore', 'block', 'clear', 'shrug'][(lineno // 12) % 5 + 1] AS action, 'note ' || lineno AS note,
  timestamp AS set_at FROM req"""
PARTS["last_action"] = """SELECT ip, action, note, set_at FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY set_at DESC, action DESC, note DESC) AS r
  FROM actions WHERE action <> 'shrug') WHERE r = 1 AND action <> 'clear'"""
PARTS["changes"] = f"""SELECT {_CATEGORIES}[user_id % 5 + 1] AS category, trim(CASE WHEN event_id % 11 = 0 THEN '/api/export'
    WHEN event_id % 13 = 0 THEN 'custom/' || user_id ELSE ' /custom/' || user_id END) AS path,
  CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'add' END AS change, ts AS set_at FROM events"""
PARTS["defaults"] = f"SELECT * FROM (VALUES {_DEFAULTS}) v(category, path)"
PARTS["custom"] = """SELECT category, path FROM (SELECT category, path, change, row_number() OVER (PARTITION BY category, path ORDER BY set_at DESC, change DESC) AS r
  FROM changes WHERE starts_with(path, '/') AND (category, path) NOT IN (SELECT (category, path) FROM defaults)) WHERE r = 1 AND change = 'add'"""
PARTS["merged"] = "SELECT category, path, 'default' AS origin FROM defaults UNION ALL SELECT category, path, 'custom' FROM custom"


def sql(select: str, parts: dict[str, str] = PARTS) -> str:
    """A statement with the parts it names, in order of need."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"(?<![.'\w])([a-z_]+[0-9]?)\b(?!\()", text):
            if name in parts and name not in order and _is_table(name, text):
                need(parts[name])
                if name not in order:
                    order.append(name)

    need(select)
    stated = ", ".join(f"{name} AS ({parts[name]})" for name in order)
    return f"WITH {stated} {select}" if stated else select


def _is_table(name: str, text: str) -> bool:
    return re.search(rf"(?:FROM|JOIN|,)\s+{name}\b(?!\s*(?:AS\s+\w+\s*)?\()", text) is not None


_FLAT = _SESSION.replace("duration_seconds", "round(duration_seconds, 6) AS duration_seconds")


def _detector(n: int, more: str) -> str:
    return f"SELECT {_FLAT}, {more} FROM d{n}"


SELECTS = {
    "parse_log": "SELECT lineno, timestamp, ip, method, url_full, status, bytes, user_agent FROM parsed",
    "parse_rejects": "SELECT lineno, value, 'no match' AS reason FROM matched WHERE NOT ((combined AND m1) OR (NOT combined AND m2))",
    "enrich_flags": """SELECT lineno, timestamp, timestamp_local, ip, method, url_path, url_query, status, bytes, is_sensitive, is_admin,
      is_deep_admin, is_transaction, is_exfil_target, is_login, is_failed_login, is_success_login, is_bot_ua, is_tor_ua, hour_local,
      is_off_hours FROM req""",
    "url_decode_flags": "SELECT lineno, url_full, url_decoded, sqli_match FROM req",
    "parse_enrich": f"""SELECT ip, count(*) AS requests, count(*) FILTER (method = 'POST' AND url_path IN ({_LOGIN}) AND status IN (400, 401, 403)) AS failed_logins,
      count(*) FILTER (regexp_matches(lower(url_decode(url_decode(url_full))), {_SQLI}) OR regexp_matches(lower(url_full), {_SQLI})) AS sqli,
      count(*) FILTER ({_below('url_path', C.EXFIL_PREFIXES)}) AS exfil_hits, sum(bytes)::BIGINT AS bytes, max(timestamp) AS last_seen
      FROM (SELECT *, split_part(url_full, '?', 1) AS url_path FROM parsed) GROUP BY ip""",
    "endpoint_join_flags": """SELECT url_path, coalesce(bool_or(category = 'sensitive_prefixes'), FALSE) AS is_sensitive,
      coalesce(bool_or(category = 'admin_endpoints'), FALSE) AS is_admin, coalesce(bool_or(category = 'transaction'), FALSE) AS is_transaction,
      coalesce(bool_or(category = 'exfil_targets'), FALSE) AS is_exfil_target,
      coalesce(bool_or(category = 'login_paths' AND path = url_path), FALSE) AS is_login_path
      FROM (SELECT DISTINCT url_path FROM req) JOIN merged ON url_path = path OR starts_with(url_path, path || '/') GROUP BY url_path""",
    "ip_flags": f"SELECT ip, TRUE AS is_valid, {_internal('ip')} AS is_internal, ip_number FROM ipnum",
    "ip_profile": """SELECT ip, dominant_user_agent, unique_user_agents, total_requests, total_bytes, failed_logins, successful_logins,
      sqli_payloads, sensitive_ok, sensitive_bytes, admin_hits, deep_admin_hits, bot_requests, tor_requests, off_hours_requests, min_bytes,
      max_bytes, first_seen, last_seen, round(interval_cv, 6) AS interval_cv, round(request_rate, 6) AS request_rate,
      round(span_seconds, 6) AS span_seconds, is_internal FROM profile""",
    "iat_cv": "SELECT ip, round(interval_cv, 6) AS interval_cv FROM cv",
    "ip_reputation": "SELECT * FROM rep",
    "score_reasons": "SELECT * FROM reasons",
    "top_reputation": "SELECT ip, score, severity, is_internal, total_requests FROM rep ORDER BY score DESC, ip LIMIT 15",
    "det_credential_stuffing": _detector(1, "failed_logins, successful_logins, failure_ratio, unique_user_agents, bot_ua_used"),
    "det_distributed_login": _detector(2, "unique_ip_count"),
    "det_sql_injection": _detector(
        3, "payload_count, successful_responses, sample_payloads, user_agents, uses_sqlmap"
    ),
    "det_data_exfiltration": _detector(
        4, "max_single_response_bytes, avg_response_bytes, estimated_records, sample_payloads"
    ),
    "det_anonymizer": _detector(
        5, "signals, bot_ua_count, bot_ratio, tor_ua_count, unique_user_agents, interval_cv, user_agents, endpoints_targeted"
    ),
    "det_admin_recon": _detector(6, "deep_admin_hits, successful_admin_access, user_agents"),
    "det_fingerprint": _detector(7, "dominant_ua, common_endpoints, rhythm_class"),
    "login_bursts": "SELECT ip FROM burst1",
    "download_bursts": "SELECT ip FROM burst4",
    "login_buckets": "SELECT bucket, request_count, total_bytes, ip_count FROM flagged",
    "ip_fingerprints": "SELECT * FROM prints",
    "members": "SELECT * FROM members",
    "evidence_paths": """SELECT 'sql_injection' AS attack_type, ip, url_path, count(*) AS n FROM sqli GROUP BY ip, url_path
      UNION ALL SELECT 'data_exfiltration', ip, url_path, count(*) FROM downloads GROUP BY ip, url_path
      UNION ALL SELECT 'admin_recon', ip, url_path, count(*) FROM admin GROUP BY ip, url_path""",
    "sessions_enriched": f"SELECT {_FLAT}, score, severity, country, via_tor, via_proxy FROM sess",
    "detector_subset": """SELECT attack_type, ip, request_count, layer FROM d3 UNION ALL SELECT attack_type, ip, request_count, layer FROM d6""",
    "geo_range_join": "SELECT * FROM geo",
    "tor_proxy_flags": "SELECT * FROM net",
    "chains_single_ip": f"SELECT {_CHAIN} FROM single_done",
    "campaigns": f"SELECT {_CHAIN} FROM camp_done",
    "chain_steps": 'SELECT chain_type, chain_ip, stage_types, position, stage, ip, "start", "end", round(duration, 6) AS duration, requests, bytes, mitre FROM steps',
    "chains_by_importance": f"SELECT * FROM chains ORDER BY {_rank('max_severity')} DESC, stages_count DESC, first_seen, chain_type, ip LIMIT 5",
    "chains_with_ip": """SELECT chain_type, ip, stage_types FROM chains WHERE ip = '103.44.55.66' OR list_contains(string_split(ip, ' → '), '103.44.55.66')""",
    "damage_estimate": "SELECT * FROM money",
    "baseline_profile": """SELECT cohort, round(avg_session_duration, 6) AS avg_session_duration, round(avg_request_rate, 6) AS avg_request_rate,
      round(avg_bytes_per_ip, 6) AS avg_bytes_per_ip, total_requests, unique_ips FROM base""",
    "cohort_hours": "SELECT cohort, hour_local, count(*) AS n FROM creq GROUP BY cohort, hour_local",
    "peak_hours": """SELECT * FROM (SELECT cohort, hour_local, count(*) AS n, row_number() OVER (PARTITION BY cohort ORDER BY count(*) DESC, hour_local)::INTEGER AS rank
      FROM creq GROUP BY cohort, hour_local) WHERE rank <= 3""",
    "top_endpoints": """SELECT * FROM (SELECT cohort, url_path, count(*) AS n, row_number() OVER (PARTITION BY cohort ORDER BY count(*) DESC, url_path)::INTEGER AS rank
      FROM creq GROUP BY cohort, url_path) WHERE rank <= 10""",
    "top_user_agents": """SELECT * FROM (SELECT cohort, user_agent, count(*) AS n, row_number() OVER (PARTITION BY cohort ORDER BY count(*) DESC, user_agent)::INTEGER AS rank
      FROM creq GROUP BY cohort, user_agent) WHERE rank <= 5""",
    "ip_vs_normal": f"""SELECT *, {_duration_text('span_seconds')} AS span_text, {_duration_text('normal_span_seconds')} AS normal_span_text,
      {_bytes_text('total_bytes')} AS bytes_text, {_bytes_text('normal_bytes')} AS normal_bytes_text FROM (
      SELECT p.ip, span_seconds, total_bytes, round(p.total_requests / greatest(span_seconds / 60, 1), 6) AS requests_per_minute,
        (SELECT url_path FROM req q WHERE q.ip = p.ip GROUP BY url_path ORDER BY count(*) DESC, url_path LIMIT 1) AS top_endpoint,
        round(avg_session_duration, 6) AS normal_span_seconds, round(avg_bytes_per_ip, 6) AS normal_bytes,
        round(avg_request_rate, 6) AS normal_requests_per_minute,
        (SELECT url_path FROM creq WHERE cohort = 'normal' GROUP BY url_path ORDER BY count(*) DESC, url_path LIMIT 1) AS normal_top_endpoint
      FROM profile p, base WHERE base.cohort = 'normal' AND avg_session_duration <> 0)""",
    "hourly_activity": "SELECT hour_local, count(*) AS n FROM req GROUP BY hour_local",
    "hourly_per_ip": "SELECT ip, hour_local, count(*) AS n FROM req GROUP BY ip, hour_local",
    "status_distribution": "SELECT ip, status, count(*) AS n FROM req GROUP BY ip, status",
    "top_paths_per_ip": """SELECT * FROM (SELECT ip, url_path, count(*) AS n, row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, url_path)::INTEGER AS rank
      FROM req GROUP BY ip, url_path) WHERE rank <= 10""",
    "top_agents_per_ip": """SELECT * FROM (SELECT ip, user_agent, count(*) AS n, row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, user_agent)::INTEGER AS rank
      FROM req GROUP BY ip, user_agent) WHERE rank <= 5""",
    "top_ips": f"""SELECT *, {_bytes_text('bytes')} AS volume FROM (SELECT ip, count(*) AS requests, sum(bytes)::BIGINT AS bytes FROM req GROUP BY ip
      ORDER BY bytes DESC, ip LIMIT 15)""",
    "top_sessions": """SELECT attack_type, ip, score, severity, request_count, total_bytes FROM sess
      ORDER BY score DESC, start_time, attack_type, ip LIMIT 15""",
    "filtered_sessions": """SELECT attack_type, ip, severity, round(duration_seconds, 6) AS duration_seconds FROM sess
      WHERE severity IN ('CRITICAL', 'HIGH') AND duration_seconds >= 600 AND NOT is_internal""",
    "headline": """SELECT (SELECT count(*) FROM req) AS total_requests, (SELECT count(DISTINCT ip) FROM req) AS unique_ips,
      (SELECT count(*) FROM sess) AS sessions, (SELECT coalesce(sum(total_bytes), 0)::BIGINT FROM sess WHERE attack_type <> 'anonymizer') AS stolen_bytes,
      (SELECT count(*) FROM chains) AS chains, (SELECT estimated_records FROM money) AS estimated_records""",
    "layer_agreement": """SELECT ip, count(DISTINCT layer) AS layers, count(DISTINCT layer) >= 2 AS high_confidence
      FROM part_of JOIN (SELECT attack_type, session_key, layer FROM sess) USING (attack_type, session_key) GROUP BY ip""",
    "mitre_per_ip": """SELECT ip, string_agg(DISTINCT mitre_id, ', ' ORDER BY mitre_id) AS mitre_ids
      FROM part_of JOIN (SELECT attack_type, session_key, mitre_id FROM sess) USING (attack_type, session_key) GROUP BY ip""",
    "sessions_with_ip": """SELECT attack_type, ip, start_time FROM sess WHERE ip = '45.142.0.3' AND ip_count = 1
      OR (attack_type, session_key) IN (SELECT (attack_type, session_key) FROM members WHERE ip = '45.142.0.3')""",
    "timeline": 'SELECT ip, start_time AS "start", end_time AS finish, attack_type, severity FROM sess',
    "narrative": """SELECT start_time, ip, '  [' || strftime(start_time, '%H:%M:%S') || '] ' || printf('%-40s', attack_type) || ' | ' || printf('%-32s', ip)
      || ' | ' || request_count || ' reqs' || CASE WHEN total_bytes / 1048576 >= 1 THEN printf(' | %.1f MB', total_bytes / 1048576) ELSE '' END
      || CASE WHEN via_tor THEN ' [TOR]' ELSE '' END || CASE WHEN ip_rotation_detected THEN ' [IP ROTATION]' ELSE '' END
      || CASE WHEN country = 'Unknown' THEN '' ELSE ' [' || country || ']' END AS line,
      attack_type || ' (' || strftime(start_time, '%H:%M') || ')' AS arrow_step FROM sess""",
    "report_table": f"""SELECT attack_type, severity, score, ip, country, CASE WHEN via_tor THEN '✓' ELSE '' END AS tor,
      CASE WHEN ip_rotation_detected THEN '✓' ELSE '' END AS ip_rotation, CASE WHEN coordinated THEN '✓' ELSE '' END AS coordination,
      is_internal AS internal, start_time AS "start", end_time AS "end", trunc(duration_seconds)::BIGINT AS duration_s,
      {_duration_hms('duration_seconds')} AS duration, request_count AS requests, total_bytes AS bytes, layer, mitre_id AS mitre FROM sess""",
    "attack_table": f"""SELECT s.attack_type, s.ip, CASE WHEN via_tor THEN 'TOR' WHEN via_proxy THEN 'Proxy' ELSE '' END AS anonymizer,
      {_duration_text('duration_seconds')} AS duration, {_bytes_text('total_bytes')} AS volume,
      coalesce((SELECT string_agg(url_path || ' (' || n || ')', '  |  ' ORDER BY n DESC, url_path) FROM (
        SELECT a, ip, url_path, n, row_number() OVER (PARTITION BY a, ip ORDER BY n DESC, url_path) AS r FROM (
          SELECT 'sql_injection' AS a, ip, url_path, count(*) AS n FROM sqli GROUP BY ip, url_path
          UNION ALL SELECT 'data_exfiltration', ip, url_path, count(*) FROM downloads GROUP BY ip, url_path
          UNION ALL SELECT 'anonymizer', ip, url_path, count(*) FROM req GROUP BY ip, url_path)) x
        WHERE x.a = s.attack_type AND x.ip = s.ip AND r <= 3), '') AS endpoints,
      coalesce(left(CASE s.attack_type WHEN 'sql_injection' THEN (SELECT url_query FROM sqli q WHERE q.ip = s.ip ORDER BY timestamp, lineno LIMIT 1)
        WHEN 'data_exfiltration' THEN (SELECT url_full FROM downloads q WHERE q.ip = s.ip ORDER BY timestamp, lineno LIMIT 1) END, 80), '') AS payload,
      coalesce(l.action, '') AS action FROM sess s LEFT JOIN last_action l ON l.ip = s.first_ip""",
    "ip_actions_current": "SELECT * FROM last_action",
    "ips_with_action": "SELECT ip FROM last_action WHERE action = 'block'",
    "endpoints_merged": "SELECT * FROM merged",
    "format_texts": f"""SELECT ip, {_bytes_text('total_bytes')} AS volume, {_duration_text('span_seconds')} AS span,
      {_duration_hms('span_seconds')} AS span_hms, {_severity('total_requests')} AS tier, ({_rank(_severity('total_requests'))})::INTEGER AS tier_rank FROM profile""",
}


_SUSPECT = "WHERE ip = '103.44.55.66'"
SELECTS |= {
    "text_scan": """SELECT ip AS what, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM raw GROUP BY ip
      UNION ALL SELECT 'no match', count(*), NULL FROM raw WHERE lineno % 97 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'bad time', sum(1 + 3 * (lineno % 97 = 0)::INTEGER)::BIGINT, NULL FROM raw WHERE lineno % 89 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'bad number', sum(1 + 3 * (lineno % 97 = 0)::INTEGER)::BIGINT, NULL FROM raw WHERE lineno % 83 = 0 HAVING count(*) > 0""",
    "source_lists": f"""SELECT 'proxy' AS kind, ip AS value FROM (SELECT DISTINCT ip FROM req) UNION ALL SELECT 'tor', ip FROM (SELECT DISTINCT ip FROM req)
      UNION ALL SELECT 'country', country FROM (VALUES {_GEO}) g(a, b, country)
      UNION ALL SELECT 'endpoint', unnest(['exfil_targets=/dump', 'exfil_targets=/dump2', 'admin_endpoints=/root'])""",
    "geo_networks": f"""SELECT a.ip AS ip, coalesce((SELECT country FROM (VALUES {_NETWORKS}) g(v, f, t, country) WHERE g.v = a.v AND a.n BETWEEN f AND t
      ORDER BY f DESC, t LIMIT 1), 'Unknown') AS country FROM derived""",
}

_TABLES = {
    "profile": SELECTS["ip_profile"], "sessions": SELECTS["sessions_enriched"], "members": SELECTS["members"],
    "evidence_counts": SELECTS["evidence_paths"], "reputation": SELECTS["ip_reputation"], "reasons": SELECTS["score_reasons"],
    "chains": "SELECT * FROM chains", "damage": SELECTS["damage_estimate"], "cohorts": "SELECT * FROM cohort", "baseline": SELECTS["baseline_profile"],
}
_DETAIL = {
    "profile": "ip_profile", "reputation": "ip_reputation", "sessions": "sessions_enriched", "reasons": "score_reasons", "paths": "top_paths_per_ip",
    "agents": "top_agents_per_ip", "statuses": "status_distribution", "hours": "hourly_per_ip", "mitre": "mitre_per_ip",
}
SELECTS |= {
    "analysis_tables": digests_sql(_TABLES),
    "ip_detail": digests_sql(
        {name: f"SELECT * FROM ({SELECTS[query]}) {_SUSPECT}" for name, query in _DETAIL.items()}
        | {"chain": f"""SELECT * FROM chains WHERE ip = '103.44.55.66' OR list_contains(string_split(ip, ' → '), '103.44.55.66')
          ORDER BY {_rank('max_severity')} DESC, stages_count DESC, first_seen, chain_type, ip LIMIT 1"""}
    ),
    "report_files": digests_sql({
        "attacks_csv": SELECTS["report_table"], "attacks_json": SELECTS["sessions_enriched"], "ip_reputation_csv": SELECTS["ip_reputation"],
        "attack_chains_json": "SELECT * FROM chains", "economic_damage_json": SELECTS["damage_estimate"],
        "narrative_text": f"""SELECT line AS value FROM ({SELECTS["narrative"]}) UNION ALL SELECT '  -> ' || arrow_step FROM ({SELECTS["narrative"]})
          UNION ALL SELECT unnest([repeat('=', 70), '  ATTACK CHAIN', repeat('=', 70), '', '  Chain:'])""",
    }),
}


def _live(source: str, first: str, second: str, test: str) -> str:
    """Alerts of a live burst: hits of the trailing window by second, without those within a window of another."""
    return f"""SELECT ip, second, first_sum, second_sum FROM (
      SELECT *, lag(second) OVER (PARTITION BY ip ORDER BY second) AS earlier FROM (
        SELECT ip, timestamp AS second, (sum(a) OVER w)::BIGINT AS first_sum, (sum(b) OVER w)::BIGINT AS second_sum FROM (
          SELECT ip, timestamp, sum({first}) AS a, sum({second}) AS b FROM {source} GROUP BY ip, timestamp)
        WINDOW w AS (PARTITION BY ip ORDER BY timestamp RANGE BETWEEN INTERVAL 10799 SECONDS PRECEDING AND CURRENT ROW))
      WHERE {test}) WHERE earlier IS NULL OR epoch(second) - epoch(earlier) > 10800"""


# Over the rows parsed from text, whose times carry whole seconds
STREAMS = {
    "stream_parse": SELECTS["parse_enrich"],
    "stream_distributed_login": """SELECT ip, ip_count, start_time, end_time, request_count, total_bytes, coordinated, shared_user_agent FROM d2""",
    "stream_burst": _live("downloads", "bytes", "1", "first_sum >= 5000000 AND second_sum >= 30"),
    "stream_login_burst": _live(
        "logins", "is_failed_login::INTEGER", "1 - is_failed_login::INTEGER",
        "first_sum + second_sum >= 15 AND first_sum >= 0.5 * (first_sum + second_sum)",
    ),
    "stream_recompute": "SELECT ip, score, severity, is_internal, total_requests FROM rep",
}


def all_oracles() -> dict[str, str]:
    from_text = {**PARTS, "pathed": PARTS["pathed"].replace("FROM raw", "FROM parsed")}
    batch = {name: sql(select) for name, select in SELECTS.items()}
    return {**batch, **{name: sql(select, from_text) for name, select in STREAMS.items()}}
