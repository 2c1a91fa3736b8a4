"""An access log derived from the ``events`` table, for the registered queries.

``FIXTURES.md`` states the rules; they use integer arithmetic and concatenation
only, so any SQL engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewarden.operators.enrich import enrich
from tracewarden.schema import COUNTRY_RANGES
from tracewarden.sources.lists import proxies, tor_exits

ANDROID = "Mozilla/5.0 (Linux; Android 14)"
FIREFOX = "Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0"
SQLI_URL = "/api/v1/search?q=1%27%20UNION%20SELECT%20pan%20FROM%20cards--"


# What persona p = 0 … 11 adds; the parts that depend on r = k mod 120 or the
# user are in _ROW (every remainder the rules take of k divides 120).
_START_US = "array(32400000000, 41400000000, 46800000000, 28800000000, 0, 36000000000, 0, 0, 0, 0, 0, 0)"
_SLOWER = "array(360, 720, 360, 720, 10, 1440, 10, 10, 10, 10, 10, 10)"
_IP = (
    "array('185.23.44.12', '91.199.12.77', '103.44.55.66', '10.0.0.5', '176.88.14.201', '45.142.0.', '62.122.55.', "
    "'10.0.3.', '78.140.', '78.140.', '78.140.', '78.140.')"
)
_HOSTS = "array(1, 1, 1, 1, 1, 8, 3, 2, 1, 1, 1, 1)"
_URL = (
    f"array('/api/v1/login', '{SQLI_URL}', '/api/v1/clients/export', '/admin', '', '/auth/login', '/api/v1/cards', "
    "'/api/v1/profile', '', '', '', '')"
)
_BROWSE = "array('/', '/dashboard', '/api/v1/accounts', '/api/transfer', '/api/payment')"
_RECON = "array('/admin/users', '/internal/audit', '/admin', '/admin')"
_AGENT = (
    f"array('python-requests/2.31.0', 'sqlmap/1.7.2#stable', 'curl/8.0.1', '{ANDROID}', '', 'okhttp/4.9', '{ANDROID}', "
    f"'{FIREFOX}', '{ANDROID}', '{ANDROID}', '{ANDROID}', '{ANDROID}')"
)
_ROW = f"""struct(
    event_id AS lineno,
    timestamp_micros(1704067200000000 + if(p = 7, event_id * 7000000 + r % 5 * 1000000,
        {_START_US}[p] + d div {_SLOWER}[p])) AS timestamp,
    concat({_IP}[p], if(p > 7, concat(user_id div 256, '.', user_id % 256), if(p > 4, string(r % {_HOSTS}[p]), ''))) AS ip,
    if(p IN (0, 5), 'POST', 'GET') AS method,
    CASE WHEN p = 3 THEN {_RECON}[r % 4] WHEN p = 2 AND r % 20 = 0 THEN '/admin/users'
        WHEN p = 4 OR p > 7 THEN {_BROWSE}[r % 5] ELSE {_URL}[p] END AS url_full,
    CASE WHEN p IN (0, 5) AND r % 5 <> 0 THEN 401 WHEN p = 3 AND r % 3 = 0 THEN 403 ELSE 200 END AS status,
    bigint(floor(value * if(p = 2, 10000, 100))) AS bytes,
    if(p = 4, concat('Client-', r % 6, '/1.0'), {_AGENT}[p]) AS user_agent)"""


def requests_of(events: DataFrame) -> DataFrame:
    """Parsed rows of an events table, batch or streaming.

    Filters stop at the generator, so later steps see plain columns, as over a
    stored table.
    """
    shaped = events.selectExpr(
        "event_id",
        "user_id",
        "value",
        "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts) AS d",
        "int(event_id % 12) AS p",
        "int(event_id div 12 % 120) AS r",
    )
    return shaped.selectExpr(f"inline(array({_ROW}))")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def raw_requests(spark: SparkSession, folder: str) -> DataFrame:
    return requests_of(events(spark, folder).select("event_id", "user_id", "value", "ts"))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return enrich(raw_requests(spark, folder))


def lines_of(rows: DataFrame) -> DataFrame:
    """Text lines of parsed rows: combined format for even k, custom for odd, plus noise lines."""
    line = """CASE WHEN lineno div 12 % 2 = 0
        THEN format_string('%s - - [%s +0000] "%s %s HTTP/1.1" %d %d "-" "%s"', ip,
            date_format(timestamp, 'dd/MMM/yyyy:HH:mm:ss'), method, url_full, status, bytes, user_agent)
        ELSE concat_ws(' ', date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"), ip, method, url_full, status, bytes,
            user_agent) END"""
    noise = "if(lineno % 97 = 0, {}, NULL)"
    extra = [noise.format(x) for x in ("concat('garbage ', lineno)", "concat('# comment ', lineno)", "'   '")]
    return rows.selectExpr("lineno", f"explode(array_compact(array({line}, {', '.join(extra)}))) AS value")


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines_of(raw_requests(spark, folder))


def tor(spark: SparkSession) -> DataFrame:
    return tor_exits(spark.createDataFrame([("# exits",), ("185.23.44.12",)], "value string"))


def proxy_list(spark: SparkSession) -> DataFrame:
    feed = [("103.44.55.66:8080",), ("185.23.44.12:3128",), ("103.44.55.66:80",)]
    return proxies(spark.createDataFrame(feed, "value string"))


# Invented ranges: a /16 in 45.142 and 62.122, a /24 in 91.199.12, a /16 in 103.44
COUNTRIES = (
    (45 * 2**24 + 142 * 2**16, 2**16, "Moldova"),
    (62 * 2**24 + 122 * 2**16, 2**16, "Russia"),
    (91 * 2**24 + 199 * 2**16 + 12 * 2**8, 2**8, "Poland"),
    (103 * 2**24 + 44 * 2**16, 2**16, "India"),
)


def country_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, a + n - 1, c) for a, n, c in COUNTRIES], COUNTRY_RANGES)


# Invented networks that lie in one another: text, first and last number (IPv6 from its third and last group), country
NETWORKS = (
    ("62.0.0.0/8", 62 * 2**24, 63 * 2**24 - 1, "Outer"),
    ("62.122.55.1-62.122.55.2", 62 * 2**24 + 122 * 2**16 + 55 * 2**8 + 1, 62 * 2**24 + 122 * 2**16 + 55 * 2**8 + 2, "Two hosts"),
    ("78.140.0.0/16", 78 * 2**24 + 140 * 2**16, 78 * 2**24 + 141 * 2**16 - 1, "Users"),
    ("78.140.0.7", 78 * 2**24 + 140 * 2**16 + 7, 78 * 2**24 + 140 * 2**16 + 7, "One user"),
    ("2001:db8::/32", 0, 2**32 - 1, "Wide"),
    ("2001:db8:3::/48", 3 * 2**16, 4 * 2**16 - 1, "Site"),
    ("2001:db8:3::10-2001:db8:3::2f", 3 * 2**16 + 16, 3 * 2**16 + 47, "Hosts"),
)
# Addresses of an event: two of IPv4 and one of IPv6, by user
DERIVED_IPS = (
    "concat('62.122.', user_id % 60, '.', event_id % 5)",
    "concat('78.140.', user_id div 256, '.', user_id % 256)",
    "concat('2001:db8:', lower(hex(user_id % 5)), '::', lower(hex(event_id % 64)))",
)
