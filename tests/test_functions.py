from __future__ import annotations

import dataclasses
import ipaddress
import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tracewarden.config import DEFAULT, SENSITIVE_PREFIXES, SQLI_PATTERNS, SQLI_PRECHECK
from tracewarden.functions import net, text

URLS = [
    "/a?q=1%2520or+1", "/a?x=100%", "/a?x=%zz%27", "/a?b=%ff%41", "/a?x=%2B+", "/b?", "/b", "/b?c?d", "?", "",
    "/q?a=SELECT 1\rx FROM t", "/x?union select", "/p--", "/p--x", "/p--%20y", "/%c3%9cber?X=%C3%84", "/a#b?c",
    "/q?%2527", "/q?x=sleep%28 5 )", "/q?1;DROP%20TABLE", "/q?or 1 = 1", "/q?a=select\nfrom x", "/q?concat (",
]


def _table(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def _run(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_url_parts(spark):
    df = _table(spark, URLS)
    assert _run(df, text.url_path(F.col("v"))) == [u.split("?", 1)[0] for u in URLS]
    assert _run(df, text.url_query(F.col("v"))) == [u.split("?", 1)[1] if "?" in u else "" for u in URLS]


def test_decoding_is_that_of_unquote_twice(spark):
    assert _run(_table(spark, URLS), text.url_decoded(F.col("v"))) == [unquote(unquote(u)).lower() for u in URLS]


def test_sqli_matches_python_regex(spark):
    every = re.compile("|".join(f"(?:{p})" for p in SQLI_PATTERNS), re.IGNORECASE)
    want = [bool(every.search(unquote(unquote(u)).lower()) or every.search(u.lower())) for u in URLS]
    df = _table(spark, URLS)
    assert _run(df, text.sqli_match(F.col("v"), text.url_decoded(F.col("v")))) == want
    assert True in want and False in want


def test_precheck_is_implied_by_every_pattern(spark):
    samples = [
        "union select", "%20union%20select", "or 1=1", "%27or%271", "'or'1'='1", "--", "; drop table",
        "information_schema", "sleep(1)", "benchmark(", "xp_cmdshell", "%27", "select 1 from x", "waitfor delay",
        "concat(", "load_file(", "into outfile",
    ]
    for pattern, sample in zip(SQLI_PATTERNS, samples, strict=True):
        assert re.search(pattern, sample) and re.search(SQLI_PRECHECK, sample)
    df = _table(spark, samples)
    assert all(_run(df, text.sqli_match(F.col("v"), F.lower("v"))))


def test_prefixes(spark):
    paths = ["/api/v1/accounts", "/api/v1/accounts/7", "/api/v1/accountsx", "/api/users", "/api/users/", "/api/usersx/y",
             "/api", "", "/x/api/users", "/api/users/a/b/c"]
    want = [any(p == q or p.startswith(q + "/") for q in SENSITIVE_PREFIXES) for p in paths]
    assert _run(_table(spark, paths), text.has_prefix("v", SENSITIVE_PREFIXES)) == want
    assert _run(_table(spark, paths), text.has_prefix("v", ["/it's", "/x\\y", "/api/users"])) == [
        p == "/api/users" or p.startswith("/api/users/") for p in paths
    ]


def test_agents(spark):
    agents = ["sqlmap/1.7", "curl/8", "x curl/8", "CURL/8", "Python-Requests/2", "Mozilla/5.0", "my-Wget", "Go-http-client/1.1"]
    want = [any(re.search(p, a, re.IGNORECASE) for p in DEFAULT.bot_agent_patterns) for a in agents]
    assert _run(_table(spark, agents), text.is_bot_agent("v")) == want
    firefox = "Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0"
    assert _run(_table(spark, [firefox, firefox + " x", "x " + firefox]), text.is_tor_agent(F.col("v"))) == [True, False, False]


def test_ip_flags(spark):
    ips = ["10.0.0.5", "192.168.1.1", "172.16.5.4", "172.32.0.1", "127.0.0.1", "198.51.100.20", "203.0.113.45",
           "91.199.12.77", "not-an-ip", "::1", "010.0.0.5", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1::2::3",
           "fe80::1%eth0", "fe80::1%", "12345::", "::ffff:10.0.0.1", "1:2:3:4:5:6:1.2.3.4", "1.2.3.4%a", "", "10.0.0.5\n",
           "256.1.1.1", "1.2.3", ":1", "1:"]

    def valid(ip):
        try:
            return ipaddress.ip_address(ip)
        except ValueError:
            return None

    nets = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")]
    df = _table(spark, ips)
    assert _run(df, net.is_valid_ip(F.col("v"))) == [valid(i) is not None for i in ips]
    assert _run(df, net.is_internal_ip(F.col("v"))) == [valid(i) is not None and any(valid(i) in n for n in nets) for i in ips]
    v4 = [valid(i) if isinstance(valid(i), ipaddress.IPv4Address) else None for i in ips]
    assert _run(df, net.ipv4_number(F.col("v"))) == [None if a is None else int(a) for a in v4]


@pytest.mark.parametrize(("score", "level", "rank"), [(79, "LOW", 1), (80, "MEDIUM", 2), (199, "MEDIUM", 2),
                                                     (200, "HIGH", 3), (499, "HIGH", 3), (500, "CRITICAL", 4)])
def test_severity(spark, score, level, rank):
    df = _table(spark, [score], "bigint")
    assert _run(df, text.severity(F.col("v"))) == [level]
    assert _run(df, text.severity_rank(text.severity(F.col("v")))) == [rank]


def test_durations(spark):
    df = _table(spark, [0.0, 5.0, 59.9, 60.0, 3661.0, 8039.0, 90061.0, 86400.0, -3.0], "double")
    assert _run(df.where("v >= 0"), text.duration_hms("v")) == [
        "0s", "5s", "59s", "1m 0s", "1h 1m 1s", "2h 13m 59s", "25h 1m 1s", "24h 0m 0s"
    ]
    assert _run(df, text.duration_text("v")) == [
        "0 s", "5 s", "59 s", "1 m", "1 h 1 m", "2 h 13 m", "1 d 1 h 1 m", "1 d", "0 s"
    ]


def test_sizes_round_half_to_even(spark):
    sizes = [0, 1023, 1024, 1024 + 256, 1024 * 10 + 768, 1234567, 5 * 1024**3, 3 * 1024**4 + 1, None]
    assert _run(_table(spark, sizes, "bigint"), text.bytes_text("v")) == [
        "0 B", "1023 B", "1.0 KB", "1.2 KB", "10.8 KB", "1.2 MB", "5.00 GB", "3.00 TB", "0 B"
    ]


def test_first_ip_and_mitre(spark):
    assert _run(_table(spark, ["1.1.1.1, 2.2.2.2", "3.3.3.3"]), text.first_ip(F.col("v"))) == ["1.1.1.1", "3.3.3.3"]
    kinds = ["distributed_credential_stuffing", "sql_injection", "other"]
    assert _run(_table(spark, kinds), text.mitre_id(F.col("v"))) == ["T1110.004", "T1190", None]


def test_sqli_separators_and_own_patterns(spark):
    urls = [f"/a?q=union%{c}select" for c in ("1c", "1d", "1e", "1f", "20", "09")] + ["/etc/passwd", "/a"]
    df = _table(spark, urls)
    hit = lambda cfg: _run(df, text.sqli_match(F.col("v"), text.url_decoded(F.col("v")), cfg))
    assert hit(DEFAULT) == [True] * 6 + [False] * 2
    own = dataclasses.replace(DEFAULT, sqli_patterns=(*SQLI_PATTERNS, "etc/passwd"))
    assert hit(own) == [True] * 7 + [False]
    assert text.wide_blanks(r"a\s[\s,]\\s") == r"a[\s\x1c-\x1f][\s\x1c-\x1f,]\\s"
