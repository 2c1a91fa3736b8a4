from __future__ import annotations

import ipaddress
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.conftest import row
from tracewarden.config import DEFAULT
from tracewarden.operators import dims
from tracewarden.operators.dims import countries, network_flags, overlapping_ranges
from tracewarden.operators.nearest import next_point
from tracewarden.operators.profile import interval_cv, ip_profile
from tracewarden.operators.ranking import first_distinct, first_values, ranked, top_counts
from tracewarden.operators.trailing import trailing_hits


def _trailing(df, seconds, slice_seconds, least_a, least_b):
    both = lambda t: (t["a"] >= least_a) & (t["b"] >= least_b)
    hits = trailing_hits(
        df, "k", {"a": F.col("a"), "b": F.col("b")}, seconds, slice_seconds,
        hit=both, surely=lambda low, high: both(low), possibly=lambda low, high: both(high),
    )
    return {r.k for r in hits.collect()}


def _brute(rows, seconds, least_a, least_b):
    found = set()
    for k, t, _, _ in rows:
        window = [(a, b) for k2, t2, a, b in rows if k2 == k and t - seconds < t2 <= t]
        if sum(a for a, _ in window) >= least_a and sum(b for _, b in window) >= least_b:
            found.add(k)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_trailing_window_is_exact(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(40)}", rng.randrange(0, 2400) / 4, rng.randrange(3), 1) for _ in range(900)]
    rows += [("hot", rng.randrange(0, 1200) / 4, 0, 1) for _ in range(300)]  # never enough of a
    df = spark.createDataFrame(rows, "k string, t double, a bigint, b bigint").select(
        "k", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")).alias("timestamp"), "a", "b"
    )
    sizes = set()
    for least_a, least_b in [(4, 3), (6, 5), (9, 7), (1, 12)]:
        want = _brute(rows, 60, least_a, least_b)
        sizes.add(len(want))
        assert _trailing(df, 60, 10, least_a, least_b) == want
    assert len(sizes) > 1


def test_trailing_window_is_open_on_the_left(spark):
    times = [("in", 0), ("in", 10_799), ("edge", 0), ("edge", 10_800), ("same", 5), ("same", 5)]
    df = spark.createDataFrame(times, "k string, s bigint").select(
        "k", F.timestamp_seconds("s").alias("timestamp"), F.lit(1).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b")
    )
    assert _trailing(df, 10_800, 60, 2, 2) == {"in", "same"}


def test_trailing_window_needs_whole_slices(spark):
    with pytest.raises(ValueError):
        _trailing(spark.createDataFrame([], "k string, timestamp timestamp, a bigint, b bigint"), 100, 60, 1, 1)


def test_interval_cv(requests_of):
    rng = random.Random(3)
    times = {
        "four": [0, 1, 2, 3], "same": [5] * 6, "even": [i * 200 for i in range(30)], "twice": [0, 0, 7, 14, 21],
        "random": sorted(rng.random() * 5_000 for _ in range(200)), "near": [i * 7 + (i % 5) for i in range(50)],
    }
    got = {r.ip: r.interval_cv for r in interval_cv(requests_of([row(t, ip) for ip, ts in times.items() for t in ts])).collect()}
    assert got["four"] is None and got["same"] is None and got["even"] == 0.0
    for ip in ("twice", "random", "near"):
        ts = [round(t * 1e6) for t in sorted(times[ip])]
        gaps = [b - a for a, b in zip(ts, ts[1:])]
        assert got[ip] == pytest.approx(statistics.stdev(gaps) / statistics.mean(gaps), rel=1e-9)


def test_profile(requests_of):
    rows = [row(0, agent="b"), row(60, agent="a", size=50), row(120, agent="a"), row(180, agent="b"), row(1, "10.0.0.1")]
    got = {r.ip: r for r in ip_profile(requests_of(rows)).collect()}
    one = got["1.2.3.4"]
    assert (one.total_requests, one.unique_user_agents, one.dominant_user_agent) == (4, 2, "a")
    assert (one.total_bytes, one.min_bytes, one.max_bytes, one.span_seconds) == (350, 50, 100, 180.0)
    assert one.request_rate == pytest.approx(4 / 3)
    assert got["10.0.0.1"].is_internal and got["10.0.0.1"].request_rate == 0.0


def test_local_hours(requests_of):
    # 09:00 UTC is 14:00 at +5; 02:00 UTC is 07:00; 01:59:59 is 06:59:59; 17:00 is 22:00; 16:59:59 is 21:59:59
    rows = [row(0), row(-7 * 3600), row(-7 * 3600 - 1), row(8 * 3600), row(8 * 3600 - 1)]
    got = requests_of(rows).orderBy("lineno").select("hour_local", "is_off_hours").collect()
    assert [tuple(r) for r in got] == [(14, False), (7, False), (6, True), (22, True), (21, False)]


def test_listings(spark, requests_of):
    rows = [row(5, url="/b"), row(1, url="/c", agent="z"), row(2, url="/b", agent="y"), row(3, url="/a", agent="z"), row(4, url="/a")]
    df = requests_of(rows)
    assert list(top_counts(df, ["ip"], "url_path", 2, "m").first().m.items()) == [("/a", 2), ("/b", 2)]
    assert first_values(df, ["ip"], "url_path", 3, "v").first().v == ["/c", "/b", "/a"]
    assert first_distinct(df, ["ip"], "user_agent", 2, "v").first().v == ["z", "y"]


def test_ranking_is_cut_before_the_shuffle(spark, requests_of):
    from tracewarden.plans.explore import top_paths_per_ip

    plan = top_paths_per_ip(requests_of([row(0)]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_long_listings_are_exact(spark):
    rows = [("g", f"v{i:05d}", (i * 7919) % 5_000) for i in range(4_000)] + [("h", "x", 1)]
    df = spark.createDataFrame(rows, "g string, v string, o int")
    got = ranked(df, ["g"], [F.asc("o"), F.asc("v")], 1_500).collect()
    want = sorted((r for r in rows if r[0] == "g"), key=lambda r: (r[2], r[1]))[:1_500]
    assert sorted((r.rank, r.v) for r in got if r.g == "g") == [(i + 1, r[1]) for i, r in enumerate(want)]
    assert [(r.rank, r.v) for r in got if r.g == "h"] == [(1, "x")]


def test_next_point_is_the_earliest_at_or_after(spark):
    rng = random.Random(5)
    probes = {(rng.choice("xy"), rng.randrange(2_000)) for _ in range(300)}
    points = {(rng.choice("xy"), rng.randrange(0, 2_000, 7)) for _ in range(60)}
    got = next_point(
        spark.createDataFrame(sorted(probes), "g string, at bigint"),
        spark.createDataFrame([(g, t, f"{g}{t}") for g, t in sorted(points)], "g string, at bigint, payload string"),
        "g", 40, 16,
    )
    want = {}
    for g, at in probes:
        after = [t for g2, t in points if g2 == g and 0 <= t - at <= 40]
        if after:
            want[(g, at)] = f"{g}{min(after)}"
    assert {(r.g, r.at): r.payload for r in got.collect()} == want


def test_countries_and_flags(spark):
    ranges = spark.createDataFrame([(0x01020000, 0x0103FFFF, "A"), (0x01040010, 0x01040010, "B"), (0x05000000, 0x06FFFFFF, "C")],
                                   "ip_from bigint, ip_to bigint, country string")
    ips = ["1.2.0.0", "1.3.255.255", "1.4.0.0", "1.4.0.16", "1.4.0.17", "6.200.1.1", "::1", "x", "1.2.0.0"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r.ip: r.country for r in countries(df, ranges).collect()}
    assert got == {"1.2.0.0": "A", "1.3.255.255": "A", "1.4.0.0": "Unknown", "1.4.0.16": "B", "1.4.0.17": "Unknown",
                   "6.200.1.1": "C", "::1": "Unknown", "x": "Unknown"}
    assert overlapping_ranges(ranges).count() == 0
    twice = ranges.union(spark.createDataFrame([(0x01030000, 0x01030001, "D")], ranges.schema))
    assert overlapping_ranges(twice).first().country == "D"
    both = spark.createDataFrame([("1.2.0.0",), ("x",)], "ip string")
    flags = {r.ip: (r.via_tor, r.via_proxy) for r in network_flags(df.distinct(), both.limit(1), both).collect()}
    assert flags["1.2.0.0"] == (True, False) and flags["x"] == (False, True) and flags["::1"] == (False, False)


def test_ipv6_countries(spark):
    networks = [("2001:db8::/32", "A"), ("2001:db8:1::/48", "B"), ("::/3", "C"), ("fe80::/10", "D"), ("2001:db8:1:2:8000::/67", "E")]
    ips = ["2001:db8::1", "2001:DB8:1::7", "2001:db8:1:2:3::9", "fe80::1%eth0", "::ffff:1.2.3.4", "ff00::1", "4000::", "::1", "::",
           "1:2:3:4:5:6:7:8", "1.2.3.4", "x", "2001:db8:1:2:9000::5"]
    want = {}
    for ip in ips:
        try:
            address = ipaddress.IPv6Address(ip.partition("%")[0])
        except ValueError:
            continue
        held = [(ipaddress.IPv6Network(n), c) for n, c in networks if address in ipaddress.IPv6Network(n)]
        want[ip] = max(held, key=lambda h: h[0].prefixlen)[1] if held else "Unknown"
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    v4 = spark.createDataFrame([(0x01000000, 0x01FFFFFF, "V4")], "ip_from bigint, ip_to bigint, country string")
    table = spark.createDataFrame(networks, "network string, country string")
    got = {r.ip: r.country for r in countries(df, v4, table).collect()}
    assert got == {**want, "1.2.3.4": "V4", "x": "Unknown"}
    assert set(r.country for r in countries(df, v4, table.limit(0)).collect()) == {"V4", "Unknown"}


def test_endpoint_tables_of_any_size_are_joined(spark, requests_of, tmp_path):
    from tracewarden.operators import enrich as module

    rows = [row(0, url=u, method=m) for u in ("/api/users/1?x", "/admin", "/adminx", "/login", "/login/x", "/c/1/d", "//", "/", "/n/1999/x")
            for m in ("GET", "POST")]
    extra = {"exfil_targets": ["/c/1"], "admin_endpoints": [f"/n/{i}" for i in range(2500)]}
    paths = {c: [*ps, *extra.get(c, [])] for c, ps in module.ENDPOINT_CATEGORIES.items()}
    table = spark.createDataFrame([(c, p) for c, ps in paths.items() for p in ps], "category string, path string")
    columns = ("lineno", "timestamp", "ip", "method", "url_full", "status", "bytes", "user_agent")
    raw = requests_of(rows).select(*columns)
    raw = raw.unionByName(raw.limit(1).withColumns({"lineno": F.lit(99).cast("bigint"), "url_full": F.lit(None).cast("string")}))
    joined = module.enrich(raw, table).orderBy("lineno").collect()
    assert joined == module.enrich(raw, paths).orderBy("lineno").collect()
    assert sum(r.is_exfil_target for r in joined) == 4 and sum(r.is_login for r in joined) == 1
    assert sum(r.is_admin for r in joined) == 4 and not joined[-1].is_admin
    raw.write.parquet(f"{tmp_path}/raw")
    stream = module.enrich(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/raw"), table)
    query = stream.writeStream.format("memory").queryName("joined_endpoints").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("joined_endpoints").orderBy("lineno").collect() == joined


def test_defaults_are_the_stated_rules():
    assert (DEFAULT.burst_seconds, DEFAULT.burst_logins, DEFAULT.burst_failure_ratio) == (10_800, 15, 0.5)
    assert (DEFAULT.medium_score, DEFAULT.high_score, DEFAULT.critical_score) == (80, 200, 500)


def _bounds(network):
    if "-" in network:
        return tuple(_key(a) for a in network.split("-"))
    net = ipaddress.ip_network(network, strict=False)
    return _key(net[0]), _key(net[-1])


def _key(ip):
    ip = ipaddress.ip_address(ip)
    return int(ip) + (1 << 130) * (ip.version == 6)  # the kinds apart


@pytest.mark.parametrize("parts", ["1", "7"])
def test_the_innermost_network_counts(spark, parts):
    """Nested and overlapping networks of both kinds, against a plain search."""
    rng = random.Random(11)
    networks = ["0.0.0.0/0", "::/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.0.0/16", "10.1.2.0-10.1.9.255", "10.1.5.0-10.1.20.0", "2001:db8::/32"]
    networks += ["2001:db8:1::/48", "2001:db8::5-2001:db8:1::9", "10.1.2.3", "255.255.255.255", "2001:db8::ffff"]
    networks += [f"10.{rng.randint(0, 3)}.{rng.randint(0, 255)}.0/{rng.randint(9, 30)}" for _ in range(60)]
    named = [(n, f"c{i}") for i, n in enumerate(networks)]
    ips = [f"10.{rng.randint(0, 4)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}" for _ in range(300)] + ["10.1.2.3", "9.9.9.9", "255.255.255.255", "0.0.0.0"]
    ips += [f"2001:db8:{rng.randint(0, 2):x}::{rng.randint(0, 12):x}" for _ in range(60)] + ["::", "ffff::1", "::ffff:10.1.2.3", "unknown", "10.1.2", None]
    junk = [("10.0.0.0/33", "x"), ("nothing", "x"), ("10.0.0.9-10.0.0.1", "x"), ("10.0.0.9-::1", "x"), ("::/x", "x"), ("1.2.3.4/8/9", "x"), (None, "x"), ("", "x")]
    table = spark.createDataFrame(named + junk, "network string, country string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = dims.innermost(spark.createDataFrame([(i,) for i in ips], "ip string").distinct(), dims.network_bounds(table))
        got = {r.ip: r.country for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(str, (r.network for r in dims.unreadable_networks(table).collect()))) == sorted(str(n) for n, _ in junk)

    def plain(ip):
        try:
            key = _key(ip)
        except ValueError:
            return None
        held = [(-low, high, c) for n, c in named for low, high in [_bounds(n)] if low <= key <= high]
        return min(held)[2] if held else None

    assert got == {ip: plain(ip) for ip in ips if ip is not None} | {None: None}


def test_countries_by_ranges_and_networks(spark):
    ranges = spark.createDataFrame([(16909056, 16909311, "A")], "ip_from bigint, ip_to bigint, country string")  # 1.2.3.0/24
    networks = spark.createDataFrame([("1.2.0.0/16", "B"), ("2001:db8::/32", "C")], "network string, country string")
    ips = spark.createDataFrame([("1.2.3.4",), ("1.2.4.4",), ("2001:db8::1",), ("8.8.8.8",), ("x",), ("1.2.3.4",)], "ip string")
    got = {r.ip: r.country for r in dims.countries(ips, ranges, networks).collect()}
    assert got == {"1.2.3.4": "A", "1.2.4.4": "B", "2001:db8::1": "C", "8.8.8.8": "Unknown", "x": "Unknown"}
    assert dims.countries(ips, ranges.limit(0), networks.limit(0)).where("country <> 'Unknown'").isEmpty()
