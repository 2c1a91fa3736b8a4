from __future__ import annotations

import datetime as dt
import itertools
import json
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import START, login, row
from tracewarden import storage
from tracewarden.config import CAMPAIGN_SEQUENCES, DEFAULT
from tracewarden.operators.facts import lazy_facts, path_facts, stored_facts
from tracewarden.operators.profile import ip_profile
from tracewarden.plans import actions, analysis, baseline, chains, damage, explore, report, reputation
from tracewarden.sources import endpoints, lists, tables
from tracewarden.storage import Kept

SESSION = (
    "attack_type string, ip string, start_time timestamp, end_time timestamp, severity string, total_bytes bigint, "
    "ip_count bigint, detector_order int"
)


def _sessions(spark, rows):
    """(type, ip, start, end[, severity[, bytes]]) in seconds after the start."""
    full = []
    for kind, ip, start, end, *more in rows:
        level, size = (list(more) + ["LOW", 10][len(more):])[:2]
        full.append((kind, ip, START + dt.timedelta(seconds=start), START + dt.timedelta(seconds=end), level, size,
                     ip.count(",") + 1, list(DEFAULT.mitre_ids).index(kind)))
    df = spark.createDataFrame(full, SESSION)
    return df.withColumns({
        "duration_seconds": F.lit(1.0), "request_count": F.lit(3).cast("bigint"), "mitre_id": F.lit("T"),
        "is_internal": F.lit(False),
    })


@pytest.mark.parametrize(("gap", "linked"), [(0, True), (10_800, True), (10_801, False), (-1, False)])
def test_campaign_gap(spark, gap, linked):
    df = _sessions(spark, [("sql_injection", "a", 0, 100), ("data_exfiltration", "b", 100 + gap, 20_000)])
    assert chains.campaigns(df).count() == int(linked)


def test_campaigns_equal_the_greedy_search(spark):
    rng = random.Random(11)
    kinds = ["credential_stuffing", "sql_injection", "data_exfiltration", "admin_recon", "anonymizer"]
    rows = [(rng.choice(kinds), f"ip{i:02d}", s := rng.randrange(0, 90_000, 50), s + rng.randrange(0, 4_000, 50)) for i in range(60)]
    want = set()
    for seq in CAMPAIGN_SEQUENCES:
        for first in (r for r in rows if r[0] == seq[0]):
            path = [first]
            for kind in seq[1:]:
                after = sorted((r[2], r[1], r) for r in rows if r[0] == kind and 0 <= r[2] - path[-1][3] <= 10_800)
                if not after:
                    break
                path.append(after[0][2])
            else:
                want.add((" → ".join(r[1] for r in path), seq))
    got = {(c.ip, tuple(c.stage_types)) for c in chains.campaigns(_sessions(spark, rows)).collect()}
    assert got == want and len(want) > 20


def test_two_sessions_of_one_kind_on_one_address(spark):
    df = _sessions(spark, [("credential_stuffing", "a", 0, 100), ("credential_stuffing", "a", 200, 300),
                           ("sql_injection", "a", 400, 500), ("data_exfiltration", "a", 600, 700)])
    want = sum(1 for s in CAMPAIGN_SEQUENCES for _ in range(2 if s[0] == "credential_stuffing" else 1)
               if set(s) <= {"credential_stuffing", "sql_injection", "data_exfiltration"})
    assert chains.campaigns(df).count() == want > 0


def test_single_ip_chain(spark):
    rows = [("data_exfiltration", "a", 100, 900, "HIGH"), ("sql_injection", "a", 200, 300, "HIGH"),
            ("admin_recon", "a", 0, 50, "HIGH"), ("sql_injection", "b", 0, 1), ("sql_injection", "a, b", 0, 1)]
    (chain,) = chains.single_ip_chains(_sessions(spark, rows)).collect()
    assert chain.ip == "a" and chain.stage_types == ["admin_recon", "data_exfiltration", "sql_injection"]
    assert [s.stage for s in chain.steps] == ["admin_recon", "data_exfiltration", "sql_injection"]
    # the last-started session ends before another one does
    assert chain.total_duration == 300.0 and chain.critical_combo and chain.max_severity == "HIGH"
    assert (chain.total_requests, chain.total_bytes, chain.stages_count) == (9, 30, 3)


def test_chain_order_and_lookup(spark):
    rows = [("sql_injection", "a", 0, 1, "LOW"), ("admin_recon", "a", 0, 1, "LOW"), ("sql_injection", "b", 5, 6, "HIGH"),
            ("admin_recon", "b", 5, 6, "HIGH")]
    found = chains.attack_chains(_sessions(spark, rows))
    top = chains.by_importance(found).first()
    assert top.max_severity == "HIGH" and not top.critical_combo
    assert {c.ip for c in chains.chains_with_ip(found, "a").collect()} >= {"a"}


def test_damage_arithmetic(spark, requests_of):
    # published example: 99,843,681 bytes and 22,950 USD of fraud
    sessions = _sessions(spark, [("data_exfiltration", "x", 0, 1, "HIGH", 99_843_681), ("anonymizer", "a, b", 0, 1, "HIGH")])
    rows = [row(i, "x", "/api/transfer") for i in range(75)] + [row(i, "x", "/api/payment") for i in range(52)]
    rows += [row(i, "x", "/api/v1/transfer") for i in range(9)]
    rows += [row(0, "x", "/api/transfer", status=500), row(0, "y", "/api/transfer"), row(0, "a", "/api/transfer")]
    got = damage.damage(sessions, path_facts(requests_of(rows))).first()
    fraud = 75 * 250 + 52 * 80
    assert (got.estimated_records, got.dark_market_loss_usd, got.compliance_fine_usd) == (195_007, 975_035, 9_750_350)
    assert got.reputation_loss_usd == 21_450_770 and got.exfil_mb == 99.84 and got.suspicious_transfers == 136
    assert got.fraud_potential_usd == fraud and got.total_loss_usd == 32_176_155 + fraud
    assert got.total_loss_uzs == got.total_loss_usd * 12_650


def test_reputation_parts(requests_of):
    # published example: 35 + 90 + 96 + 80 + 25 + 1000 + 15 = 1341
    rows = [login(i * 61, status=401, agent="curl/8") for i in range(7)]
    rows += [row(1_000 + i * 97, url="/x?q=%27", agent="a1") for i in range(6)]
    rows += [row(2_000 + i * i, url="/api/users", size=1_050_000, agent="a2") for i in range(96)]
    rows += [row(9_000 + i * 13, url="/admin", agent="a3") for i in range(10)]
    profile = ip_profile(requests_of(rows))
    got = reputation.ip_reputation(profile).first()
    assert got.breakdown == {"failed_login": 35, "sqli_payload": 90, "sensitive_api_200": 96, "admin_endpoint_hit": 80,
                             "bot_user_agent": 25, "per_mb_api_traffic": 1000, "ua_rotation": 15}
    assert (got.score, got.severity) == (1341, "CRITICAL")
    texts = {r.signal: r.text for r in reputation.score_reasons(profile).collect()}
    assert texts["failed_login"] == "7 failed logins (+5 each)"
    assert texts["per_mb_api_traffic"] == "100 MB sensitive API traffic (+10 per MB)"
    assert texts["ua_rotation"] == "Frequently rotates User-Agent (4 variants) +15"
    assert texts["bot_user_agent"].endswith("python-requests) +25") and len(texts) == 7


@pytest.fixture
def result(spark, requests_of):
    rows = [login(i * 20, "9.9.9.9", agent="python-requests/2") for i in range(40)]
    rows += [row(4_000 + i * 5, "9.9.9.9", "/api/export?a", size=400_000, agent="curl/8") for i in range(40)]
    rows += [row(i * i * 9, "7.7.7.7", "/dashboard") for i in range(25)] + [row(i * i * 9, "8.8.8.8", "/dashboard") for i in range(25)]
    dims = analysis.Dims(
        tor=lists.tor_exits(spark.createDataFrame([("# x",), ("9.9.9.9 ",)], "value string")),
        proxies=lists.proxies(spark.createDataFrame([("7.7.7.7:80",), ("9.9.9.9:81",), ("",)], "value string")),
        countries=spark.createDataFrame([(9 << 24, (10 << 24) - 1, "Nine")], "ip_from bigint, ip_to bigint, country string"),
    )
    return analysis.analyze(requests_of(rows), dims)


def test_analysis_and_report(spark, result, tmp_path):
    sessions = {s.attack_type: s for s in result.sessions.collect()}
    assert set(sessions) == {"credential_stuffing", "data_exfiltration", "anonymizer", "distributed_fingerprint"}
    stuffing = sessions["credential_stuffing"]
    assert stuffing.via_tor and not stuffing.via_proxy and stuffing.country == "Nine" and stuffing.severity == "HIGH"
    joint = sessions["distributed_fingerprint"]
    assert (joint.ip, joint.ip_count) == ("7.7.7.7", 2) and joint.via_proxy and joint.severity == "LOW"
    types = {c.chain_type for c in result.chains.collect()}
    assert types == {"single_ip", "multi_ip_campaign"}

    paths = report.write_report(result, str(tmp_path / "out"))
    table = spark.read.csv(paths["attacks_csv"], header=True)
    assert len(table.columns) == 17 and table.count() == 4
    stored = [json.loads(r.value) for r in spark.read.text(paths["attacks_json"]).collect()]
    assert {s["attack_type"] for s in stored} == set(sessions) and stored[0]["score"] >= stored[-1]["score"]
    text = [r.value for r in spark.read.text(paths["narrative_text"]).coalesce(1).collect()]
    assert "  ATTACK CHAIN" in text and any("[TOR]" in line and "[Nine]" in line for line in text)
    assert sum(line.startswith("  -> ") for line in text) == 4
    assert spark.read.json(paths["economic_damage_json"]).first().exfil_bytes == 16_000_000
    assert spark.read.parquet(paths["members"]).count() == 2

    kept = explore.filter_sessions(result.sessions, attack_types=["credential_stuffing"], anonymizer=True)
    assert {s.attack_type for s in kept.collect()} == {"credential_stuffing", "anonymizer"}
    assert explore.filter_sessions(result.sessions, duration="short").count() == 1
    with pytest.raises(ValueError):
        explore.filter_sessions(result.sessions, duration="medium")
    shared = explore.sessions_with_ip(result.sessions, result.members, "8.8.8.8").collect()
    assert [s.attack_type for s in shared] == ["distributed_fingerprint"]
    agreement = {r.ip: r.layers for r in explore.layer_agreement(result.sessions, result.members).collect()}
    assert agreement == {"9.9.9.9": 2, "7.7.7.7": 1, "8.8.8.8": 1}
    shown = {r.attack_type: r for r in explore.attack_table(result.sessions, result.evidence_counts).collect()}
    assert shown["data_exfiltration"].endpoints == "/api/export (40)"
    assert shown["data_exfiltration"].payload == "/api/export?a" and shown["credential_stuffing"].payload == ""
    detail = explore.ip_detail(result, spark.createDataFrame([("8.8.8.8",), ("9.9.9.9",)], "ip string"))
    counted = {name: df.count() for name, df in detail.items()}
    assert counted["totals"] == 2 and counted["sessions"] == 4 and counted["chain"] == 1 and counted["statuses"] == 3
    assert {r.ip: r.mitre_ids for r in detail["mitre"].collect()}["8.8.8.8"] == ["T1583.003"]


def test_baseline(result):
    rows = {r.cohort: r for r in result.baseline.collect()}
    assert (rows["attacker"].unique_ips, rows["normal"].unique_ips) == (1, 2)
    assert rows["normal"].avg_bytes_per_ip == 2_500.0
    beside = {r.ip: r for r in baseline.ip_vs_normal(result.profile, result.requests, result.cohorts).collect()}
    assert beside["9.9.9.9"].top_endpoint == "/api/export" and beside["9.9.9.9"].normal_top_endpoint == "/dashboard"
    peaks = [r for r in baseline.peak_hours(result.requests, result.cohorts).collect() if r.cohort == "normal"]
    assert [r.rank for r in peaks] == list(range(1, len(peaks) + 1))


def test_actions(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    log = spark.createDataFrame(
        [("a", "block", "", at(0)), ("a", "ignore", "n", at(5)), ("b", "block", "", at(0)), ("b", "clear", "", at(1)),
         ("c", "block", "", at(1)), ("c", "nonsense", "", at(9))],
        "ip string, action string, note string, set_at timestamp",
    )
    assert {(r.ip, r.action) for r in actions.current_actions(log).collect()} == {("a", "ignore"), ("c", "block")}
    ips = spark.createDataFrame([("a",), ("b",), ("c",)], "ip string")
    assert [r.ip for r in actions.ips_with_action(ips, log, "block").collect()] == ["c"]
    path = str(tmp_path / "actions")
    actions.append_actions(actions.action_rows(spark, [("z", "watchlist", "why")]), path)
    actions.append_actions(actions.action_rows(spark, [("z", "block", "")]), path)
    assert actions.current_actions(spark.read.parquet(path)).first().action == "block"
    with pytest.raises(ValueError):
        actions.action_rows(spark, [("z", "shrug", "")])


def test_endpoint_changes(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    changes = spark.createDataFrame(
        [("transaction", " /pay ", "add", at(0)), ("transaction", "pay", "add", at(0)), ("transaction", "/api/payment", "add", at(0)),
         ("transaction", "/api/payment", "remove", at(1)), ("other", "/x", "add", at(0)), ("login_paths", "/in", "add", at(0)),
         ("login_paths", "/in", "remove", at(1))],
        "category string, path string, change string, set_at timestamp",
    )
    defaults = endpoints.default_endpoints(spark)
    custom = endpoints.custom_from_changes(changes, defaults)
    assert [(r.category, r.path) for r in custom.collect()] == [("transaction", "/pay")]
    merged = endpoints.merged_endpoints(defaults, custom)
    assert merged.count() == defaults.count() + 1
    assert merged.where("category = 'transaction' AND path = '/api/payment'").first().origin == "default"
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"transaction": ["/pay"], "login_paths": ["/in", "/in2"]}, indent=1))
    bad.write_text("{nonsense")
    assert endpoints.read_custom_endpoints(spark, str(good)).count() == 3
    assert endpoints.read_custom_endpoints(spark, str(bad)).count() == 0
    assert endpoints.read_custom_endpoints(spark, str(tmp_path / "none.json")).count() == 0


def test_lists_and_tables(spark, tmp_path, requests_of):
    (tmp_path / "p1.txt").write_text("1.1.1.1:80\n# c\n\n2.2.2.2:1\n")
    (tmp_path / "p2.txt").write_text("1.1.1.1:81\n :9\n")
    got = lists.read_proxies(spark, [str(tmp_path / f) for f in ("p1.txt", "gone.txt", "p2.txt")])
    assert sorted(r.ip for r in got.collect()) == ["1.1.1.1", "2.2.2.2"]
    assert lists.read_tor_exits(spark, str(tmp_path / "gone.txt")).count() == 0
    path = str(tmp_path / "requests")
    tables.store_requests(requests_of([row(0), row(86_400), row(2 * 86_400)]), path)
    day = tables.load_requests(spark, path, "2026-04-02", "2026-04-02")
    assert day.count() == 1 and "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().toString()


def test_ties_and_text_columns(spark):
    rows = [("sql_injection", "b", 0, 1), ("sql_injection", "a", 0, 1), ("admin_recon", "c", 0, 1)]
    df = _sessions(spark, rows).withColumn("score", F.lit(5))
    assert [s.ip for s in explore.by_score(df).collect()] == ["c", "a", "b"]
    assert [s.ip for s in explore.top_sessions(df, 2).collect()] == ["c", "a"]
    assert list(itertools.chain(*chains.single_ip_chains(df).collect())) == []


def _request_scans(plan):
    return len(re.findall(r"Relation \[[^\]]*\burl_decoded", plan))


def test_an_analysis_reads_requests_eight_times_at_most(spark, requests_of, tmp_path, monkeypatch):
    """Every stored table's plan and those of the lazy tables, by their scans of the request table."""
    rows = [login(i * 20, "9.9.9.9") for i in range(40)] + [row(i, "8.8.8.8", "/admin", agent=f"a{i % 5}") for i in range(40)]
    rows += [row(i, "7.7.7.7", "/api/export", size=9_000_000) for i in range(40)] + [row(9, "7.7.7.7", "/api/transfer")]
    tables.store_requests(requests_of(rows), f"{tmp_path}/requests")
    requests, plans = tables.load_requests(spark, f"{tmp_path}/requests"), []

    def plan_of(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    plain = type(requests).write
    monkeypatch.setattr(type(requests), "write", property(lambda df: plans.append(plan_of(df)) or plain.fget(df)))
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path / "shared"))
    result = analysis.analyze(requests)
    lazy = (result.members, result.evidence_counts, result.damage, result.reasons, result.reputation, result.chains, result.baseline)
    assert 6 <= sum(map(_request_scans, plans + [plan_of(df) for df in lazy])) <= 8
    found = {r.attack_type for r in result.sessions.collect()}
    assert {"credential_stuffing", "data_exfiltration", "admin_recon", "anonymizer"} <= found
    # what is bucketed by address is grouped and joined by it without a shuffle
    facts = result.facts
    for df in (facts.paths.groupBy("ip").count(), facts.profile().join(facts.paths.groupBy("ip").count(), "ip"), explore.top_paths_per_ip(facts.paths)):
        df.collect()
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    before = result.profile.count()
    assert before == 3
    result.close()
    assert not list((tmp_path / "shared" / "tracewarden").glob("*")) and "tracewarden_" not in str(spark.catalog.listTables())


def test_lazy_and_stored_facts_agree(spark, requests_of):
    rows = [login(i * 7, f"9.9.9.{i % 3}", agent=f"a{i % 4}") for i in range(60)]
    rows += [row(i * 3, f"9.9.9.{i % 3}", url) for i, url in enumerate(["/admin", "/api/export", "/a?q=1%27%20OR%201=1--", "/"] * 15)]
    requests = requests_of(rows)
    lazy, kept = lazy_facts(requests), Kept()
    stored = stored_facts(requests, kept=kept)
    for name in ("agents", "paths", "slices", "samples", "agent_order", "clients"):
        got, want = (sorted(map(str, getattr(f, name).select(*getattr(lazy, name).columns).collect())) for f in (stored, lazy))
        assert got == want and got, name
    want = {r.ip: r for r in ip_profile(requests).collect()}
    columns = ip_profile(requests).columns
    assert {r.ip: r for r in stored.profile().select(*columns).collect()} == want
    kept.close()


def _scanned_rows(df):
    """Rows that the scans of a collected plan gave away."""
    df.collect()
    leaves, rows = df._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        plan = leaves.apply(i)
        plan = plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan
        rows += plan.metrics().apply("numOutputRows").value() if plan.metrics().contains("numOutputRows") else 0
    return rows


def test_look_ups_skip_row_groups(spark, requests_of, tmp_path):
    rows = [row(i * 10, f"10.{i % 40}.{i % 7}.9") for i in range(4000)]
    tables.store_requests(requests_of(rows), f"{tmp_path}/r", row_group_bytes=4096)
    stored = tables.load_requests(spark, f"{tmp_path}/r")
    files = [pq.ParquetFile(f) for f in (tmp_path / "r").rglob("*.parquet")]
    groups = [f.metadata.row_group(g) for f in files for g in range(f.metadata.num_row_groups)]
    ip = [f.metadata.schema.names.index("ip") for f in files][0]
    holding = [g for g in groups if g.column(ip).statistics.min <= "10.3.3.9" <= g.column(ip).statistics.max]
    assert len(groups) > 5 * len(holding) and any(g.column(ip).to_dict().get("bloom_filter_offset", 1) for g in groups)
    assert stored.count() == 4000 and len({r.ip for r in stored.select("ip").distinct().collect()}) == 280
    for ips in (["10.3.3.9"], ["10.3.3.9", "10.20.6.9"], ["203.0.113.1"], []):
        found = tables.of_addresses(stored, ips)
        want = sum(r[1] in ips for r in rows)
        assert found.count() == want == tables.of_addresses(stored, spark.createDataFrame([(i,) for i in ips], "ip string")).count()
        assert _scanned_rows(found.select("ip", "lineno")) <= 4000 / 5


def test_files_of_days_are_few_and_bounded(spark, requests_of, tmp_path):
    """One huge day and many tiny ones."""
    day, huge = 86_400, 12_000
    rows = [row(i, f"10.0.{i % 97}.{i % 13}", f"/path/{i * 7919 % 100_003}") for i in range(huge)]
    rows += [row((d + 1) * day + i, f"10.0.0.{i}") for d in range(20) for i in range(3)]
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "128k")
    try:
        tables.store_requests(requests_of(rows).repartition(8), f"{tmp_path}/r")
    finally:
        spark.conf.unset(size)
    files = {d.name: [f.stat().st_size for f in d.glob("*.parquet")] for d in (tmp_path / "r").glob("day=*")}
    sizes = sorted(files.values(), key=len)
    assert len(files) == 21 and max(len(s) for s in sizes[:-1]) <= 3 and 2 <= len(sizes[-1]) <= 40
    assert max(sizes[-1]) < sum(sizes[-1]) / 2 and max(max(s) for s in sizes[:-1]) < 100_000  # a filter takes some 70 KB
    tables.store_requests(requests_of(rows[-3:]), f"{tmp_path}/r", mode="overwrite")  # the last day alone
    assert tables.load_requests(spark, f"{tmp_path}/r").count() == len(rows)
