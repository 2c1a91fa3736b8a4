from __future__ import annotations

import dataclasses
import json

import pytest

from tests.conftest import ANDROID, login, row
from tracewarden.config import DEFAULT
from tracewarden.operators.detectors import DETECTORS, detect_all, evidence_counts, session_members, stored_findings
from tracewarden.operators.profile import ip_profile

FIREFOX = "Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0"


@pytest.fixture
def found(requests_of):
    """Sessions of one detector by their address text."""

    def run(name, rows, cfg=DEFAULT):
        requests = requests_of(rows)
        return {s.ip: s for s in DETECTORS[name](requests, ip_profile(requests, cfg), cfg).collect()}

    return run


def test_credential_stuffing_layers(found):
    every = 3 * 3600 + 1  # never two logins within three hours
    rows = [login(i * 60, "burst") for i in range(15)]
    rows += [login(i * 60, "fourteen") for i in range(14)]
    rows += [login(i * 60, "half", 401 if i < 8 else 200) for i in range(16)]
    rows += [login(i * 60, "less", 401 if i < 7 else 200) for i in range(15)]
    rows += [login(i * every, "session", 401 if i < 9 else 200) for i in range(30)]
    rows += [login(i * every, "short", 401) for i in range(29)]
    rows += [login(i * every, "slow", 401 if i < 8 else 200) for i in range(50)]
    rows += [login(i * every, "calm", 401 if i < 7 else 200) for i in range(50)]
    got = found("credential_stuffing", rows)
    assert {ip: s.layer for ip, s in got.items()} == {
        "burst": "L1_burst", "half": "L1_burst", "session": "L2_session", "slow": "L3_long_term"
    }
    half = got["half"]
    assert (half.request_count, half.evidence.failed_logins, half.evidence.successful_logins) == (16, 8, 8)
    assert half.evidence.failure_ratio == 0.5 and half.mitre_id == "T1110.004" and not half.evidence.bot_ua_used


def test_distributed_login_limits(found):
    def at(bucket, ips):
        return [login(bucket * 300 + i, ip) for i, ip in enumerate(ips)]

    rows = at(0, ["1.1.1.1"] * 15)  # one address only
    rows += at(1, ["1.1.1.1"] * 14 + ["2.2.2.2"])  # two addresses, fifteen failures
    rows += at(2, ["5.5.5.5", "2.2.2.2", "3.3.3.3", "4.4.4.4"])  # four addresses
    rows += at(3, ["1.1.1.1"] * 12 + ["2.2.2.2", "3.3.3.3"])  # three addresses, fourteen failures
    rows += at(4, ["10.0.0.1", "10.0.0.2", "1.1.1.1", "2.2.2.2"])  # internal ones do not count
    got = found("distributed_credential_stuffing", rows)
    assert {ip: s.ip_count for ip, s in got.items()} == {"1.1.1.1": 2, "2.2.2.2": 4}
    four = got["2.2.2.2"]
    assert (four.ip_count, four.request_count, four.duration_seconds) == (4, 4, 300.0)
    assert four.coordinated and four.shared_user_agent == ANDROID and four.ip_rotation_detected
    assert four.start_time.minute == 10 and not four.is_internal


def test_members_are_rows_in_the_order_they_show_up(found, requests_of):
    ips = ["9.9.9.9", "3.3.3.3", "5.5.5.5", "1.1.1.1"]
    rows = [login(i, ip, agent=f"agent {i}") for i, ip in enumerate(ips)]
    (session,) = found("distributed_credential_stuffing", rows).values()
    assert (session.ip, session.ip_count) == ("1.1.1.1", 4)
    assert not session.coordinated and session.shared_user_agent is None
    requests = requests_of(rows)
    members = session_members(requests, ip_profile(requests)).orderBy("seen").collect()
    assert [m.ip for m in members] == ips and {m.session_key for m in members} == {session.session_key}


def test_sql_injection(found):
    hit = "/api/search?q=1%27"
    rows = [row(i * 100, "a", f"{hit}&n={i}", status=200 if i % 2 else 500, agent=f"u{i}") for i in range(6)]
    rows += [row(0, "b", "/x?q=1%27", agent="SQLMap/1"), row(600, "b", "/y?q=1%27"), row(0, "c", "/clean?q=1")]
    got = found("sql_injection", rows)
    assert {ip: s.layer for ip, s in got.items()} == {"a": "L1_burst", "b": "L3_long_term"}
    a = got["a"].evidence
    assert (a.payload_count, a.successful_responses, a.uses_sqlmap) == (6, 3, False)
    assert a.sample_payloads == [f"q=1%27&n={i}" for i in range(5)] and a.user_agents == [f"u{i}" for i in range(5)]
    assert got["b"].evidence.uses_sqlmap


def test_data_exfiltration_layers(found):
    every, url = 3 * 3600 + 1, "/api/export/all"
    rows = [row(i, "burst", url, size=200_000) for i in range(30)]
    rows += [row(i, "few", url, size=200_000) for i in range(29)]
    rows += [row(i * every, "session", url, size=100_000) for i in range(100)]
    rows += [row(i * every, "less", url, size=101_000) for i in range(99)]
    rows += [row(i * every, "heavy", url, size=10_000_000) for i in range(3)]
    rows += [row(i, "failed", url, status=403, size=10_000_000) for i in range(50)]
    got = found("data_exfiltration", rows)
    assert {ip: s.layer for ip, s in got.items()} == {"burst": "L1_burst", "session": "L2_session", "heavy": "L3_long_term"}
    e = got["heavy"].evidence
    assert (e.estimated_records, e.avg_response_bytes, e.max_single_response_bytes) == (58_593, 10_000_000, 10_000_000)


def test_anonymizer_limits(found):
    def irregular(ip, n, agents):
        return [row(i * i * 7 + i % 3, ip, agent=agents[i % len(agents)]) for i in range(n)]

    rows = irregular("bots", 30, ["curl/8"] + [ANDROID] * 4) + irregular("few bots", 29, ["curl/8"])
    rows += irregular("under", 51, ["curl/8"] + [ANDROID] * 5) + irregular("three", 30, ["a", "b", "c"])
    rows += irregular("four", 30, ["a", "b", "c", "d"]) + irregular("tor", 30, [FIREFOX])
    rows += [row(i * 10, "rhythm") for i in range(30)]
    got = found("anonymizer", rows)
    assert {ip: s.evidence.signals for ip, s in got.items()} == {
        "bots": ["bot_ua_ratio=20%(6)"], "four": ["ua_rotation(4)"], "tor": ["tor_ua(30)"],
        "rhythm": ["regular_interval(CV=0.00)"],
    }
    assert got["rhythm"].evidence.interval_cv is None and got["bots"].evidence.interval_cv > 0.3
    assert got["bots"].evidence.user_agents == {ANDROID: 24, "curl/8": 6}


def test_admin_recon_limits(found):
    rows = [row(i, "five", "/admin/x") for i in range(5)] + [row(i, "four", "/admin") for i in range(4)]
    rows += [row(0, "deep", "/internal/audit/7", status=302)]
    got = found("admin_recon", rows)
    assert set(got) == {"five", "deep"}
    assert (got["deep"].evidence.deep_admin_hits, got["deep"].evidence.successful_admin_access) == (1, 1)
    assert got["five"].evidence.deep_admin_hits == 0


def test_fingerprint(found):
    def visits(ip, n=20, agent="same", paths=("/a", "/b")):
        return [row(i * i, ip, paths[i % len(paths)], agent=agent) for i in range(n)]

    rows = visits("1.1.1.1") + visits("10.0.0.1", 25) + visits("2.2.2.2", 19) + visits("3.3.3.3", agent="other")
    rows += visits("4.4.4.4", paths=("/a", "/c")) + [row(i * 5, "5.5.5.5", ("/a", "/b")[i % 2], agent="same") for i in range(20)]
    got = found("distributed_fingerprint", rows)
    assert set(got) == {"1.1.1.1"}
    (session,) = got.values()
    assert session.ip_count == 2 and session.request_count == 45 and session.total_bytes == 4500 and not session.is_internal
    assert session.evidence.common_endpoints == ["/a", "/b"] and session.evidence.rhythm_class == "normal"


def test_chosen_and_own_detectors(requests_of):
    requests = requests_of([row(i, "9.9.9.9", "/admin/users") for i in range(3)])
    chosen = {"admin_recon": DETECTORS["admin_recon"], "again": DETECTORS["admin_recon"]}
    got = detect_all(requests, ip_profile(requests), detectors=chosen).collect()
    assert [(s.ip, s.detector_order) for s in sorted(got, key=lambda s: s.detector_order)] == [("9.9.9.9", 0), ("9.9.9.9", 1)]
    assert json.loads(got[0].evidence)["deep_admin_hits"] == 3
    assert {(r.attack_type, r.n) for r in evidence_counts(requests).collect()} == {("admin_recon", 3)}


def test_no_detectors_give_an_empty_table(requests_of):
    requests = requests_of([row(0)])
    found = detect_all(requests, ip_profile(requests), detectors={})
    assert found.count() == 0 and {"attack_type", "evidence", "detector_order"} <= set(found.columns)
    assert stored_findings(requests, ip_profile(requests), detectors={}).count() == 0
