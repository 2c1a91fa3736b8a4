from __future__ import annotations

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from registry import fixture, streams
from tests.conftest import START, login, row
from tracewarden.operators.detectors import data_exfiltration, distributed_login
from tracewarden.config import DEFAULT
from tracewarden.operators.profile import interval_cv, ip_profile, rhythm_of_slices
from tracewarden.plans.reputation import ip_reputation
from tracewarden.sources.access_log import parse_lines, read_lines
from tracewarden.operators.enrich import enrich
from tracewarden.streaming import bursts, logins, recompute, tables
from tracewarden.streaming.state import BucketedState
from tracewarden.streaming.source import stream_lines, stream_requests


@pytest.fixture
def log_folder(tmp_path):
    """Three files; the second one repeats times of the first, out of order."""
    parts = [
        [login(i * 10, f"1.1.1.{i % 5}") for i in range(20)] + [row(i * 30, "2.2.2.2", "/api/export", size=190_000) for i in range(25)],
        [login(i * 10 + 5, f"1.1.1.{i % 4}", agent="x") for i in range(10)],
        [row(900 + i * 30, "2.2.2.2", "/api/export", size=190_000) for i in range(5)] + [row(8_000, "9.9.9.9"), row(20_000, "9.9.9.9")],
    ]
    folder = tmp_path / "log"
    folder.mkdir()
    for i, rows in enumerate(parts):
        lines = [f"{t:%Y-%m-%dT%H:%M:%SZ} {ip} {m} {url} {st} {size} {agent}" for t, ip, m, url, st, size, agent in rows]
        (folder / f"{i}.log").write_text("\n".join(["# part", *lines, "garbage"]) + "\n")
        os.utime(folder / f"{i}.log", (1_700_000_000 + i, 1_700_000_000 + i))  # files arrive in this order
    return str(folder)


def _batch(spark, folder):
    return enrich(parse_lines(read_lines(spark, folder)))


def _stream(spark, folder):
    return stream_requests(stream_lines(spark, folder, files_per_batch=1))


def test_live_logins_equal_batch(spark, log_folder, tmp_path):
    out = str(tmp_path / "clients")
    logins.follow(_stream(spark, log_folder), out, str(tmp_path / "ck"), delay="1 day", refresh_seconds=None).awaitTermination()
    assert tables.read_batches(spark, out).select("batch_id").distinct().count() >= 2
    requests = _batch(spark, log_folder)
    wanted = distributed_login.detect(requests, None)
    columns = ["ip", "start_time", "request_count", "total_bytes", "shared_user_agent"]
    key = lambda r: tuple(map(str, r))
    got = sorted(logins.alerts(spark, out).select(*columns).collect(), key=key)
    assert got == sorted(wanted.select(*columns).collect(), key=key) and got


def test_updates_are_folded(spark, tmp_path):
    folder, schema = str(tmp_path / "updates"), "k string, v long"
    for i in range(6):
        tables.write_updates(spark.createDataFrame([("a", i), (f"k{i}", i)], schema), folder, i, ("k",), every=4)
    stored = tables.read_batches(spark, folder)
    assert {r.batch_id for r in stored.select("batch_id").distinct().collect()} == {3, 4, 5}
    tables.write_updates(spark.createDataFrame([("a", 4), ("k4", 4)], schema), folder, 4, ("k",), every=4)  # runs again
    newest = {r.k: r.v for r in tables.latest(tables.read_batches(spark, folder), ("k",)).collect()}
    assert newest == {"a": 5, **{f"k{i}": i for i in range(6)}}


def test_live_scores_equal_batch(spark, log_folder, tmp_path):
    out = str(tmp_path / "live")
    query = recompute.follow(_stream(spark, log_folder), out, str(tmp_path / "ck"), refresh_seconds=None)
    query.awaitTermination()
    # stored requests are written and never read for scores
    assert "requests" not in {p.split("/")[-2] for p in tables.read_batches(spark, f"{out}/scores").inputFiles()}
    want = {r.ip: (r.score, r.breakdown) for r in ip_reputation(ip_profile(_batch(spark, log_folder))).collect()}
    assert {r.ip: (r.score, r.breakdown) for r in recompute.current_scores(spark, out).collect()} == want


def test_state_is_read_by_bucket_and_folded(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path / "state"), ("ip",), buckets=8, fold_every=4)
    rows = lambda pairs: spark.createDataFrame(pairs, "ip string, v long")
    want = {}
    for batch in range(10):
        changed = [(f"10.0.0.{i}", 100 * batch + i) for i in range(batch, batch + 5)]
        for _ in range(2 if batch % 3 == 0 else 1):  # some batches run twice
            state.fold(batch)
            state.write(rows(changed + changed[:1]), batch)  # an address may have several rows
        want |= dict(changed)
        if batch == 6:
            before = state.read(list(range(8)), below=6)
            assert {r.v // 100 for r in before.collect()} <= set(range(6))
    one = state.touched(rows([("10.0.0.7", 0)]))
    read = state.read(one)
    assert len(one) == 1 and all(f"/bucket={one[0]}/" in f for f in read.inputFiles())
    whole = state.read(list(range(8)))
    assert {r.ip: r.v for r in whole.collect()} == want and whole.count() == len(want) + 10
    versions = [len(list(b.glob("version=*"))) for b in (tmp_path / "state").glob("bucket=*")]
    assert max(versions) <= 5 + 1
    assert state.read([99]) is None


def test_closed_slices_are_one_row_and_keep_the_rhythm(spark):
    rng = random.Random(5)
    seconds = sorted(rng.choice([rng.randint(0, 4000), 60 * rng.randint(0, 60)]) for _ in range(300))
    rows = [(START + dt.timedelta(seconds=s), f"1.1.1.{s % 3}") for s in seconds]
    batch = spark.createDataFrame(rows, "timestamp timestamp, ip string")
    want = {r.ip: r.interval_cv for r in interval_cv(batch).collect()}
    rhythm, first = recompute.with_instants(None, batch, -(1 << 62), DEFAULT), int(START.timestamp()) // DEFAULT.slice_seconds
    for border in (first - 5, first + 20, first + 41, first + 500):  # closed bit by bit
        rhythm = recompute.closed_before(rhythm, border)
        assert rhythm.where((F.col("slice") < border) & F.col("us").isNotNull()).isEmpty()
        got = {r.ip: r.interval_cv for r in rhythm_of_slices(recompute.segments(rhythm)).collect()}
        assert got == pytest.approx(want)
    assert rhythm.count() == 3


def test_late_rows_leave_the_rhythm_alone(spark, tmp_path):
    parts = [[row(i * 60, "1.1.1.1") for i in range(10)], [row(7_200, "2.2.2.2")], [row(30, "1.1.1.1"), row(7_210, "1.1.1.1")]]
    folder, out = _write_log(tmp_path / "log", parts), str(tmp_path / "live")
    recompute.follow(_stream(spark, folder), out, str(tmp_path / "ck"), refresh_seconds=None, delay_seconds=600, fold_every=2).awaitTermination()
    agents, rhythm = recompute.states(spark, out)
    assert {r.ip: r.total_requests for r in agents.read(range(64)).collect()} == {"1.1.1.1": 12, "2.2.2.2": 1}
    rows = sorted((r.ip, r.us is None, r.n) for r in rhythm.read(range(64)).collect())
    assert rows == [("1.1.1.1", False, 1), ("1.1.1.1", True, 10), ("2.2.2.2", False, 1)]


def test_live_bursts_equal_batch(spark, log_folder, tmp_path):
    out = str(tmp_path / "alerts")

    def store(batch, batch_id):
        tables.write_batch(batch, out, batch_id)

    stream = bursts.download_burst_stream(_stream(spark, log_folder), delay="0 seconds")
    with bursts.rocksdb_state(spark):
        query = tables.start(stream, str(tmp_path / "ck"), store, "append", None)
    query.awaitTermination()
    (alert,) = tables.read_batches(spark, out).collect()
    want = data_exfiltration.download_bursts(data_exfiltration.downloads_of(_batch(spark, log_folder))).collect()
    assert [r.ip for r in want] == [alert.ip] == ["2.2.2.2"]
    # the thirtieth download is the first that meets both limits
    assert (alert.first_sum, alert.second_sum) == (30 * 190_000, 30)
    assert alert.second.timestamp() - START.replace(tzinfo=None).timestamp() == 900 + 4 * 30


def _alerts(spark, folder, tmp_path, delay="10 minutes"):
    out = str(tmp_path / "alerts")

    def store(batch, batch_id):
        tables.write_batch(batch, out, batch_id)

    stream = bursts.login_burst_stream(_stream(spark, folder), delay=delay)
    with bursts.rocksdb_state(spark):
        tables.start(stream, str(tmp_path / "ck"), store, "append", None).awaitTermination()
    return tables.read_batches(spark, out)


def _write_log(folder, parts):
    folder.mkdir()
    for i, rows in enumerate(parts):
        lines = [f"{t:%Y-%m-%dT%H:%M:%SZ} {ip} {m} {url} {st} {size} {agent}" for t, ip, m, url, st, size, agent in rows]
        (folder / f"{i}.log").write_text("\n".join(lines) + "\n")
        os.utime(folder / f"{i}.log", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def test_late_rows_count_and_the_end_comes_out(spark, tmp_path):
    even, odd = ([login(i * 10, "1.1.1.1") for i in range(20) if i % 2 == k] for k in (0, 1))
    end = [row(3_600, "0.0.0.0")]
    (alert,) = _alerts(spark, _write_log(tmp_path / "log", [odd, even, end]), tmp_path).collect()
    assert alert.second.timestamp() - START.replace(tzinfo=None).timestamp() == 140 and alert.first_sum == 15


def test_an_address_alerts_again_after_a_quiet_window_and_leaves_the_state(spark, tmp_path):
    day = 86_400
    bursts_of = lambda at: [login(at + i, "1.1.1.1") for i in range(20)]
    idle = [login(i, f"2.2.2.{i}") for i in range(20)]
    parts = [bursts_of(0) + idle, bursts_of(600), bursts_of(day), [row(3 * day, "0.0.0.0")], [row(4 * day, "0.0.0.0")]]
    got = _alerts(spark, _write_log(tmp_path / "log", parts), tmp_path).collect()
    starts = sorted(int(a.second.timestamp() - START.replace(tzinfo=None).timestamp()) for a in got)
    assert starts == [14, day + 14] and {a.ip for a in got} == {"1.1.1.1"}
    state = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("operatorId", 0)
    assert state.option("stateVarName", "minutes").load().count() == 0


def test_refresh_is_one_to_thirty_seconds(spark, log_folder, tmp_path):
    with pytest.raises(ValueError):
        recompute.follow(_stream(spark, log_folder), str(tmp_path), str(tmp_path / "ck"), refresh_seconds=31)


class _Store:
    """A state variable in memory that counts what is read of it."""

    def __init__(self):
        self.held, self.reads = {}, []

    def iterator(self):
        for k, v in list(self.held.items()):
            self.reads.append(k)
            yield k, v

    def getValue(self, k):
        self.reads.append(k)
        return self.held[k]

    def updateValue(self, k, v):
        self.held[k] = v

    def removeKey(self, k):
        del self.held[k]

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[()]

    def update(self, v):
        self.held[()] = v


class _Handle:
    def __init__(self):
        self.state = {}

    def getMapState(self, name, *_):
        return self.state.setdefault(name, _Store())

    getValueState = getMapState

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


def _plain_alerts(rows, window, test):
    out, last = [], None
    for t in sorted({r[0] for r in rows}):
        a, b = (sum(r[i] for r in rows if t - window < r[0] <= t) for i in (1, 2))
        if test(a, b):
            if last is None or t - last > window:
                out.append((t, a, b))
            last = t
    return out


@pytest.mark.parametrize("kind", ["login", "download"])
def test_the_ring_of_minutes_is_exact_and_seldom_opened(kind):
    window = 10_800
    tests = (bursts.login_test if kind == "login" else bursts.download_test)(DEFAULT)
    some_alerts = 0
    for seed in range(25):
        rng = random.Random(seed)
        t, rows, opened = 1_700_000_000 + rng.randint(0, 59), [], 0
        for _ in range(rng.randint(60, 250)):
            t += rng.choice([1, 1, 7, 60, 130, 600, rng.choice([1, 4000, 11_000])])
            rows.append((t, rng.randint(0, 2), rng.randint(0, 2)) if kind == "login" else (t, rng.randint(0, 400_000), rng.randint(1, 2)))
        handle = _Handle()
        ring = bursts.TrailingBurst(window, *tests)
        ring.init(handle)
        got, at = [], 0
        while at < len(rows):
            n = rng.choice([1, 2, 5, 40])
            part = pd.DataFrame(rows[at : at + n], columns=["second", "first_sum", "second_sum"])
            part["second"] = pd.to_datetime(part["second"], unit="s")
            for found in ring.handleInputRows(("x",), iter([part]), None):
                got += [(int(r.second.timestamp()), r.first_sum, r.second_sum) for r in found.itertuples()]
            minutes, detail = handle.state["minutes"], handle.state["detail"]
            assert len(minutes.reads) <= window // 60 + 1
            opened += len(detail.reads)
            minutes.reads, detail.reads, at = [], [], at + n
        assert got == _plain_alerts(rows, window, tests[0])
        some_alerts += len(got)
        assert opened <= 2 * len(rows)
    assert some_alerts > 10


def test_quiet_addresses_read_no_seconds():
    handle = _Handle()
    ring = bursts.TrailingBurst(10_800, *bursts.download_test(DEFAULT))
    ring.init(handle)
    for i in range(300):  # one small download a minute: no window comes near the limits
        part = pd.DataFrame([(pd.Timestamp(1_700_000_000 + 60 * i, unit="s"), 10, 1)], columns=["second", "first_sum", "second_sum"])
        assert list(ring.handleInputRows(("x",), iter([part]), None)) == []
    assert handle.state["detail"].reads == [] and len(handle.state["minutes"].held) <= 181


class _Clearable(_Store):
    def __init__(self):
        super().__init__()
        self.written = 0

    def updateValue(self, k, v):
        super().updateValue(k, v)
        self.written += 1

    def clear(self):
        self.held = {}


class _Timed(_Handle):
    """A handle that notes timers; also what a processor is told of the watermark."""

    def __init__(self):
        super().__init__()
        self.timers, self.watermark = [], 0

    def getMapState(self, name, *_):
        return self.state.setdefault(name, _Clearable())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        raise AssertionError("a timer that is still to come stays")

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_minute_costs_one_write_and_an_address_one_timer():
    start, handle = 1_699_999_980, _Timed()
    ring = bursts.TrailingBurstRows(10_800, *bursts.download_test(DEFAULT))
    ring.init(handle)
    for i in range(200):  # one small download a minute
        assert list(ring.handleInputRows(("x",), iter([Row(second=start + 60 * i + 7, first_sum=10, second_sum=1)]), handle)) == []
    minutes, detail = handle.state["minutes"], handle.state["detail"]
    assert minutes.written == 200 and detail.written == 0 and set(handle.state) == {"minutes", "detail"}
    assert handle.timers == [(start + 60 + 10_800) * 1000]
    # the timer finds later minutes and is set anew; then the address is idle
    handle.watermark = handle.timers.pop()
    assert list(ring.handleExpiredTimer(("x",), handle, None)) == [] and minutes.held
    assert handle.timers == [(start + 60 * 200 + 10_800) * 1000]
    handle.watermark = handle.timers.pop()
    assert list(ring.handleExpiredTimer(("x",), handle, None)) == [] and not minutes.held and not handle.timers


@pytest.mark.parametrize("kind", ["login", "download"])
def test_rows_and_their_timers_give_the_plain_alerts(kind):
    """Quiet times longer than the window, so that timers clear and set anew between bursts."""
    window, some_alerts, cleared = 10_800, 0, 0
    tests = (bursts.login_test if kind == "login" else bursts.download_test)(DEFAULT)
    for seed in range(20):
        rng = random.Random(seed)
        t, rows = 1_700_000_000 + rng.randint(0, 59), []
        for _ in range(rng.randint(60, 200)):
            t += rng.choice([1, 1, 1, 7, 60, 130, rng.choice([4000, 10_800, 10_801, 30_000])])
            rows.append((t, rng.randint(0, 4), rng.randint(0, 2)) if kind == "login" else (t, rng.randint(0, 900_000), rng.randint(1, 9)))
        handle = _Timed()
        ring = bursts.TrailingBurstRows(window, *tests)
        ring.init(handle)
        got, at = [], 0
        while at < len(rows):
            n = rng.choice([1, 2, 5])
            part = [Row(second=s, first_sum=a, second_sum=b) for s, a, b in rows[at : at + n]]
            got += [(r.second, r.first_sum, r.second_sum) for r in ring.handleInputRows(("x",), iter(part), handle)]
            at += n
            # time passes as far as the next second allows
            handle.watermark = (rows[at] if at < len(rows) else rows[-1])[0] * 1000
            due = [x for x in handle.timers if x <= handle.watermark]
            handle.timers = [x for x in handle.timers if x > handle.watermark]
            for _ in due:
                list(ring.handleExpiredTimer(("x",), handle, None))
            cleared += not handle.state["minutes"].held
            assert bool(handle.state["minutes"].held) == (len(handle.timers) == 1)
        assert got == _plain_alerts(rows, window, tests[0])
        some_alerts += len(got)
    assert some_alerts > 10 and cleared > 10


@pytest.mark.parametrize("days", [[0] * 40, [0] * 30 + [29] * 30])
def test_the_log_arrives_in_parts_of_as_many_files(spark, tmp_path, days):
    """Parts without a line, too, so that a batch never takes files of the next part."""
    first = dt.datetime(2024, 1, 1)
    rows = [(i, first + dt.timedelta(days=d, seconds=i), i % 7, float(i)) for i, d in enumerate(days)]
    rows += [(len(days), None, 1, 2.0), (len(days) + 1, None, None, None)]
    folder = tmp_path / "tables"
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, value double").write.parquet(f"{folder}/events.parquet")
    log = streams._log_folder(spark, str(folder), str(tmp_path), 3)
    files = sorted((p for p in (tmp_path / "log").iterdir() if p.name.startswith("part-")), key=lambda p: p.stat().st_mtime_ns)
    assert log == str(tmp_path / "log") and len(files) == 3 * 6 + 1
    lines = [p.read_text().splitlines() for p in files]
    parts = [sum(lines[3 * i : 3 * i + 3], []) for i in range(7)]
    hours = []
    for part in parts[:6]:
        stamped = spark.createDataFrame([(x,) for x in part], "value string")
        hours.append([(r.timestamp - first).total_seconds() / 3600 for r in parse_lines(stamped).collect()])
    edges = [float("-inf"), *streams.PART_HOURS, float("inf")]
    assert all(edges[i] <= h < edges[i + 1] for i, own in enumerate(hours) for h in own) and sum(map(len, hours)) == len(days)
    want = sorted(r.value for r in fixture.log_lines(spark, str(folder)).collect())
    assert sorted(x for part in parts[:6] for x in part if not x.startswith("# file ")) == want
    assert sum(len(own) > 1 for own in lines[:18]) >= 6 and len(parts[6]) == 1
