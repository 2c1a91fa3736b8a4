"""Live alerts on trailing-window bursts: logins and downloads of one address.

Two stateful steps. The first sums rows per (address, second), which combines
before the shuffle and leaves a hot address one row per second. The second keeps
the last window of an address as sums per minute with their seconds beside them, reads
seconds only where minutes leave the answer open, and reports an address when a
test first holds and whenever it holds again after a quiet window.

The first step gives a second away when the watermark has passed it. So the last seconds
of a log, as many as the delay, come out once later lines move time on; a log that has
ended needs one such line (``END_OF_LOG``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewarden.config import DEFAULT, Config
from tracewarden.operators.detectors.data_exfiltration import is_download
from tracewarden.streaming.source import watched

#: A line, to be dated after the log's end by more than the delay, that no test counts.
END_OF_LOG = "{:%Y-%m-%dT%H:%M:%SZ} 0.0.0.0 GET / 200 0 end-of-log"
ALERT = "ip string, second bigint, first_sum bigint, second_sum bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def seconds_of(requests: DataFrame, condition: Column, first: Column, second: Column, delay: str) -> DataFrame:
    """Two sums per (address, second). Log formats carry whole seconds, so this loses nothing."""
    return (
        watched(requests, delay, condition)
        .groupBy("ip", F.window("timestamp", "1 second").alias("window"))
        .agg(F.sum(first).alias("first_sum"), F.sum(second).alias("second_sum"))
        .select("ip", F.col("window.start").alias("second"), F.window_time("window").alias("at"), "first_sum", "second_sum")
    )


class TrailingBurst(StatefulProcessor):
    """Sums over ``(t - seconds, t]`` per address, in order of time.

    The state is a ring of two levels: a sum for each minute of the window, and the seconds of each
    minute, which are read for one minute alone, and only while the answer is open. A minute with one
    second holds that second beside its sum, and each minute its last hit. The whole minutes
    inside a window bound its sums from below, with the minute that its edge runs through
    from above. ``test`` answers for exact sums, ``surely(low, high)`` and ``possibly(low, high)`` for
    bounds; all see pairs of numpy arrays or numbers. A second arrives once, after the watermark has
    passed it, so seconds of later batches are later.

    An address alerts at its first hit, and again after a whole window without one. Every call to the state
    goes to another process, so only new minutes are written, and an address has one timer, which is
    set anew when it finds later minutes and clears an idle address one window after its last minute.
    """

    def __init__(self, seconds: int, test, surely, possibly):
        if seconds % 60:
            raise ValueError("the window must be whole minutes")
        self._seconds, self._test, self._surely, self._possibly = seconds, test, surely, possibly

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._minutes = handle.getMapState("minutes", "minute bigint", "first_sum bigint, second_sum bigint, only bigint, hit bigint")
        self._detail = handle.getMapState("detail", "minute bigint", "at array<bigint>, first_sum array<bigint>, second_sum array<bigint>")

    def _seconds_of(self, minute: int, old: dict[int, tuple], new: dict[int, dict[int, tuple[int, int]]]) -> list[tuple[int, int, int]]:
        """The seconds of one minute, from the state (if it knows the minute) and from this batch."""
        known: list = []
        if minute in old:
            first, second, only, _ = old[minute]
            known = list(zip(*self._detail.getValue((minute,)))) if only is None else [(only, first, second)]
        return [*known, *((at, *sums) for at, sums in sorted(new.get(minute, {}).items()))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        def seconds() -> Iterator[tuple]:
            for chunk in rows:
                at = chunk["second"].to_numpy().astype("datetime64[s]").astype("int64")
                yield from zip(at.tolist(), chunk["first_sum"].tolist(), chunk["second_sum"].tolist())

        alerts = [(ip, pd.Timestamp(at, unit="s"), *sums) for ip, at, *sums in self.alerts_of(key[0], seconds())]
        if alerts:
            yield pd.DataFrame(alerts, columns=["ip", "second", "first_sum", "second_sum"])

    def alerts_of(self, ip: str, seconds: Iterable[tuple]) -> list[tuple]:
        """Take new seconds with their sums into the state; the alerts they raise, by epoch second."""
        new: dict[int, dict[int, tuple[int, int]]] = {}
        for at, first, second in seconds:
            own = new.setdefault(at // 60, {})
            a, b = own.get(at, (0, 0))
            own[at] = (a + int(first), b + int(second))
        if not new:
            return []
        width, last = self._seconds // 60, max(new)
        old = {minute: tuple(sums) for (minute,), sums in self._minutes.iterator()}
        total = {m: sums[:2] for m, sums in old.items() if m >= min(new) - width}
        before = {m: total.get(m, (0, 0)) for m in new}
        for m, own in new.items():
            total[m] = tuple(map(sum, zip(before[m], *own.values())))
        # no window holds more than all minutes together
        most = tuple(map(sum, zip(*total.values())))
        alerts, hits = self._hits(ip, new, old, before, total) if self._possibly((0, 0), most) else ([], {})
        for m, (_, _, only, _) in old.items():
            if m < last - width:
                self._minutes.removeKey((m,))
                if only is None:
                    self._detail.removeKey((m,))
        for m in sorted(new):
            if m >= last - width:
                whole = self._seconds_of(m, old, new)
                hit = hits.get(m, old[m][3] if m in old else None)
                self._minutes.updateValue((m,), (*total[m], whole[0][0] if len(whole) == 1 else None, hit))
                if len(whole) > 1:
                    self._detail.updateValue((m,), tuple(list(map(int, c)) for c in zip(*whole)))
        if not old:
            self._handle.registerTimer(self._idle_at(last))
        return alerts

    def _hits(self, ip: str, new: dict, old: dict, before: dict, total: dict) -> tuple[list[tuple], dict[int, int]]:
        """Alerts at the new seconds, and the last hit of each minute with one.

        ``total`` are sums of minutes with the new seconds, ``before`` without.
        """
        width = self._seconds // 60
        minutes = np.array(sorted(total), np.int64)
        sums = np.cumsum([(0, 0), *(total[m] for m in minutes.tolist())], axis=0, dtype=np.int64)

        def upto(minute: np.ndarray) -> np.ndarray:
            """Sums of the minutes before some."""
            return sums[np.searchsorted(minutes, minute)]

        times = np.array(sorted(at for own in new.values() for at in own), np.int64)
        own = times // 60
        in_minute = np.array([new[m][at] for m, at in zip(own.tolist(), times.tolist())], np.int64)
        so_far = np.cumsum(in_minute, axis=0)
        start = np.searchsorted(own, own)  # the first new second of each one's minute
        current = so_far - so_far[start] + in_minute[start] + np.array([before[m] for m in own.tolist()])
        edge = own - width
        low = upto(own) - upto(edge + 1) + current
        high = low + upto(edge + 1) - upto(edge)
        sure = self._surely(low.T, high.T)
        open_ = self._possibly(low.T, high.T) & ~sure
        exact: dict[int, np.ndarray] = {}
        read: dict[int, list] = {}

        def window(i: int) -> np.ndarray:
            """The exact sums of the window that ends at a new second."""
            if i not in exact:
                m = int(edge[i])
                if m in total and m not in read:
                    read[m] = self._seconds_of(m, old, new)
                inside = [(a, b) for at, a, b in read.get(m, ()) if at > times[i] - self._seconds]
                exact[i] = low[i] + np.sum(inside or [(0, 0)], axis=0, dtype=np.int64)
            return exact[i]

        # a hit whose minute has left the state is more than a window ago
        last_hit = max((hit for *_, hit in old.values() if hit is not None), default=None)
        alerts, hits = [], {}
        for i in np.flatnonzero(sure | open_).tolist():
            if not sure[i]:
                a, b = window(i)
                if not bool(self._test(a, b)):
                    continue
            at = int(times[i])
            if last_hit is None or at - last_hit > self._seconds:
                alerts.append((ip, at, *map(int, window(i))))
            last_hit = hits[at // 60] = at
        return alerts, hits

    def _idle_at(self, minute: int) -> int:
        """The watermark in milliseconds at which no window that is still to come holds a second of a minute."""
        return ((minute + 1) * 60 + self._seconds) * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {minute: only for (minute,), (_, _, only, _) in self._minutes.iterator()}
        at = self._idle_at(max(held))
        if at > timerValues.getCurrentWatermarkInMs():
            self._handle.registerTimer(at)
        else:
            self._minutes.clear()
            if None in held.values():
                self._detail.clear()
        return iter(())

    def close(self) -> None:
        pass


class TrailingBurstRows(TrailingBurst):
    """The same over rows, without a data frame per address; ``second`` is an epoch second."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for alert in self.alerts_of(key[0], ((r.second, r.first_sum, r.second_sum) for r in rows)):
            yield Row(**dict(zip(("ip", "second", "first_sum", "second_sum"), alert)))


def login_test(cfg: Config = DEFAULT) -> tuple:
    """Enough logins with a high share of failures: for exact sums, surely and possibly for bounds."""
    least, ratio = cfg.burst_logins, cfg.burst_failure_ratio

    def test(failed, others):
        return (failed + others >= least) & (failed >= ratio * (failed + others))

    def surely(low, high):  # fewest failures among the most other logins
        return (low[0] + low[1] >= least) & (low[0] >= ratio * (low[0] + high[1]))

    def possibly(low, high):
        return (high[0] + high[1] >= least) & (high[0] >= ratio * (high[0] + low[1]))

    return test, surely, possibly


def download_test(cfg: Config = DEFAULT) -> tuple:
    """Enough bytes and downloads."""

    def test(volume, n):
        return (volume >= cfg.burst_exfil_bytes) & (n >= cfg.burst_exfil_requests)

    return test, lambda low, high: test(*low), lambda low, high: test(*high)


def _alerts(seconds: DataFrame, window: int, tests: tuple) -> DataFrame:
    alerts = (
        seconds.withColumn("second", F.unix_seconds("second"))
        .groupBy("ip")
        .transformWithState(
            statefulProcessor=TrailingBurstRows(window, *tests), outputStructType=ALERT, outputMode="Append", timeMode="EventTime"
        )
    )
    return alerts.withColumn("second", F.timestamp_seconds("second"))


def login_burst_stream(requests: DataFrame, cfg: Config = DEFAULT, delay: str = "10 minutes") -> DataFrame:
    """``first_sum`` are failed, ``second_sum`` other logins."""
    failed = F.col("is_failed_login").cast("bigint")
    return _alerts(seconds_of(requests, F.col("is_login"), failed, 1 - failed, delay), cfg.burst_seconds, login_test(cfg))


def download_burst_stream(requests: DataFrame, cfg: Config = DEFAULT, delay: str = "10 minutes") -> DataFrame:
    """``first_sum`` are bytes, ``second_sum`` downloads."""
    seconds = seconds_of(requests, is_download(), F.col("bytes"), F.lit(1).cast("bigint"), delay)
    return _alerts(seconds, cfg.burst_seconds, download_test(cfg))


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State variables need the RocksDB store: start burst queries inside this block."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)
