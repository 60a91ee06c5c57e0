"""Circuit breaker and adaptive pacing: one state machine for batch and for streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

BREAKER = "host string, opened long, rejected long, passed long, open_until double"
PACE = "host string, waits long, waited double, delay double"


class Breaker:
    """Opens for ``cooldown`` seconds after ``limit`` failures in a row; requests in that time are rejected."""

    def __init__(self, limit: int = 4, cooldown: float = 120.0, state: tuple = (0, 0.0, 0, 0, 0)):
        self.limit, self.cooldown = limit, cooldown
        self.failures, self.until, self.opened, self.rejected, self.passed = state

    def see(self, at: float, failed: bool) -> None:
        if at < self.until:
            self.rejected += 1
            return
        self.passed += 1
        self.failures = self.failures + 1 if failed else 0
        if self.failures >= self.limit:
            self.until, self.failures, self.opened = at + self.cooldown, 0, self.opened + 1

    def state(self) -> tuple:
        return self.failures, self.until, self.opened, self.rejected, self.passed


def circuit_breaker(events: DataFrame, limit: int = 4, cooldown: float = 120.0) -> DataFrame:
    """Batch: ``host, at, failed`` (``at`` in seconds) to a row for each host. Equal times: successes first.

    The order within a host is inherent to the state; hosts run in parallel and
    an iterator of batches keeps a long host out of memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, b = None, Breaker(limit, cooldown)
        for pdf in batches:
            for h, at, failed in zip(pdf["host"], pdf["at"], pdf["failed"], strict=True):
                if h != host:
                    if host is not None:
                        yield _row(host, b)
                    host, b = h, Breaker(limit, cooldown)
                b.see(float(at), bool(failed))
        if host is not None:
            yield _row(host, b)

    return events.where("host is not null").repartition("host").sortWithinPartitions("host", "at", "failed").select("host", "at", "failed").mapInPandas(run, BREAKER)


def _row(host: str, b: Breaker) -> pd.DataFrame:
    return pd.DataFrame({"host": [host], "opened": [b.opened], "rejected": [b.rejected], "passed": [b.passed], "open_until": [b.until]})


def circuit_breaker_stream(events: DataFrame, limit: int = 4, cooldown: float = 120.0, delay: str = "10 minutes", idle: float = 86_400.0) -> DataFrame:
    """Stream: ``host, at, failed`` to a host's row each time that some of its requests are settled.

    Requests wait in the state until the watermark, ``delay`` behind the latest of all hosts, has passed them, and are
    settled in order of time, so the rows are those of the batch whatever order they come in; a request that comes
    later than that is dropped. An open breaker gives a row when it closes, and a host without requests for ``idle``
    seconds of event time is forgotten. Rows without a host or time are left out."""
    _rocks(events.sparkSession)
    timed = events.where("host is not null and at is not null").select("host", F.timestamp_millis(F.ceil(F.col("at") * 1000)).alias("ts"), "at", "failed").withWatermark("ts", delay)
    return timed.groupBy("host").transformWithStateInPandas(_BreakerState(limit, cooldown, idle), BREAKER, "update", "EventTime")


def _rocks(spark) -> None:
    """``transformWithState`` keeps its state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _BreakerState(StatefulProcessor):
    def __init__(self, limit: int, cooldown: float, idle: float):
        self.limit, self.cooldown, self.idle = limit, cooldown, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "failures long, until double, opened long, rejected long, passed long, last double")
        self.waiting = handle.getMapState("waiting", "at double, failed boolean", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for pdf in rows:
            for (at, failed), n in pdf.groupby(["at", "failed"]).size().items():
                own = (float(at), bool(failed))
                before = self.waiting.getValue(own)[0] if self.waiting.containsKey(own) else 0
                self.waiting.updateValue(own, (before + int(n),))
                due.add(math.ceil(own[0] * 1000))
        for at in due:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        *old, last = self.state.get() if self.state.exists() else (0, 0.0, 0, 0, 0, 0.0)
        b = Breaker(self.limit, self.cooldown, tuple(old))
        settled = sorted(k for k in self.waiting.keys() if math.ceil(k[0] * 1000) <= now)
        for at, failed in settled:
            for _ in range(self.waiting.getValue((at, failed))[0]):
                b.see(at, failed)
            self.waiting.removeKey((at, failed))
            last = at
        closes = b.until > 0 and math.ceil(b.until * 1000) == now
        if settled:
            self.state.update((*b.state(), last))
            if b.until > last:
                self.handle.registerTimer(math.ceil(b.until * 1000))
            self.handle.registerTimer(math.ceil((last + self.idle) * 1000))
        elif now >= math.ceil((last + self.idle) * 1000) and not any(True for _ in self.waiting.keys()):
            self.state.clear()
            return
        if settled or closes:
            yield _row(key[0], b)

    def close(self) -> None:
        pass


def adaptive_backoff(events: DataFrame, floor: float = 5.0, cap: float = 20.0) -> DataFrame:
    """``host, waits, waited, delay``: an outage doubles the delay from ``floor`` up to ``cap``, a success halves it, to none below ``floor``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, waits, waited, delay = None, 0, 0.0, 0.0
        out = lambda: pd.DataFrame({"host": [host], "waits": [waits], "waited": [waited], "delay": [delay]})
        for pdf in batches:
            for h, failed in zip(pdf["host"], pdf["failed"], strict=True):
                if h != host:
                    if host is not None:
                        yield out()
                    host, waits, waited, delay = h, 0, 0.0, 0.0
                if failed:
                    delay = min(cap, max(floor, delay * 2))
                    waits, waited = waits + 1, waited + delay
                else:
                    delay = delay / 2 if delay / 2 >= floor else 0.0
        if host is not None:
            yield out()

    return events.where("host is not null").repartition("host").sortWithinPartitions("host", "at", "failed").select("host", "failed").mapInPandas(run, PACE)


def status_stream(outcomes: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Stream of ``id, at, outcome`` to the current status of each id; Imported is never left.

    An outcome older than the one that set the status changes nothing, unless it is a match; of those of one time the
    last by name counts. With ``keep_ms`` an id that gets no outcome for so long is forgotten (Imported too, so choose it
    longer than the source repeats)."""
    _rocks(outcomes.sparkSession)
    return outcomes.where("id is not null").select("id", "at", "outcome").groupBy("id").transformWithStateInPandas(_Status(keep_ms), "id long, status string", "update", "ProcessingTime" if keep_ms else "None")


class _Status(StatefulProcessor):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("status", "status string, at double, outcome string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, since, by = self.state.get() if self.state.exists() else ("Pending", float("-inf"), "")
        for pdf in rows:
            for at, outcome in zip(pdf["at"], pdf["outcome"], strict=True):
                if now == "Imported" or outcome == "match":
                    now = "Imported"
                elif (float(at), outcome or "") >= (since, by):
                    now, since, by = {"candidate": "Review", "miss": "NoMatch"}.get(outcome, "Unresolved"), float(at), outcome or ""
        self.state.update((now, since, by))
        yield pd.DataFrame({"id": [key[0]], "status": [now]})

    def close(self) -> None:
        pass
