"""Requests as they arrive, allowed or denied by the state of their client."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Config, config
from ..plans.serve import is_limited


class ClientWindows(StatefulProcessor):
    """Of each client the window that is open (its beginning and how many requests it has had).

    A timer drops the state when no request can fall into the window any more.
    """

    def __init__(self, seconds: int, limit: int):
        self._span, self._limit = seconds * 1000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("window", "begin long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        found = self._open.get()
        begin, n = (found[0], found[1]) if found else (None, 0)
        for at, request in sorted((r["at_ms"], r["key"]) for r in rows):
            if begin is None or at >= begin + self._span:
                if begin is not None:
                    self._handle.deleteTimer(begin + self._span)
                begin, n = at, 0
                self._handle.registerTimer(begin + self._span)
            n += 1
            yield Row(client=key[0], key=request, at_ms=at, begin_ms=begin, nth=n, allowed=n <= self._limit)
        self._open.update((begin, n))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self._open.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited_requests(requests: DataFrame, settings: Config | None = None, late: str = "1 minute") -> DataFrame:
    """A stream of decisions on the requests (client, path, at, key) that go to the API: window_start, nth and allowed.

    Requests of one batch count in the order of their time, equal ones by ``key``; what is later than ``late`` is
    dropped. Times have milliseconds.
    """
    settings = settings or config(requests.sparkSession)
    seen = requests.where(is_limited(F.col("path")) & F.col("client").isNotNull()).withWatermark("at", late)
    rows = seen.select("at", F.col("client").cast("string").alias("client"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), F.col("key").cast("string").alias("key"))
    found = rows.groupBy("client").transformWithState(ClientWindows(settings.rate_seconds, settings.rate_limit), "client string, key string, at_ms long, begin_ms long, nth long, allowed boolean", "Append", "EventTime")
    return found.select("client", "key", F.timestamp_millis("at_ms").alias("at"), F.timestamp_millis("begin_ms").alias("window_start"), "nth", "allowed")
