"""What keeps streams going: a gate that waits for models, restarts after failures, and a status board."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from threading import Condition

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.tables import missing
from ..sources.models import catalogue

#: Names of the observed counts that the board adds up: tasks put into the queue, and tasks taken out.
PUBLISHED, CONSUMED = "published", "consumed"


# -- waiting for models


def wait_for_models(spark: SparkSession, required: list[str], answer: Callable[[], str], seconds: float = 5.0, polls: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Ask the catalogue (a JSON answer with a list ``models``) until a name of it contains each required one; how often it was asked.

    A call that raises, or an answer that is no catalogue, counts as one without models. After ``polls`` calls the names
    that are missing raise.
    """
    wanted = spark.createDataFrame([(r,) for r in required], "name string")
    asked = 0
    while True:
        try:
            said = answer()
        except Exception:
            said = "{}"
        asked += 1
        there = catalogue(spark.createDataFrame([(said,)], "value string"))
        lacking = [r["name"] for r in missing(wanted, there).collect()]
        if not lacking:
            return asked
        if polls is not None and asked >= polls:
            raise TimeoutError(f"no model {', '.join(sorted(lacking))} after {asked} calls")
        sleep(seconds)


# -- restarts


class _Ends(StreamingQueryListener):
    """Which runs have ended, with what exception, and which have come further since they were started."""

    def __init__(self):
        self.ended: dict[str, str | None] = {}
        self.moved: set[str] = set()
        self.news = Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        with self.news:
            self.moved.add(str(event.progress.runId))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.news:
            self.ended[str(event.runId)] = event.exception
            self.news.notify_all()

    def wait(self, run: str) -> str | None:
        with self.news:
            self.news.wait_for(lambda: run in self.ended)
            return self.ended[run]


def supervise(spark: SparkSession, start: Callable[[], StreamingQuery], wait: float = 5.0, most_wait: float = 300.0, restarts: int | None = None, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Run a stream until it ends by itself; start it again from its checkpoint whenever it fails. The exceptions, in turn.

    Waits before a restart double from ``wait`` to ``most_wait``, and begin anew once a run has finished a batch. A start that raises is
    a failure too. After ``restarts`` failures in a row the last one is raised.
    """
    listener, failures, row = _Ends(), [], 0
    spark.streams.addListener(listener)
    try:
        while True:
            run = None
            try:
                run = str(start().runId)
                if (error := listener.wait(run)) is None:
                    return failures
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
            failures.append(error)
            row = 1 if run in listener.moved else row + 1
            if restarts is not None and row > restarts:
                raise RuntimeError(f"failed {row} times in a row: {error}")
            sleep(min(most_wait, wait * 2 ** (row - 1)))
    finally:
        spark.streams.removeListener(listener)


# -- status


@dataclass(frozen=True)
class _Line:
    name: str
    state: str
    batch: int | None = None
    rows: int = 0
    at: str | None = None
    error: str | None = None


class StatusBoard(StreamingQueryListener):
    """The state of each named stream, and how many tasks wait, from the streams' own progress.

    A stream is ``idle`` when its last trigger found nothing, ``running`` when it took rows, then ``stopped`` or ``failed``. The
    queue's length is what streams observed as published less what they observed as consumed, from where ``waiting`` says the board began.
    """

    def __init__(self, waiting: int = 0):
        self._lines: dict[str, _Line] = {}
        self._names: dict[str, str] = {}
        self._waiting = waiting
        self._news = Condition()

    def _put(self, line: _Line) -> None:
        with self._news:
            self._lines[line.name] = line
            self._news.notify_all()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        name = event.name or str(event.id)
        self._names[str(event.runId)] = name
        self._put(_Line(name, "running", at=event.timestamp))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = {name: row["n"] or 0 for name, row in p.observedMetrics.items() if name in (PUBLISHED, CONSUMED)}
        with self._news:
            self._waiting += seen.get(PUBLISHED, 0) - seen.get(CONSUMED, 0)
        name = p.name or str(p.id)
        total = (self._lines[name].rows if name in self._lines else 0) + max(0, p.numInputRows)
        self._put(_Line(name, "running" if p.numInputRows > 0 else "idle", p.batchId, total, p.timestamp))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        name = self._names.get(str(event.runId), str(event.id))
        if name in self._lines:
            self._put(replace(self._lines[name], state="idle", at=event.timestamp))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        name = self._names.pop(str(event.runId), str(event.id))
        self._put(replace(self._lines.get(name, _Line(name, "")), state="stopped" if event.exception is None else "failed", error=event.exception))

    def wait_for(self, what: Callable[[dict[str, str], int], bool], seconds: float = 60.0) -> bool:
        """Whether (state of each stream, queue's length) became so in time."""
        with self._news:
            return self._news.wait_for(lambda: what({n: x.state for n, x in self._lines.items()}, self._waiting), seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each stream: name, state, batch, rows, at, error."""
        schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("state", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("at", T.StringType()), T.StructField("error", T.StringType())])
        with self._news:
            lines = [(x.name, x.state, x.batch, x.rows, x.at, x.error) for x in self._lines.values()]
        return spark.createDataFrame(lines, schema)

    def status(self, spark: SparkSession) -> DataFrame:
        """status (failed, running or idle: the first that any stream is) and queueLength, as the status route shows them."""
        with self._news:
            waiting = self._waiting
        state = F.when(F.max(F.col("state") == "failed"), "failed").when(F.max(F.col("state") == "running"), "running").otherwise("idle")
        return self.table(spark).agg(state.alias("status"), F.lit(waiting).cast("long").alias("queueLength"))
