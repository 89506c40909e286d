"""From feed pages to tasks: the checkpoint of each feed is the state of a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Config, config
from ..schemas import TASK
from ..sources.feed import in_categories, page_entries, page_error
from ..sources.feed import tasks as feed_tasks
from .sink import registered
from .supervise import PUBLISHED

#: Topics of the queue: tasks, and what went wrong with pages.
TASKS, ERRORS = "tasks", "errors"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FeedCheckpoints(StatefulProcessor):
    """Of each feed: the new entries of its polls, oldest first, and how far it has been read.

    The state is the time of the entry that was sent last, by position. A poll with a page that failed sends nothing and
    leaves the state, so that what the page held comes with the next poll.
    """

    def __init__(self, page: int):
        self._page = page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._at = handle.getValueState("checkpoint", "at string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        polls: dict[int, list[Row]] = {}
        for row in rows:  # a poll is bounded by its pages
            polls.setdefault(row["poll"], []).append(row)
        found = self._at.get()
        before = found[0] if found else None
        for poll in sorted(polls):
            failed = [r for r in polls[poll] if r["error"] is not None]
            for r in failed:
                yield Row(topic=ERRORS, value=json.dumps({"feed": key[0], "poll": poll, "page": r["n"], "error": r["error"]}))
            if failed:
                continue
            entries = [r for r in polls[poll] if r["value"] is not None]
            place = lambda r: (r["n"], r["k"])
            newest = sorted(sorted(entries, key=place), key=lambda r: r["published"] or "", reverse=True)
            newest = newest[: self._page * (1 + max(r["n"] for r in polls[poll]))]
            fresh = [r for r in newest if not before or (r["published"] is not None and r["published"] > before)]
            fresh.sort(key=place, reverse=True)
            for r in fresh:
                yield Row(topic=TASKS, value=r["value"])
            if fresh:
                before = fresh[-1]["published"] or before
        if before is not None:
            self._at.update((before,))

    def close(self) -> None:
        pass


def polled(pages: DataFrame, settings: Config) -> DataFrame:
    """Lines (topic, value) of a stream of pages: its new tasks and its errors."""
    wanted = [c for c in settings.categories.split(",") if c]
    judged = pages.withColumn("error", page_error(F.col("page"), F.col("error")))
    # one row for each entry, and one for a page without any; where it comes from and the error go along as its place
    each = judged.select("feed", "poll", "n", "error", F.posexplode_outer(F.when(F.col("error").isNull(), page_entries(F.col("page")))).alias("k", "e"))
    rows = feed_tasks(each.select("e.*", F.struct("feed", "poll", "n", "error", "k").alias("pos")))
    if wanted:
        rows = rows.where(in_categories(F.col("categories"), wanted) | F.col("pos")["k"].isNull())
    task = F.when(F.col("pos")["k"].isNotNull(), F.to_json(F.struct(*(f.name for f in TASK if f.name in rows.columns))))
    lines = rows.select("pos.*", "published", task.alias("value"))
    return lines.groupBy("feed").transformWithState(FeedCheckpoints(settings.feed_page), "topic string, value string", "Append", "None")


def poll_stream(pages: DataFrame, queue: str, checkpoint: str, once: bool = False, settings: Config | None = None, name: str = "polls") -> StreamingQuery:
    """Poll feeds, each micro-batch one poll of each: new tasks go to the queue's topic, then the checkpoints move.

    ``pages`` is a stream of feed pages, or a union of several feeds'. Tasks of a batch appear together and once; polls are
    ``poll_seconds`` apart.
    """
    settings = settings or config(pages.sparkSession)
    spark = pages.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    lines = polled(pages, settings).observe(PUBLISHED, F.count_if(F.col("topic") == TASKS).alias("n"))
    writer = lines.writeStream.queryName(name).format(registered(spark)).option("path", queue).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{settings.poll_seconds} seconds")).start()
