"""Streams of tasks, through all states of their papers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import Config, config
from ..functions.documents import event_json
from ..plans.ingest import State, added, process, touched
from ..schemas import EDGES, EVENTS, NODES, PAPERS, TASK, empty
from ..sources.fetch import Fetch, Limits, Open, fetched, open_address
from ..sources.models import Ask, Embed
from .sink import publish, registered
from .supervise import CONSUMED
from .tables import Keyed, KeyedTables

#: The topic of the events.
EVENT_TOPIC = "events"


def paper_tables(spark: SparkSession, root: str, buckets: int = 64, keep: int = 20) -> KeyedTables:
    """The stored papers, nodes and edges. All nodes of papers with one id lie together, whatever their titles."""
    tables = {"papers": Keyed(PAPERS, ["id"]), "nodes": Keyed(NODES, ["element_id"], "coalesce(props['id'], element_id)"), "edges": Keyed(EDGES, ["src", "dst", "type"])}
    return KeyedTables(spark, root, tables, buckets, keep)


# -- from tasks to papers


@dataclass(frozen=True)
class Enrichment:
    """What carries a task beyond its first state: models, where each batch works, where texts are put, how sources are opened."""

    ask: Ask
    embed: Embed
    work: str
    store: str | None = None
    open: Open = open_address
    tasks: int | None = None  # that fetch at a time

    def fetch(self, settings: Config) -> Fetch:
        limits = Limits(settings.fetch_attempts, settings.fetch_wait, settings.fetch_seconds, in_flight=settings.fetch_in_flight)
        return lambda requests: fetched(requests, self.open, limits, self.tasks)


def task_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """JSON tasks as they arrive; records that are no task have a null id and go to quarantine, as they are, in ``unread``.

    ``origin`` says where in the queue a task stands: its file's time and name, and the part of the file.
    """
    lines = T.StructType([*TASK, T.StructField("unread", T.StringType())])
    tasks = spark.readStream.schema(lines).option("columnNameOfCorruptRecord", "unread").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").json(path)
    file = F.col("_metadata")
    return tasks.select("*", F.struct(file["file_modification_time"].alias("time"), file["file_path"].alias("file"), file["file_block_start"].alias("part")).alias("origin"))


def ingest(
    tasks: DataFrame, store: KeyedTables, checkpoint: str, once: bool = True, enrich: Enrichment | None = None, after: Callable[[State, int], None] | None = None, events: str | None = None, settings: Config | None = None, name: str = "ingest"
) -> StreamingQuery:
    """Keep papers, nodes and edges up to date; each batch reads and writes only the buckets of its own keys.

    With ``enrich`` a batch goes through all states, and of its sources each is opened once. ``events`` is a folder of
    topics that gets the batch's events, together and once. ``after`` gets each batch's rows, events and quarantine.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now_settings = settings or config(spark)
        # of one id the task that stands first in the queue wins; numbers only order rows of one part of a file
        rows = batch.withColumn("n", F.monotonically_increasing_id())
        rows = rows.withColumn("arrival", F.struct(*(["origin"] if "origin" in batch.columns else []), "n")).drop("origin", "n")
        own = rows.where("id is not null").select("id", F.create_map(F.lit("id"), "id").alias("props"), F.lit(None).cast("string").alias("element_id"))
        stored = {name: store.read(name, batch_id, store.touched(name, own)) for name in ("papers", "nodes")}
        before = touched(State(stored["papers"], stored["nodes"], empty(spark, EDGES), empty(spark, EVENTS)), rows)
        if enrich:
            now = process(before, rows, enrich.fetch(now_settings), enrich.ask, enrich.embed, f"{enrich.work.rstrip('/')}/batch={batch_id}", now_settings, enrich.store, batch_id)
        else:
            now = added(before, rows, "arrival")
        store.write(batch_id, {"papers": now.papers, "nodes": now.nodes, "edges": now.edges})
        if events:
            publish(now.events.select(F.lit(EVENT_TOPIC).alias("topic"), event_json(F.col("event"), F.col("id"), F.col("title")).alias("value")), events, batch_id)
        if after:
            after(now, batch_id)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # its parts are read many times, and counted once
        try:
            apply(batch, batch_id)
        finally:
            batch.unpersist()

    tasks = tasks.observe(CONSUMED, F.count("*").alias("n"))
    registered(tasks.sparkSession)  # before the stream takes its copy of the session
    writer = tasks.writeStream.queryName(name).foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
