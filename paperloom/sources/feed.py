"""Atom feeds: parsing, and the projection to tasks."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..config import config
from ..functions import text
from ..schemas import ENTRY
from .fetch import Open, open_address


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the feed files at ``path``, with their place as ``pos`` (newest first).

    The place is the file, the part of it that a task reads, and the entry's place there, so it
    doesn't depend on how files are dealt to tasks.
    """
    entries = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema(ENTRY).load(path)
    return entries.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("n")).alias("pos"))


def _feed(page: Column) -> Column:
    broken = "_broken"
    schema = T.StructType([T.StructField("entry", T.ArrayType(ENTRY)), T.StructField(broken, T.StringType())])
    return F.from_xml(page, schema, {"ignoreNamespace": "true", "rowTag": "feed", "columnNameOfCorruptRecord": broken})


def page_entries(page: Column) -> Column:
    """The entries of a page; null if there are none, or the page is broken."""
    return _feed(page)["entry"]


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Entries of feed pages (page, an XML text, and n, its place), with their place as ``pos``. See ``page_error``."""
    each = pages.select("n", F.posexplode(page_entries(F.col("page"))).alias("k", "e"))
    return each.select("e.*", F.struct("n", "k").alias("pos"))


def page_error(page: Column, error: Column) -> Column:
    """What is wrong with a page: its fetch failed, it breaks off or is no XML, or it is another document. Null if all is well."""
    return (
        F.when(error.isNotNull(), error)
        .when(page.isNull(), "no page")
        .when(_feed(page)["_broken"].isNotNull(), "the page is broken")
        .when(~page.rlike("<([A-Za-z0-9_.-]+:)?feed[\\s>/]"), "the page is no feed")
    )


def feed_query(terms: list[str], page: int = 100, start: int = 0) -> str:
    """What is asked of the service: any of the categories, the newest first."""
    wanted = "+OR+".join(f"cat:{t}" for t in terms)
    return f"search_query={wanted}&sortBy=submittedDate&sortOrder=descending&start={start}&max_results={page}"


def in_categories(categories: Column, wanted: list[str]) -> Column:
    """The same predicate on records that are here already."""
    return F.coalesce(F.arrays_overlap(categories, F.array(*map(F.lit, wanted))), F.lit(False))


def _link() -> Column:
    """The alternate link, or the first."""
    alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.get(alternate, F.lit(0)), F.get("link", F.lit(0)))["_href"]


def _common() -> dict[str, Column]:
    return {
        "id": text.last_segment(F.col("id")),
        "title": text.one_line(F.col("title")),
        "authors": F.transform("author", lambda a: a["name"]),
        "published": F.col("published"),
        "updated": F.coalesce("updated", "published"),
        "primary_category": F.col("primary_category._term"),
        "categories": F.coalesce(F.transform("category", lambda c: c["_term"]), F.array().cast("array<string>")),
        "summary_raw": F.col("summary"),
        "summary_detail": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
    }


def tasks(entries: DataFrame) -> DataFrame:
    """One task for each entry; the raw id and the position are kept beside it."""
    return entries.select(*(c.alias(k) for k, c in (_common() | {"source_url": text.source_url(_link())}).items()), F.col("id").alias("entry_url"), "pos")


def legacy_tasks(entries: DataFrame) -> DataFrame:
    """The earlier form: a pdf_url and no source_url."""
    return entries.select(*(c.alias(k) for k, c in (_common() | {"pdf_url": text.legacy_pdf_url(_link())}).items()), "pos")


#: From the first entry's number to a page's text; an exception is a failed attempt.
FetchPage = Callable[[int], str]


def http_pages(address: str, terms: list[str], page: int = 100, open_one: Open = open_address, seconds: float = 30.0) -> FetchPage:
    """The fetcher of a service: ``address`` is asked for the newest entries of the wanted categories."""

    def fetch(start: int) -> str:
        with open_one(f"{address}?{feed_query(terms, page, start)}", seconds) as answer:
            return answer.read().decode("utf-8")

    return fetch


def tried(fetch: FetchPage, start: int, attempts: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """A page and the last error: the fetch is made again after 5, 10, ... seconds when it raises.

    A timeout is the fetcher's own: it raises, and counts as an attempt.
    """
    error = "no attempt"
    for attempt in range(attempts):
        try:
            return fetch(start), None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < attempts:
                sleep(wait * 2**attempt)
    return None, error


@dataclass(frozen=True)
class Feed:
    """A polled feed. Each poll asks for ``pages`` pages of ``size`` entries, the newest first.

    ``log`` is a folder that driver and executors share: what a poll got, pages and errors, is kept
    there, so that a batch that is run again sees the same. The last ``keep`` polls stay.
    """

    name: str
    fetch: FetchPage
    log: str
    pages: int = 1
    size: int = 100
    attempts: int = 3
    wait: float = 5.0
    keep: int = 100

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.log) if "://" in self.log else (fs.LocalFileSystem(), self.log)

    def logged(self) -> dict[int, int]:
        """How many pages of each poll are in the log."""
        system, root = self._system()
        found: dict[int, int] = {}
        for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.base_name.endswith(".json"):
                poll = int(f.base_name.split("-")[0])
                found[poll] = found.get(poll, 0) + 1
        return found

    def page(self, poll: int, n: int) -> tuple[str | None, str | None]:
        """A poll's page and error: from the log, or fetched and logged. Of two tasks at once the first to finish counts."""
        system, root = self._system()
        path = f"{root}/{poll:012d}-{n}.json"
        if system.get_file_info(path).type == fs.FileType.NotFound:
            page, error = tried(self.fetch, n * self.size, self.attempts, self.wait)
            system.create_dir(root, recursive=True)
            draft = f"{path}.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(json.dumps({"page": page, "error": error}).encode())
            if system.get_file_info(path).type == fs.FileType.NotFound:
                system.move(draft, path)
            else:
                system.delete_file(draft)
        with system.open_input_stream(path) as f:
            kept = json.loads(f.read())
        return kept["page"], kept["error"]

    def forget(self, before: int) -> None:
        system, root = self._system()
        for poll in [p for p in self.logged() if p < before]:
            for n in range(self.pages):
                if system.get_file_info(path := f"{root}/{poll:012d}-{n}.json").type == fs.FileType.File:
                    system.delete_file(path)


@dataclass
class _PollPage(InputPartition):
    poll: int
    n: int


class FeedPolls(DataSource):
    """A streaming source of a feed's polls: each trigger is one poll, each page one task. See ``feed_pages``."""

    feed: Feed

    @classmethod
    def name(cls) -> str:
        return f"feed_polls_{cls.feed.name}"

    def schema(self) -> str:
        return "feed string, poll long, n long, page string, error string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Polls(self.feed)


class _Polls(DataSourceStreamReader):
    """Offsets count polls. A poll is behind an offset as soon as its pages are in the log."""

    def __init__(self, feed: Feed):
        self._feed = feed

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"poll": 2 + max((p for p, n in self._feed.logged().items() if n >= self._feed.pages), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_PollPage(poll, n) for poll in range(start["poll"], end["poll"]) for n in range(self._feed.pages)]

    def read(self, partition: _PollPage) -> Iterator[tuple]:
        page, error = self._feed.page(partition.poll, partition.n)
        yield self._feed.name, partition.poll, partition.n, page, error

    def commit(self, end: dict) -> None:
        self._feed.forget(end["poll"] - self._feed.keep)


def feed_pages(spark: SparkSession, feed: Feed) -> DataFrame:
    """A stream of a feed's pages: feed, poll, n (the page's place), page and error."""
    source = type("FeedPolls", (FeedPolls,), {"feed": feed})
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).load()


def configured_feed(spark: SparkSession, name: str, log: str, address: str, pages: int = 1, open_one: Open = open_address) -> Feed:
    """The feed of a service as the session's settings say: categories, page size, time limit, attempts and waits."""
    s = config(spark)
    fetch = http_pages(address, [c for c in s.categories.split(",") if c], s.feed_page, open_one, s.fetch_seconds)
    return Feed(name, fetch, log, pages, s.feed_page, s.fetch_attempts, s.fetch_wait)
