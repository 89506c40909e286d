"""Bytes by address, fetched inside the tasks: only what is asked for is opened.

A request is a row (id, address). Each task keeps a bounded number of calls in flight and hands results
on in the order of its rows; what fails, fails for its own row, with the reason beside it.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import urlsplit
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From an address and the seconds a call may wait to something readable; an exception is a failed attempt.
Open = Callable[[str, float], BinaryIO]
#: From requests (id, address) to id, content and error.
Fetch = Callable[[DataFrame], DataFrame]

CHUNK = 1 << 20
#: Fetched bytes that one Arrow batch holds, but for a single object's own.
BATCH_BYTES = 32 << 20


@dataclass(frozen=True)
class Limits:
    """Of one object: attempts, the wait before the second (doubled each time), seconds and bytes; of a task: calls in flight."""

    attempts: int = 3
    wait: float = 5.0
    seconds: float = 30.0
    most_bytes: int = 256 << 20
    in_flight: int = 4


def open_address(address: str, seconds: float) -> BinaryIO:
    """http and https by the standard library, anything else as a path or URI of a file system that Arrow knows."""
    if urlsplit(address).scheme in ("http", "https"):
        return urlopen(address, timeout=seconds)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)
    return system.open_input_stream(path)


def _read(opened: BinaryIO, limits: Limits, deadline: float) -> bytes:
    parts, size = [], 0
    while chunk := opened.read(CHUNK):
        size += len(chunk)
        if size > limits.most_bytes:
            raise ValueError(f"more than {limits.most_bytes} bytes")
        if time.monotonic() > deadline:
            raise TimeoutError(f"more than {limits.seconds} seconds")
        parts.append(chunk)
    return b"".join(parts)


def fetch_one(address: str | None, open_one: Open, limits: Limits, sleep: Callable[[float], None] = time.sleep) -> tuple[bytes | None, str | None, int]:
    """Content, error and attempts. An object that is too large isn't asked for again."""
    if not address:
        return None, "no address", 0
    for attempt in range(1, limits.attempts + 1):
        try:
            opened = open_one(address, limits.seconds)
            try:
                return _read(opened, limits, time.monotonic() + limits.seconds), None, attempt
            finally:
                opened.close()
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if attempt == limits.attempts or isinstance(e, ValueError):
                return None, error, attempt
            sleep(limits.wait * 2 ** (attempt - 1))
    return None, "no attempt", 0


def fetched(requests: DataFrame, open_one: Open = open_address, limits: Limits | None = None, tasks: int | None = None) -> DataFrame:
    """requests (id, address): id, content, error and attempts of each row.

    ``tasks`` times ``limits.in_flight`` bounds the calls in flight. A task holds the objects of its
    calls and of one batch; an object is at most ``limits.most_bytes`` long. A null address is an error
    without a call; repeated rows are fetched again; an empty table gives no rows and opens nothing.
    """
    limits = limits or Limits()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, bytes | None, str | None, int]] = []
        size = 0
        with ThreadPoolExecutor(limits.in_flight) as pool:
            waiting: deque[tuple[str, Future]] = deque()

            def take() -> int:
                key, call = waiting.popleft()
                content, error, attempts = call.result()
                done.append((key, content, error, attempts))
                return len(content or b"")

            for batch in batches:
                for key, address in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    waiting.append((key, pool.submit(fetch_one, address, open_one, limits)))
                    if len(waiting) >= limits.in_flight:
                        size += take()
                    if size > BATCH_BYTES:
                        yield _batch(done)
                        done, size = [], 0
            while waiting:
                size += take()
                if size > BATCH_BYTES:
                    yield _batch(done)
                    done, size = [], 0
        yield _batch(done)

    rows = requests.select(F.col("id").cast("string").alias("id"), F.col("address").cast("string").alias("address"))
    return (rows.repartition(tasks) if tasks else rows).mapInArrow(run, "id string, content binary, error string, attempts int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = {"id": pa.string(), "content": pa.binary(), "error": pa.string(), "attempts": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))
