"""Requests allowed or denied: a client's window begins with its first request after the window before it.

Which requests begin windows depends on all earlier ones of the client, so time is cut into slots that
tasks take one by one, whatever client they are of. A slot tells for each time at which the window before it may end,
where the windows that follow take it (their ends soon coincide); these few numbers are followed from slot to slot
for each client, and with what enters it each slot then deals out its windows. A client with many requests is so many slots.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Windows that a slot is long.
SLOT_WINDOWS = 16
NEVER = -(2**62)


def ways_through(times: list[int], span: int, latest: int) -> tuple[list[int], list[int]]:
    """Where windows lead through a slot: an open window that ends at or before ``upto[k]`` (and after ``upto[k - 1]``) leads to ``out[k]``.

    times: of the slot's requests, in order; span: of a window; latest: the last time at which a
    window from before may end. An open window that ends after the last ``upto`` leads to its own end.
    """
    after, out = [0] * len(times), len(times)
    for k in range(len(times) - 1, -1, -1):
        while out > k + 1 and times[out - 1] >= times[k] + span:
            out -= 1
        after[k] = times[k] + span if out == len(times) else after[out]
    upto: list[int] = []
    ends: list[int] = []
    for t, end in zip(times, after, strict=True):
        if upto and t > latest and upto[-1] >= latest:
            break
        if ends and ends[-1] == end:
            upto[-1] = t
        else:
            upto.append(t)
            ends.append(end)
    return upto, ends


def _slots(rows: Iterable[tuple]) -> Iterator[tuple[str, int, list[tuple]]]:
    for (client, slot), some in groupby(rows, key=lambda r: r[:2]):
        yield client, slot, list(some)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def rate_decisions(requests: DataFrame, client: str, at: str, key: str, seconds: int, limit: int) -> DataFrame:
    """``requests`` with window_start, nth (its place in the window) and allowed, of each row with a client and a time.

    Requests count in the order of their time, equal ones by ``key``. A window lasts ``seconds`` from its first
    request; one that comes at its very end begins the next. Rows without client or time are not limited and don't
    appear; equal rows count each. A slot of one client (``SLOT_WINDOWS`` windows) is held by one task.
    """
    span, length = seconds * 1_000_000, SLOT_WINDOWS * seconds * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = requests.where(F.col(client).isNotNull() & F.col(at).isNotNull()).select(F.struct(*requests.columns).alias("row"), F.col(client).cast("string").alias("client"), micros.alias("t"), F.col(key).alias("key"))
    rows = rows.withColumn("slot", F.expr(f"t div {length} - cast(t % {length} < 0 as int)"))

    def ways(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("client", pa.string()), ("slot", pa.int64()), ("upto", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
        yield from _batches(((c, s, *ways_through([r[2] for r in some], span, s * length + span)) for c, s, some in _slots(_rows(batches))), schema)

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple]:
            of, end = None, NEVER
            for c, slot, upto, ends in _rows(batches):
                if c != of:
                    of, end = c, NEVER
                yield c, slot, end
                k = bisect_left(upto, end)
                end = ends[k] if k < len(ends) else end

        yield from _batches(entries(), pa.schema([("client", pa.string()), ("slot", pa.int64()), ("enters", pa.int64())]))

    def starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for c, slot, some in _slots(_rows(batches)):
                end = some[0][3]
                begin = end - span if end > NEVER else None
                for _, _, t, _ in some:
                    if t >= end:
                        begin, end = t, t + span
                    yield c, slot, t, begin

        yield from _batches(found(), pa.schema([("client", pa.string()), ("slot", pa.int64()), ("t", pa.int64()), ("begin", pa.int64())]))

    # equal times have one window, so the times alone are passed through the tasks
    times = rows.select("client", "slot", "t").distinct()
    dealt = times.repartition("client", "slot").sortWithinPartitions("client", "slot", "t")
    entered = dealt.mapInArrow(ways, "client string, slot long, upto array<long>, ends array<long>").repartition("client").sortWithinPartitions("client", "slot").mapInArrow(follow, "client string, slot long, enters long")
    begun = times.join(entered, ["client", "slot"]).repartition("client", "slot").sortWithinPartitions("client", "slot", "t").mapInArrow(starts, "client string, slot long, t long, begin long")
    nth = F.row_number().over(Window.partitionBy("client", "begin").orderBy("t", "key"))
    placed = rows.join(begun, ["client", "slot", "t"]).withColumn("nth", nth.cast("long"))
    start = F.timestamp_micros("begin").cast(requests.schema[at].dataType)
    return placed.select("row.*", start.alias("window_start"), "nth", (F.col("nth") <= limit).alias("allowed"))
