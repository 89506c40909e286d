"""Which names stand somewhere in texts, exactly, without a row for each piece of a text and without sending texts.

The names go to every task as a table of bits, of bounded size whatever the number of names: one bit for the first
``HEAD`` bytes of a name and two for the whole of it, by hashes. A task goes through its texts' bytes in numpy and
keeps the places whose bits are all set; what stands there is sent, once a task, and joined with the names. The bits only
sieve: what they let through wrongly, more with very many names, ends at the join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import in_small_batches

#: Bytes read at once as one number.
HEAD = 8
#: Of longer names so many bytes, and their last ones, are hashed.
HASHED = 64
#: The table has so many bits for each name, within these powers of two (at most 16 MB).
NAME_BITS, LEAST_BITS, MOST_BITS = 64, 16, 27
#: Bytes of texts looked at together; found names that a task remembers as sent.
CHUNK, REMEMBERED = 1 << 20, 200_000
#: Bits of one value of Spark's bitmap functions.
_PAGE = 32768
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _numbers(data: np.ndarray, n: int) -> np.ndarray:
    """The ``HEAD`` bytes from each of the first n places on, as numbers; beyond the end stand zeros."""
    padded = np.zeros(n + HEAD, np.uint8)
    padded[: len(data)] = data[: n + HEAD]
    return np.ndarray((n,), "<u8", padded, strides=(1,)).astype(np.uint64)


def _code(numbers: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place of ``at`` on."""
    code = numbers[at]
    if size < HEAD:
        return code & np.uint64((1 << 8 * size) - 1)
    for k in [*range(HEAD, min(size, HASHED) - HEAD, HEAD), size - HEAD]:
        code = (code ^ code >> np.uint64(29)) * _MIX ^ numbers[at + k]
    return code


def _bit(code: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """The bit of hashes; ``kind`` is the bytes' number (negative for their second bit), 0 for the heads of names."""
    mixed = (code ^ np.uint64(kind * int(_MIX2) % 2**64)) * _MIX
    return ((mixed ^ mixed >> np.uint64(32)) * _MIX2 >> np.uint64(64 - bits)).astype(np.int64)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes without gaps, and where its values begin and end."""
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def _name_bits(bits: int):
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = _bytes(batch.column(0))
            numbers, sizes = _numbers(data, len(data)), np.diff(starts)
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = starts[:-1][sizes == size]
                code = _code(numbers, at, size)
                found = [_bit(code, size, bits), _bit(code, -size, bits)]
                if size >= HEAD:
                    found.append(_bit(numbers[at], 0, bits))
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["bit"])

    return of


def _found(data: np.ndarray, starts: np.ndarray, sizes: list[int], table: np.ndarray, bits: int) -> Iterator[bytes]:
    """What of the texts may be a name of one of these sizes (from 1 on), each once a chunk."""
    seen = lambda code, kind: (table[(bit := _bit(code, kind, bits)) >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
    longest, short = max(sizes), [s for s in sizes if s < HEAD]
    for begin in range(0, len(data), CHUNK):
        n = min(CHUNK, len(data) - begin)
        part = data[begin : begin + n + longest + HEAD]
        numbers, raw = _numbers(part, n + longest), part.tobytes()
        # how much of its text a place has before it
        left = lambda at: starts[np.searchsorted(starts, at + begin, "right")] - begin - at  # noqa: B023,E731
        places = np.arange(n)
        for size in short:
            code = _code(numbers, places, size)
            at = np.flatnonzero(seen(code, size))
            at = at[seen(code[at], -size)]
            at = at[left(at) >= size]
            yield from (c.to_bytes(HEAD, "little")[:size] for c in np.unique(code[at]).tolist())
        if len(short) == len(sizes):
            continue
        heads = np.flatnonzero(seen(numbers[:n], 0))
        rest = left(heads)
        for size in sizes[len(short) :]:
            at = heads[rest >= size]
            code = _code(numbers, at, size)
            at = at[seen(code, size) & seen(code, -size)]
            yield from {raw[k : k + size] for k in at.tolist()}


def _look_up(sizes: list[int], table: bytes, bits: int):
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit_table, sent = np.frombuffer(table, np.uint8), set()
        for batch in batches:
            new = {b""} if 0 in sizes and len(batch) else set()
            if any(sizes):
                new.update(_found(*_bytes(batch.column(0)), [s for s in sizes if s], bit_table, bits))
            new -= sent
            if len(sent) + len(new) > REMEMBERED:
                sent = set()
            sent |= new
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary())], names=["found"])

    return of


def names_within(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``names`` (one column of distinct strings, none null, read four times) those that a text contains."""
    spark = names.sparkSession
    name, text = names.columns[0], texts.columns[0]
    sizes = {r["size"]: r["n"] for r in names.groupBy(F.octet_length(name).alias("size")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return names
    bits = min(MOST_BITS, max(LEAST_BITS, (NAME_BITS * sum(sizes.values())).bit_length()))
    # Spark's bitmaps count from 1
    set_bits = names.select(F.col(name).cast("binary").alias("name")).mapInArrow(_name_bits(bits), "bit long").select((F.col("bit") + 1).alias("bit"))
    table = bytearray(1 << bits - 3)
    for page in set_bits.groupBy(F.bitmap_bucket_number("bit").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toLocalIterator():
        table[(page["page"] - 1) * _PAGE // 8 : page["page"] * _PAGE // 8] = page["bits"]
    given = texts.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("text"))
    found = in_small_batches(given).mapInArrow(_look_up(sorted(sizes), bytes(table), bits), "found binary").distinct()
    return names.join(found, F.col(name).cast("binary") == F.col("found"), "left_semi")
