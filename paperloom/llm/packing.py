"""Bounded-space online packing of token sequences.

Each partition keeps ``open_windows`` windows open. A piece goes into the window that it fills best;
when none has room, the fullest window is emitted and a new one opened. What is open when a
partition ends is merged at last, again by best fit, over tasks of bounded size.

A text longer than a window must be cut anyway, so its first piece closes the fullest window that
is open, whole windows follow, and only its remainder is placed. Texts that fit are never cut.

Defined results: a null or empty text is its end id alone; rows with equal or null ids are packed
as documents of their own; no rows make no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_small_batches, materialize, strings
from .tokens import default_tokenizer, encoder

WINDOW = 1024
OPEN_WINDOWS = 64
#: A gap smaller than this isn't worth a cut.
LEAST_CUT = 16
#: Pieces that one task merges at last.
MERGE_PIECES = 20_000
#: Sequences of the merging tasks are numbered from here on, above any partition's.
MERGED = 1 << 61
BATCH_DOCS = 256

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [x.split()[0] for x in PIECE.split(", ")]


class OpenWindows:
    """At most ``limit`` windows; the emitted ones are lists of pieces (tuples whose third is a length)."""

    def __init__(self, size: int = WINDOW, limit: int = OPEN_WINDOWS):
        self.size, self.limit = size, limit
        self._windows: dict[int, list] = {}
        self._gaps: list[tuple[int, int]] = []  # (room left, window), ascending: the fullest first
        self._next = 0

    def fullest_gap(self) -> int:
        return self._gaps[0][0] if self._gaps else 0

    def place(self, piece: tuple) -> Iterator[list]:
        """Best fit; yields the windows that this closes."""
        length = piece[2]
        at = bisect_left(self._gaps, (length, -1))
        if at < len(self._gaps):
            gap, window = self._gaps.pop(at)
        else:
            if len(self._gaps) >= self.limit:
                yield self._windows.pop(self._gaps.pop(0)[1])
            gap, window = self.size, self._next
            self._windows[window] = []
            self._next += 1
        self._windows[window].append(piece)
        if gap == length:
            yield self._windows.pop(window)
        else:
            insort(self._gaps, (gap - length, window))

    def rest(self) -> Iterator[list]:
        yield from (self._windows[w] for _, w in self._gaps)
        self._windows, self._gaps = {}, []


def cuts(n: int, size: int, gap: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: at most ``size`` each, the first to fill ``gap``."""
    at = 0
    if n > size and gap >= LEAST_CUT:
        yield 0, gap
        at = gap
    while at < n:
        yield at, min(size, n - at)
        at += min(size, n - at)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_FIELDS)


def _numbered(window: list[tuple], sequence: int | None) -> Iterator[tuple]:
    offset = 0
    for piece in window:
        yield (*piece, sequence, offset)
        offset += piece[2]


def pack(docs: DataFrame, size: int = WINDOW, open_windows: int = OPEN_WINDOWS, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of all documents (doc_id, text) and their places in sequences of ``size`` tokens.

    Only the few columns of the pieces are kept; the corpus isn't shuffled. They are written once
    (texts are tokenized once); the open windows, at most ``open_windows`` a partition, are merged.
    """
    tokenizer = tokenizer or default_tokenizer()

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows = encoder(tokenizer).encode, OpenWindows(size, open_windows)
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, len(batch), BATCH_DOCS):
                some, out = batch.slice(at, BATCH_DOCS), []
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(list(strings(some.column(1))), end_id), strict=True):
                    n = len(ids) // 4
                    for start, length in cuts(n, size, windows.fullest_gap()):
                        for full in windows.place((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n)):
                            out.extend(_numbered(full, sequence))
                            sequence += 1
                yield _batch(out)
        yield _batch([x for window in windows.rest() for x in _numbered(window, None)])

    placed = materialize(in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(place, PIECE), "packed")
    left = placed.where("sequence_id is null")
    tasks = max(1, -(-left.count() // MERGE_PIECES))

    def merge(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = [x for f in frames for x in f[_FIELDS[:5]].itertuples(index=False, name=None)]
        pieces.sort(key=lambda x: (-x[2], -1 if pd.isna(x[0]) else x[0], x[1]))
        windows, sequence = OpenWindows(size, len(pieces) + 1), MERGED + (TaskContext.get().partitionId() << 36)
        full = [w for p in pieces for w in windows.place(p)]
        rows = [x for k, w in enumerate([*full, *windows.rest()]) for x in _numbered(w, sequence + k)]
        yield pd.DataFrame({f: pd.array([None if pd.isna(r[i]) else int(r[i]) for r in rows], dtype="Int64") for i, f in enumerate(_FIELDS)})

    return placed.where("sequence_id is not null").unionByName(left.repartition(tasks).mapInPandas(merge, PIECE))
