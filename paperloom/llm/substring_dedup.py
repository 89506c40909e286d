"""Repeated word sequences across documents, found by FM-indexes over shards of the corpus.

A window is ``size`` consecutive words. Equal windows have the same anchor, the least code of the
``ANCHOR``-word runs inside, so shards by anchor can be searched alone, and each passage goes only
where it can match:

1. Documents are written in chunks of about ``CHUNK_BYTES``; each chunk sends each of its distinct
   anchors once to the anchor's shard, which answers whether other chunks have it, and whether many do.
2. Each chunk sends the passages whose anchors recur (runs of windows with one anchor), each distinct
   passage once with its least document, to the shards. Windows of an anchor that many chunks have are
   told apart by their next least run too, so a frequent run spreads over shards.
3. A shard builds a compressed FM-index (runs of the last column, under a wavelet tree) of its distinct
   passages and streams every passage through it: matching statistics by backward search give, for
   each end, the longest match and its interval. Where it reaches ``size`` words the least document of
   the interval is reported, as intervals of the passage.
4. Each chunk marks the words of windows whose least document is smaller than their own.

The number of shards grows with the bytes of the corpus (``SHARD_BYTES``), so an index doesn't. A
passage in a third of all documents is sent once for each chunk, never once for each document; answers
go to chunks, so no key gathers rows. Words are told apart by 48 bits of a hash in shards, and equal
passages by 64 bits of a hash of these and their length.

Defined results: null, empty and short texts lose nothing; rows with equal ids don't remove from
each other; rows without an id rank after all others; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .shared import Scratch, shuffle_partitions, strings
from .words import codes_of, mixed

WINDOW = 13
ANCHOR = 4
CHUNK_BYTES = 2 << 20
#: Text for which there is a shard.
SHARD_BYTES = 16 << 20
#: An anchor in more chunks is split.
MANY_CHUNKS = 256
#: A row without an id ranks after all others.
NO_ID = np.iinfo(np.int64).max
_LOW48 = np.uint64(0xFFFFFFFFFFFF)


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(struct.pack("<Q", a.nbytes) + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for dtype in dtypes:
        (n,) = struct.unpack_from("<Q", raw, at)
        out.append(np.frombuffer(raw, dtype, n // np.dtype(dtype).itemsize, at + 8))
        at += 8 + n
    return out


# -- chunks


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (chunk, docs, size): many whole documents, compressed together, and their bytes."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, known, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], np.int64)
            blob = _pack(np.array(ids, np.int64), np.array(known, np.uint8), lengths, np.frombuffer(b"".join(texts), np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([blob], pa.binary()), pa.array([size], pa.int64())], names=["chunk", "docs", "size"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                ids.append(doc_id or 0)
                known.append(doc_id is not None)
                texts.append((text or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield row()
                    chunk, ids, known, texts, size = chunk + 1, [], [], [], 0
        if ids:
            yield row()

    return docs.mapInArrow(gather, "chunk long, docs binary, size long")


class Chunk:
    """Documents of a chunk, their words, and their windows in runs that share an anchor."""

    def __init__(self, blob: bytes, size: int):
        self.size = size
        self.ids, self.known, lengths, text = _unpack(blob, "<i8", "u1", "<i8", "u1")
        raw, at, self.words = text.tobytes(), 0, []
        for n in lengths.tolist():
            self.words.append(raw[at : at + n].split())
            at += n
        counts = np.array([len(w) for w in self.words], np.int64)
        self.codes = np.concatenate([np.zeros(0, np.uint64), *(codes_of(w) for w in self.words)]) & _LOW48
        self.ends = np.cumsum(counts)
        doc = np.repeat(np.arange(len(counts)), counts)
        n = len(self.codes) - size + 1
        if n < 1:
            starts = np.zeros(0, np.int64)
            anchors = np.zeros(0, np.uint64)
        else:
            starts = np.flatnonzero(doc[:n] == doc[size - 1 :])
            anchors = _anchors(self.codes, size)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) != 1) | (anchors[1:] != anchors[:-1])
        first = np.flatnonzero(new)
        self.start = starts[first]  # of each run's first window
        self.windows = np.diff(np.append(first, len(starts)))
        self.anchor = anchors[first]
        self.doc = doc[self.start] if len(first) else np.zeros(0, np.int64)
        self.owner = np.where(self.known.astype(bool), self.ids, NO_ID)[self.doc] if len(first) else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order, and which of them belong to several documents here."""
        distinct, at = np.unique(self.anchor, return_inverse=True)
        low, high = np.full(len(distinct), NO_ID), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, at, self.owner)
        np.maximum.at(high, at, self.owner)
        return distinct, low < high

    def passages(self, recurs: np.ndarray, many: np.ndarray, shards: int) -> Passages:
        """Passages of the distinct anchors that recur; those of anchors that many chunks have are cut where the next least run changes."""
        distinct = np.unique(self.anchor)
        at = np.searchsorted(distinct, self.anchor)
        runs = np.flatnonzero(recurs[at]) if len(distinct) else np.zeros(0, np.int64)
        start, windows, route, owner = self.start[runs], self.windows[runs], self.anchor[runs], self.owner[runs]
        if len(runs) and many.any():
            where, inside = _spread(start, windows)
            of = np.repeat(np.arange(len(runs)), windows)
            feature = np.repeat(route, windows)
            split = many[at[runs]][of]
            feature[split] = mixed(feature[split] ^ mixed(_anchors(self.codes, self.size, besides=True)[where[split]]))
            cut = np.flatnonzero((inside == 0) | np.concatenate([[True], feature[1:] != feature[:-1]]))
            start, route, owner = where[cut], feature[cut], owner[of[cut]]
            windows = np.diff(np.append(cut, len(where)))
        length = windows + self.size - 1
        where, inside = _spread(start, length)
        content = np.add.reduceat(mixed(self.codes[where] ^ mixed(inside.astype(np.uint64) + np.uint64(1))), np.cumsum(length) - length) if len(start) else np.zeros(0, np.uint64)
        key = np.rec.fromarrays([shard_of(route, shards), content, length])
        found, first, of = np.unique(key, return_index=True, return_inverse=True)
        least = np.full(len(found), NO_ID)
        np.minimum.at(least, of, owner)
        return Passages(start, windows, owner, of, first, least, np.asarray(found.f0, np.int64))


@dataclass
class Passages:
    """Runs of windows (start, windows, owner), the distinct passage of each (``of``), and the passages:
    their first run, least owner and shard, in the order of shard, then content."""

    start: np.ndarray
    windows: np.ndarray
    owner: np.ndarray
    of: np.ndarray
    first: np.ndarray
    least: np.ndarray
    shard: np.ndarray


def _anchors(codes: np.ndarray, size: int, besides: bool = False) -> np.ndarray:
    """The least code of the ANCHOR-word runs in each window, or the least ``besides`` that one."""
    run = min(ANCHOR, size)
    n = len(codes) - run + 1
    grams = np.full(n, run, np.uint64)
    for k in range(run):
        grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    least = grams[: len(codes) - size + 1].copy()
    for k in range(1, size - run + 1):
        np.minimum(least, grams[k : k + len(least)], out=least)
    if not besides:
        return least
    second = np.full(len(least), np.iinfo(np.uint64).max, np.uint64)
    for k in range(size - run + 1):
        gram = grams[k : k + len(least)]
        np.minimum(second, gram, out=second, where=gram != least)
    return second


def _spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start, start + 1, ... of each piece, one after the other, and their places in the pieces."""
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(starts, lengths) + inside, inside


def shard_of(anchors: np.ndarray, shards: int) -> np.ndarray:
    # anchors are least codes and so lean to small values: mix before cutting the range
    return ((mixed(anchors) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


# -- the exchange between chunks and shards


def _by_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Rows (shard, chunk, blob), sorted by shard: each shard's chunks and blobs."""
    shard, chunks, blobs = None, [], []
    for batch in batches:
        for s, c, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if s != shard and chunks:
                yield shard, chunks, blobs
                chunks, blobs = [], []
            shard = s
            chunks.append(c)
            blobs.append(b)
    if chunks:
        yield shard, chunks, blobs


_EXCHANGE = "shard long, chunk long, blob binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, chunk, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(chunk, pa.int64()), pa.array(blob, pa.binary())], names=["shard", "chunk", "blob"])


def _ask(asked: DataFrame, answer, shards: int) -> DataFrame:
    """Send rows to their shards; what each shard answers, gathered for each chunk."""

    def serve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, chunks, blobs in _by_shard(batches):
            yield _rows([(shard, c, b) for c, b in zip(chunks, answer(blobs), strict=True)])

    served = asked.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "chunk").mapInArrow(serve, _EXCHANGE)
    # a chunk hears from each shard once: what it gathers is bounded by its own size
    return served.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "blob"))).alias("answers"))


def _seen_elsewhere(blobs: list[bytes]) -> Iterator[bytes]:
    anchors = [np.frombuffer(b, np.uint64) for b in blobs]
    distinct, counts = np.unique(np.concatenate(anchors), return_counts=True)
    for a in anchors:
        held = counts[np.searchsorted(distinct, a)]
        yield np.packbits(np.concatenate([held > 1, held > MANY_CHUNKS])).tobytes()


def _least_owners(blobs: list[bytes], size: int) -> Iterator[bytes]:
    """For each window of each passage the least owner of any passage of the shard that holds it."""
    parts = [_unpack(b, "<i8", "<i8", "u1") for b in blobs]
    length = np.concatenate([p[0] for p in parts])
    owner = np.concatenate([p[1] for p in parts])
    six = np.concatenate([p[2] for p in parts]).reshape(-1, 6)
    codes = np.zeros((len(six), 8), np.uint8)
    codes[:, :6] = six
    codes = codes.view("<u8").ravel()
    ends = np.cumsum(length)
    _, inside = _spread(ends - length, length)
    content = np.add.reduceat(mixed(codes ^ mixed(inside.astype(np.uint64) + np.uint64(1))), ends - length)
    key = np.rec.fromarrays([content, length])
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, of, owner)
    where, _ = _spread((ends - length)[first], length[first])
    index = FMIndex(codes[where], length[first], least, size)
    matched, low, high = index.matching_statistics(codes[where], length[first], size, indexed=True, least=size)
    # every window of the passages is in the index, so every end with enough room reaches the threshold
    at = np.flatnonzero(matched >= size)
    found = index.least_values(low[at], high[at])
    windows = length[first] - size + 1
    begins = np.cumsum(windows) - windows
    at = 0
    for p in parts:
        mine = of[at : at + len(p[0])]
        at += len(p[0])
        value = found[_spread(begins[mine], windows[mine])[0]]
        # as intervals of windows with one least owner
        cut = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        yield _pack(np.diff(np.append(cut, len(value))), value[cut])


def _recurring(chunk: Chunk, answers: list[dict], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Which distinct anchors of the chunk belong to several documents, here or elsewhere, and which to many chunks."""
    distinct, several = chunk.anchors()
    many = np.zeros(len(distinct), bool)
    shard = shard_of(distinct, shards)
    for a in answers or []:
        mine = np.flatnonzero(shard == a["shard"])
        bits = np.unpackbits(np.frombuffer(a["blob"], np.uint8), count=2 * len(mine)).astype(bool)
        several[mine] |= bits[: len(mine)]
        many[mine] = bits[len(mine) :]
    return several, many


def repeated_words(documents: DataFrame, size: int = WINDOW, shards: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of each row of ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(spark)
    chunks = scratch.table(chunked(docs), "chunks")
    size_of_all = chunks.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(shuffle_partitions(spark), -(-size_of_all // SHARD_BYTES))

    def send_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                distinct, _ = Chunk(blob.as_py(), size).anchors()
                shard = shard_of(distinct, shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                yield _rows([(int(shard[part[0]]), name, distinct[part].tobytes()) for part in np.split(order, cuts) if len(part)])

    seen = scratch.table(_ask(chunks.mapInArrow(send_anchors, _EXCHANGE), _seen_elsewhere, shards), "anchors")
    known = chunks.join(seen, "chunk", "left").select("chunk", "docs", F.col("answers").alias("seen"))

    def send_passages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                name, blob, answers = (batch.column(c)[k].as_py() for c in range(3))
                chunk = Chunk(blob, size)
                found = chunk.passages(*_recurring(chunk, answers, shards), shards)
                length = found.windows[found.first] + size - 1
                six = chunk.codes.view(np.uint8).reshape(-1, 8)[:, :6]
                rows = []
                for part in np.split(np.arange(len(length)), np.flatnonzero(np.diff(found.shard)) + 1):
                    if len(part):
                        where, _ = _spread(found.start[found.first[part]], length[part])
                        rows.append((int(found.shard[part[0]]), name, _pack(length[part], found.least[part], six[where])))
                yield _rows(rows)

    owners = scratch.table(_ask(known.mapInArrow(send_passages, _EXCHANGE), lambda blobs: _least_owners(blobs, size), shards), "owners")
    answered = known.join(owners, "chunk", "left").select("docs", "seen", F.col("answers").alias("owners"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                blob, seen_there, owners_there = (batch.column(c)[k].as_py() for c in range(3))
                chunk = Chunk(blob, size)
                gone = _removed(chunk, chunk.passages(*_recurring(chunk, seen_there, shards), shards), owners_there)
                texts, removed = [], []
                for words, end in zip(chunk.words, chunk.ends.tolist(), strict=True):
                    mask = gone[end - len(words) : end]
                    n = int(mask.sum())
                    texts.append(b" ".join([w for w, g in zip(words, mask.tolist(), strict=True) if not g] if n else words))
                    removed.append(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i if x else None for i, x in zip(chunk.ids.tolist(), chunk.known.tolist(), strict=True)], pa.int64()),
                        pa.array([len(w) for w in chunk.words], pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                        pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string()),
                    ],
                    names=[f.split()[0] for f in schema.split(", ")],
                )

    return answered.mapInArrow(remove, schema)


def _removed(chunk: Chunk, found: Passages, owners: list[dict] | None) -> np.ndarray:
    """Which words of the chunk are covered by a window that a smaller document holds."""
    marks = np.zeros(len(chunk.codes) + 1, np.int64)
    if len(found.start):
        # answers come by shard, passages are in the order of shards: they line up
        least = np.concatenate([np.repeat(value, n) for n, value in (_unpack(a["blob"], "<i8", "<i8") for a in owners)])
        windows = found.windows[found.first]
        begins = np.cumsum(windows) - windows
        value = least[_spread(begins[found.of], found.windows)[0]]
        where, _ = _spread(found.start, found.windows)
        where = where[value < np.repeat(found.owner, found.windows)]
        np.add.at(marks, where, 1)
        np.add.at(marks, where + chunk.size, -1)
    return np.cumsum(marks)[:-1] > 0
