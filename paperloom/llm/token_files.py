"""Token-id files: independent zstandard frames, a trailing seek table and per-frame checksums.

One file holds the documents of one range of ids, about ``FILE_BYTES`` of them, in ascending order:

* data frames: the little-endian ids of one or more whole documents, about ``FRAME_BYTES`` raw;
* a skippable frame with the document index: per document its id, its frame and its ids' count;
* a skippable frame with the seek table of the public seekable format: per frame its compressed
  size, its raw size and the low 32 bits of the xxh64 of its raw bytes, then the footer.

A reader fetches the tail, and then only the frames of the documents it was asked for.

Defined results: a null text is empty (only the end id); rows with equal or null ids are all kept,
in the order of the id, nulls first, then of a hash of the text; no rows make no files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, new_path, strings
from .tokens import default_tokenizer, encoder

#: Fixed values of the zstandard formats: a skippable frame, the seek table's frame, its footer.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 128 * 1024
#: Ids' bytes of a file, at least of all but a task's last one; the next document begins another file.
FILE_BYTES = 256 << 20
BATCH_DOCS = 256
_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("n", "<u8")])
_SEEK = np.dtype([("compressed", "<u4"), ("raw", "<u4"), ("check", "<u4")])


class DamagedFile(ValueError):
    """A frame, the seek table or a checksum is not what the file says."""


def write_file(sink, docs: Iterable[tuple[int | None, bytes]], frame_bytes: int = FRAME_BYTES, item_bytes: int = 4) -> tuple[int, int]:
    """Write (id, ids' bytes) pairs; ids take ``item_bytes`` in the file. Documents and ids written."""
    compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)
    index, seek, held, size, total = [], [], [], 0, 0

    def flush() -> None:
        nonlocal held, size
        raw = b"".join(held)
        frame = compressor.compress(raw)
        sink.write(frame)
        seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        held, size = [], 0

    for doc_id, ids in docs:
        n = len(ids) // 4
        ids = ids if item_bytes == 4 else _narrow(ids, item_bytes)
        if held and size + len(ids) > frame_bytes:
            flush()
        index.append((doc_id or 0, doc_id is not None, len(seek), n))
        held.append(ids)
        size += len(ids)
        total += n
    if held:
        flush()
    body = struct.pack("<B", item_bytes) + np.array(index, _DOC).tobytes()
    sink.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
    table = np.array(seek, _SEEK).tobytes() + struct.pack("<IBI", len(seek), 0x80, FOOTER_MAGIC)
    sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
    return len(index), total


def _narrow(ids: bytes, item_bytes: int) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) >> 8 * item_bytes:
        raise ValueError(f"id {int(wide.max())} doesn't fit in {item_bytes} bytes")
    return wide.astype(f"<u{item_bytes}").tobytes()


class TokenFile:
    """Reads a file by its seek table; frames are checked against their checksums."""

    def __init__(self, source):
        self._source = source
        end = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise DamagedFile("no seek table")
        at = end - 9 - frames * _SEEK.itemsize
        self.seek = np.frombuffer(self._at(at, frames * _SEEK.itemsize), _SEEK)
        self.starts = np.concatenate([[0], np.cumsum(self.seek["compressed"], dtype=np.int64)])
        if struct.unpack("<I", self._at(at - 8, 4))[0] != SEEK_MAGIC:
            raise DamagedFile("no seek table")
        magic, size = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if magic != INDEX_MAGIC:
            raise DamagedFile("no document index")
        body = self._at(int(self.starts[-1]) + 8, size)
        self.item_bytes, self.index = body[0], np.frombuffer(body[1:], _DOC)
        self._open = zstandard.ZstdDecompressor()
        self.frames_read = 0

    def _at(self, start: int, size: int) -> bytes:
        self._source.seek(start)
        return self._source.read(size)

    def frame(self, k: int) -> bytes:
        row = self.seek[k]
        raw = self._open.decompress(self._at(int(self.starts[k]), int(row["compressed"])), max_output_size=int(row["raw"]))
        if len(raw) != row["raw"] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != row["check"]:
            raise DamagedFile(f"frame {k} fails its checksum")
        self.frames_read += 1
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, ids before it in this file, 32-bit ids) of all or the wanted documents."""
        starts = np.concatenate([[0], np.cumsum(self.index["n"], dtype=np.int64)])
        now, raw, offset = -1, b"", 0
        for k, (doc_id, known, frame, n) in enumerate(self.index.tolist()):
            if frame != now:
                now, raw, offset = frame, None, 0
            size = n * self.item_bytes
            if wanted is None or known and doc_id in wanted:
                raw = self.frame(frame) if raw is None else raw
                ids = raw[offset : offset + size]
                yield doc_id if known else None, int(starts[k]), ids if self.item_bytes == 4 else np.frombuffer(ids, f"<u{self.item_bytes}").astype("<u4").tobytes()
            offset += size


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _some(first: tuple[int | None, bytes], rest: Iterator[tuple[int | None, bytes]], most: int) -> Iterator[tuple[int | None, bytes]]:
    """``first``, and of the rest as many documents as come before so many bytes are full."""
    yield first
    size = len(first[1])
    while size < most and (row := next(rest, None)) is not None:
        size += len(row[1])
        yield row


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, item_bytes: int = 4, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files below ``path``; one row per file.

    One shuffle of the texts sorts the corpus by ranges of ids, and each task writes its range as a
    stream of small batches into files of about ``FILE_BYTES``, whatever the number of tasks. A repeated task writes the same bytes under a
    name of its own attempt and renames it, so losing an executor leaves no half file.
    """
    tokenizer = tokenizer or default_tokenizer()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode

        def pairs():
            for batch in batches:
                for at in range(0, len(batch), BATCH_DOCS):
                    some = batch.slice(at, BATCH_DOCS)
                    yield from zip(some.column(0).to_pylist(), encode(list(strings(some.column(1))), end_id), strict=True)

        rows, part = pairs(), 0
        fs, folder = _file_system(path)
        while (first := next(rows, None)) is not None:
            fs.create_dir(folder, recursive=True)
            name = f"ids-{shard:06d}-{part:06d}.zst"
            attempt = f"{folder}/{name}.{TaskContext.get().taskAttemptId()}"
            # frames are compressed already: pyarrow must not go by the name's ending
            with fs.open_output_stream(attempt, compression=None) as sink:
                n_docs, n_ids = write_file(sink, _some(first, rows, file_bytes), item_bytes=item_bytes)
            if fs.get_file_info(f"{folder}/{name}").type != pa.fs.FileType.NotFound:  # an earlier attempt got as far
                fs.delete_file(f"{folder}/{name}")
            fs.move(attempt, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})
            part += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows that share an id, or have none, may be many: the range goes by a hash too
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.mapInArrow(write, "shard long, part long, file string, n_docs long, n_ids long")


def read_token_files(spark: SparkSession, path: str, files: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Documents of the files: doc_id, start (over all files), n_tokens, ids (binary, 32-bit)."""
    # one row per file: the running total passes through one small task
    based = files.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard", "part")) - F.col("n_ids")).select("file", "base")
    chosen = None if wanted is None else set(wanted)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, folder = _file_system(path)
                with fs.open_input_file(f"{folder}/{name}") as source:
                    held, size = [], 0
                    for doc_id, start, ids in TokenFile(source).documents(chosen):
                        held.append((doc_id, base + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 4 << 20:
                            yield _rows(held)
                            held, size = [], 0
                    if held:
                        yield _rows(held)

    return based.repartition(max(1, files.count()), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    doc_id, start, n, ids = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def token_file_round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the corpus in the shared folder, read it back, and digest what was read."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    # every id of the default vocabulary is below 2**16: two bytes each in the file
    files = materialize(write_token_files(docs, path, tokenizer, item_bytes=2 if tokenizer is None else 4), "token-files")
    return read_token_files(spark, path, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
