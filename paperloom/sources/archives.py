"""Texts from e-print bytes: a gzipped tar of TeX files, one gzipped file, or plain text."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import or_no_text, without_comments


#: Unpacked bytes of one e-print, and characters of its text; beyond either it fails.
MOST_BYTES = 512 << 20


class TooLarge(Exception):
    """An archive that unpacks to more than it may."""


class _Bounded:
    """A gzip stream that is never read beyond a place, however far it would unpack."""

    def __init__(self, content: bytes, most: int):
        self._file = gzip.GzipFile(fileobj=io.BytesIO(content))
        self._most = most

    def tell(self) -> int:
        return self._file.tell()

    def read(self, size: int = -1) -> bytes:
        room = self._most - self.tell() + 1
        data = self._file.read(room if size < 0 else min(size, room))
        if len(data) >= room:
            raise TooLarge(f"more than {self._most} bytes unpacked")
        return data

    def seek(self, offset: int) -> int:
        if offset > self._most:
            raise TooLarge(f"more than {self._most} bytes unpacked")
        return self._file.seek(offset)


def raw_text(content: bytes, most_bytes: int = MOST_BYTES) -> str:
    """TeX members in archive order, each with a line feed; invalid bytes are dropped.

    What ends too early raises, and so does no worse container: only those that never were one are
    tried as the next kind. An archive is read as a stream, member by member; one that unpacks to more than
    ``most_bytes``, whatever its members' headers say, raises ``TooLarge`` before it is held.
    """
    try:
        with tarfile.open(fileobj=_Bounded(content, most_bytes), mode="r:") as tar:
            texts, size = [], 0
            for member in tar.getmembers():
                if member.name.endswith(".tex") and (file := tar.extractfile(member)):
                    texts.append(file.read().decode("utf-8", "ignore") + "\n")
                    size += len(texts[-1])
                    if size > most_bytes:  # links may name one member many times
                        raise TooLarge(f"more than {most_bytes} characters of text")
            return "".join(texts)
    except (tarfile.ReadError, gzip.BadGzipFile):
        pass
    try:
        return _Bounded(content, most_bytes).read().decode("utf-8", "ignore")
    except gzip.BadGzipFile:
        return content.decode("utf-8", "replace")


def read_eprints(spark: SparkSession, path: str) -> DataFrame:
    """Fetched e-prints (id, content): one file for each, named by its id with or without an ending of an archive."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(tar\.gz|tgz|gz|tar|tex|bin)$", "")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.url_decode(name).alias("id"), "content")


def extracted(eprints: DataFrame, batch_bytes: int = 32 << 20, most_bytes: int = MOST_BYTES) -> DataFrame:
    """eprints (id, content, and error of the fetch, if there is one): id, text (cleaned, or the sentence for none) and error (null if all went well)."""
    fetch_error = F.col("error").cast("string") if "error" in eprints.columns else F.lit(None).cast("string")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, errors, size = [], [], [], 0
            for k in range(len(batch)):
                content, failed = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                try:
                    text, error = (None, failed or "no content") if failed or content is None else (raw_text(content, most_bytes), None)
                except Exception as e:  # a damaged archive fails its own paper only
                    text, error = None, f"{type(e).__name__}: {e}"
                ids.append(batch.column(0)[k].as_py())
                texts.append(text)
                errors.append(error)
                size += len(text or "")
                if size > batch_bytes:
                    yield _batch(ids, texts, errors)
                    ids, texts, errors, size = [], [], [], 0
            yield _batch(ids, texts, errors)

    out = eprints.select(F.col("id").cast("string").alias("id"), F.col("content").cast("binary").alias("content"), fetch_error.alias("error")).mapInArrow(extract, "id string, text string, error string")
    return out.withColumn("text", or_no_text(without_comments(F.col("text"))))


def _batch(ids: list, texts: list, errors: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, texts, errors)], names=["id", "text", "error"])
