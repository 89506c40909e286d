"""Quality scores by voting of the nearest labelled documents in a latent semantic space.

Texts become counts of hashed byte trigrams, dampened, weighted by rarity and scaled to length one,
beside a few shares that tell how they are written (repeated words, marks, capitals, line ends);
the leading singular vectors of a bounded sample of labelled documents span the latent space. Each
task holds the sample's latent vectors (a broadcast of fixed size) and takes exact cosine products
with blocks of documents; the labels of the nearest ones vote, weighted by similarity.

Bounds (all parameters): ``MAX_LABELLED`` labelled rows, those with the least hash of their id,
``FEATURES`` hashed trigrams and ``DIMENSIONS`` latent ones: model and broadcast stay below 3 MB.

Defined results: an empty, null or one-character text has no trigram, is like no document and gets
the share of label 1 in the sample; null or other labels than 0 and 1 teach nothing; without any
labelled row all scores are 0.5. A repeated labelled row may vote once for each copy. Neighbours
whose similarities agree to six digits rank by doc_id. Very long texts are counted whole; repeated
rows all appear; an empty table gives no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_small_batches, strings

FEATURES = 4096
DIMENSIONS = 48
NEIGHBOURS = 15
MAX_LABELLED = 3000
BLOCK = 128
#: Shares beside the trigrams: six kinds of bytes, words like the one before, distinct words, words a byte; and the length.
SHARES = 10
#: How much the shares weigh against the trigrams.
SHARE_WEIGHT = 0.15
_KIND = np.zeros(256, np.int64)  # letters, capitals, digits, spaces, other marks, bytes of other letters
for _chars, _kind in ((range(0x41, 0x5B), 1), (range(0x30, 0x3A), 2), (b" \t\n\r", 3), (range(0x80, 0x100), 5)):
    _KIND[[*_chars]] = _kind
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 4
#: Similarities are raised to this power before they weight a vote.
SHARPNESS = 8


def counts_of(text: str | None) -> np.ndarray:
    """Counts of the hashed trigrams, then ``SHARES`` shares of the text in thousandths."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = np.zeros(FEATURES + SHARES, np.int64)
    if len(raw) < 3:
        return out
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    out[:FEATURES] = np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
    kinds = np.bincount(_KIND[raw], minlength=6)
    words = data.split()
    n = max(1, len(words))
    out[FEATURES:] = [*(1000 * kinds // len(raw)), 1000 * sum(map(eq, words, words[1:])) // n, 1000 * len(set(words)) // n, 1000 * n // len(raw), int(100 * np.log1p(n))]
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


@dataclass
class LatentNeighbours:
    """The fitted model."""

    rarity: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, seed: int = 7) -> LatentNeighbours:
        terms, shares = counts[:, :FEATURES], counts[:, FEATURES:]
        rarity = np.log((1 + len(terms)) / (1 + (terms > 0).sum(axis=0))).astype(np.float32) + 1
        centre, spread = shares.mean(axis=0), shares.std(axis=0) + 1
        model = cls(rarity, centre, spread, np.zeros((0, 0)), np.zeros((0, 0)), labels.astype(np.float32))
        x = model.weighted(counts)
        # randomized singular vectors with power iterations
        q = np.random.default_rng(seed).standard_normal((x.shape[1], DIMENSIONS + 16), np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
        model.axes = (q @ turn.T)[:, :DIMENSIONS].astype(np.float32)
        model.vectors = unit_rows(x @ model.axes)
        return model

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        terms = unit_rows(np.log1p(counts[:, :FEATURES], dtype=np.float32) * self.rarity)
        shares = np.clip((counts[:, FEATURES:] - self.centre) / self.spread, -4, 4) * SHARE_WEIGHT
        shares[~terms.any(axis=1)] = 0
        return np.hstack([terms, shares.astype(np.float32)])

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit_rows(self.weighted(counts) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = np.clip(self.latent(counts) @ self.vectors.T, 0, 1)
        n = near.shape[1]
        k = min(NEIGHBOURS, n)
        # similarities count to six digits, and of equal ones the first in the sample: products of blocks differ in the last bits
        order = np.rint(near * 1e6).astype(np.int64) * n + np.arange(n - 1, -1, -1)
        best = np.argpartition(-order, k - 1, axis=1)[:, :k]
        weight = np.take_along_axis(near, best, axis=1).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[best]).sum(axis=1)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), float(self.labels.mean()))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit_classifier(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> LatentNeighbours:
    """Learn from at most ``max_labelled`` labelled documents; one scan of ``documents``.

    The sample of ids is bounded, so it is broadcast; its texts become counts on the executors, and
    only counts other than zero reach the driver.
    """
    taught = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = taught.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for text in strings(batch.column(1)):
                found = counts_of(text)
                at.append(np.flatnonzero(found).astype(np.int32))
                n.append(found[at[-1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["doc_id", "quality", "at", "n"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = in_small_batches(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")).mapInArrow(count, "doc_id long, quality int, at array<int>, n array<int>").orderBy("doc_id", "quality", "at", "n").limit(max_labelled).collect()
    counts = np.zeros((len(found), FEATURES + SHARES), np.float32)
    for row, one in zip(counts, found, strict=True):
        row[one["at"]] = one["n"]
    quality = np.array([one["quality"] for one in found], np.float32)
    if not len(found):
        return LatentNeighbours(np.ones(FEATURES, np.float32), np.zeros(SHARES), np.ones(SHARES), np.zeros((FEATURES + SHARES, DIMENSIONS), np.float32), np.zeros((0, DIMENSIONS), np.float32), quality)
    return LatentNeighbours.fit(counts, quality)


def score_documents(documents: DataFrame, model: LatentNeighbours, columns: list[str] | None = None, score_name: str = "score") -> DataFrame:
    """``columns`` of ``documents`` (doc_id by default) and their score; one scan, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = columns or ["doc_id"]
    # a text that is kept is not sent twice
    own = "text" in kept and documents.schema["text"].dataType.simpleString() == "string"
    picked = documents.select(*kept) if own else documents.select(*kept, F.col("text").cast("string").alias("scored_text"))
    at_text, names = kept.index("text") if own else len(kept), [*kept, score_name]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = batch.column(at_text)
            for at in range(0, len(batch), BLOCK):
                block = np.stack([counts_of(t) for t in strings(texts.slice(at, BLOCK))])
                yield pa.RecordBatch.from_arrays([*(c.slice(at, BLOCK) for c in batch.columns[: len(kept)]), pa.array(fitted.score(block), pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(kept)]) + f", `{score_name}` double"
    return in_small_batches(picked).mapInArrow(score, schema)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_documents(docs, fit_classifier(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``documents``, all columns, that score at least ``least``."""
    scored = score_documents(documents, fit_classifier(documents, labels), documents.columns, "_paperloom_score")
    return scored.where(F.col("_paperloom_score") >= least).select(*documents.columns)
