"""BPE encoding and decoding: words are merged many at a time, in rounds over one flat numpy array.

A text is cut at special tokens and white space; the chunks are normalized, lower-cased and split into
words as the tokenizer's file says. The words of a batch that no memo holds lie end to end in one array
of symbols. A round looks every pair of neighbours up in the sorted pair keys (a binary search), takes
each word's lowest rank and merges all its places from left to right; words without a known pair leave.
A merge only makes pairs of higher rank (checked when the file is read), so rounds give the ids of one
merge after the other. Words of more than ``LONG_WORD`` bytes would need too many rounds for their length;
their merges are taken from a heap.

Decoding looks up each id's token; a file without a decoder joins tokens by spaces.

Defined results: null and empty texts have no ids; special tokens that stand in a text are one id each;
bytes outside the vocabulary can't occur (it holds all 256, checked). Texts are taken whole; repeated
rows all appear; an empty table gives no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import strings
from .tokens import BYTE_LETTERS, MARKS

#: Chunks and words kept by a worker; a full memo starts afresh. About 150 bytes each.
MEMO_CHUNKS = 400_000
#: Longer chunks and words are not kept.
MEMO_CHARS = 48
#: Words of more bytes are merged from a heap.
LONG_WORD = 4096
#: Bytes of results that one Arrow batch holds, but for a single text's own.
BATCH_BYTES = 16 << 20
#: Up to here every code point is assigned, and was long ago.
LATIN = chr(0x24F)
#: What the file's expression \s matches and ``str.split`` doesn't part, and the other way round.
_SPACES = re.compile("[" + "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]+")
_NO_SPACES = re.compile("[" + "".join(map(chr, range(0x1C, 0x20))) + "]")


class BpeCodec:
    """Encoder and decoder of a BPE file of the ``tokenizers`` library whose words end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or spec["decoder"] or model["unk_token"]:
            raise ValueError(f"{path}: not the kind of file that this codec reads")
        # normalizer and splitter of the library, for what Python's Unicode tables don't know yet
        self._library = Tokenizer.from_file(path)
        self._word = regex.compile(steps[0]["pattern"]["Regex"])
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        letter = [chr(BYTE_LETTERS.get(b, b)) for b in range(256)]
        self._inner = np.array([vocab[c] for c in letter], np.int64)
        self._last = np.array([vocab[c + end] for c in letter], np.int64)
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._size = 1 + max([*vocab.values(), *self._special.values()])
        self.tokens: list[str | None] = [None] * self._size
        for token, i in [*vocab.items(), *self._special.items()]:
            self.tokens[i] = token
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64).reshape(-1, 3)
        self._made = pairs[:, 2]
        keys = pairs[:, 0] * self._size + pairs[:, 1]
        self._ranks = np.argsort(keys)
        self._keys = keys[self._ranks]
        first = np.full(self._size, -1)
        first[self._made] = np.arange(len(pairs))
        if len(np.unique(keys)) < len(keys) or len(np.unique(self._made)) < len(keys) or (first[pairs[:, :2]].max(axis=1) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path}: merges must make each token once, from tokens that are there already")
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        self._letters = {letter[b]: b for b in range(256)}
        self._chunks: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    # -- from texts to words

    def _segments(self, text: str) -> list[str]:
        """Ordinary text and special tokens, in turn."""
        return self._cut.split(text) if self._cut and any(s in text for s in self._special) else [text]

    def _words_of(self, chunk: str) -> list[bytes]:
        if chunk.isascii():
            core = chunk[:-1] if chunk[-1] in MARKS else chunk
            if core.isalpha():  # what most chunks are
                return [core.lower().encode(), *[chunk[-1].encode()] * (core is not chunk)]
        else:
            if max(chunk) > LATIN and any(unicodedata.category(c) == "Cn" for c in chunk):
                found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(chunk))
                return [bytes(self._letters[c] for c in w) for w, _ in found]
            # a sigma at a word's end is lower-cased like any other
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return [w.encode() for w in self._word.findall(chunk.lower())]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self._chunks) > MEMO_CHUNKS or len(self._words) > MEMO_CHUNKS:
            self._chunks, self._words = {}, {}
        parted = []
        for text in texts:
            parts = []
            for k, segment in enumerate(self._segments(text or "")):
                if k % 2:
                    parts.append(np.array([self._special[segment]], "<u4").tobytes())
                else:
                    parts.append([c for c in _SPACES.split(segment) if c] if _NO_SPACES.search(segment) else segment.split())
            parted.append(parts)
        chunks, words = self._chunks, self._words
        new = [(c, self._words_of(c)) for c in set().union(*(p for parts in parted for p in parts if not isinstance(p, bytes))).difference(chunks)]
        fresh = list({w for _, found in new for w in found}.difference(words))
        ids = dict(zip(fresh, self.merge(fresh), strict=True))
        words.update((w, i) for w, i in ids.items() if len(w) <= MEMO_CHARS)
        long_ones = {}
        for c, found in new:
            made = b"".join([words[w] if w in words else ids[w] for w in found])
            (chunks if len(c) <= MEMO_CHARS else long_ones)[c] = made
        get = chunks.__getitem__ if not long_ones else lambda c: chunks[c] if c in chunks else long_ones[c]
        return [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in parts]) for parts in parted]

    # -- from words to ids

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of words (not empty) given in UTF-8."""
        out: list[bytes] = [b""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[k] = self._merge_long(w)
        if not short:
            return out
        sizes = np.array([len(words[k]) for k in short])
        of = np.repeat(np.arange(len(short)), sizes)
        raw = np.frombuffer(b"".join(words[k] for k in short), np.uint8)
        symbols = self._inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self._last[raw[ends]]
        done_symbols, done_of = [], []
        none = len(self._keys)
        while len(symbols):
            rank = np.full(len(symbols), none)
            key = symbols[:-1] * self._size + symbols[1:]
            at = np.minimum(np.searchsorted(self._keys, key), none - 1)
            known = (self._keys[at] == key) & (of[:-1] == of[1:])
            rank[:-1][known] = self._ranks[at[known]]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(of)))
            ready = best == none
            if ready.any():
                done_symbols.append(symbols[ready])
                done_of.append(of[ready])
                symbols, of, rank, best = symbols[~ready], of[~ready], rank[~ready], best[~ready]
            places = np.flatnonzero(rank == best)
            # of places that overlap every other one is merged, from the left
            begins = np.diff(places, prepend=-2) != 1
            run = places[begins][np.cumsum(begins) - 1] if len(places) else places
            places = places[(places - run) % 2 == 0]
            symbols[places] = self._made[rank[places]]
            stay = np.ones(len(symbols), bool)
            stay[places + 1] = False
            symbols, of = symbols[stay], of[stay]
        all_of = np.concatenate(done_of)
        order = np.argsort(all_of, kind="stable")
        flat = np.concatenate(done_symbols)[order].astype("<u4").tobytes()
        bounds = np.cumsum(np.bincount(all_of, minlength=len(short))) * 4
        begin = 0
        for k, stop in zip(short, bounds.tolist(), strict=True):
            out[k], begin = flat[begin:stop], stop
        return out

    def _rank(self, a: int, b: int) -> int | None:
        key = a * self._size + b
        at = int(np.searchsorted(self._keys, key))
        return int(self._ranks[at]) if at < len(self._keys) and self._keys[at] == key else None

    def _merge_long(self, word: bytes) -> bytes:
        symbols = self._inner[np.frombuffer(word, np.uint8)].tolist()
        symbols[-1] = int(self._last[word[-1]])
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        rank = lru_cache(maxsize=100_000)(self._rank)
        heap = [(r, k) for k in range(len(symbols) - 1) if (r := rank(symbols[k], symbols[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if symbols[k] < 0 or (nxt := after[k]) == len(symbols) or rank(symbols[k], symbols[nxt]) != r:
                continue
            symbols[k], symbols[nxt], after[k] = int(self._made[r]), -1, after[nxt]
            if after[k] < len(symbols):
                before[after[k]] = k
                if (more := rank(symbols[k], symbols[after[k]])) is not None:
                    heapq.heappush(heap, (more, k))
            if before[k] >= 0 and (more := rank(symbols[before[k]], symbols[k])) is not None:
                heapq.heappush(heap, (more, before[k]))
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()

    # -- and back

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids; ids that are no token's are passed over."""
        known = map(self.tokens.__getitem__, (i for i in np.frombuffer(ids, "<u4").tolist() if i < self._size))
        return " ".join(t for t in known if t is not None)


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    """One per worker process and file."""
    return BpeCodec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _parts(column: pa.Array | pa.ChunkedArray, size) -> Iterator[list]:
    """Values of a column in lists of some megabytes."""
    some, held = [], 0
    for value in column:
        some.append(value)
        held += size(value)
        if held > BATCH_BYTES // 8 or len(some) >= 2048:
            yield some
            some, held = [], 0
    if some:
        yield some


def encode(docs: DataFrame, path: str | None = None, text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of each row, and with ``decoded`` the text that they decode to."""
    path = path or default_vocabulary()
    names = ["doc_id", "ids", *["decoded"] * decoded]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            at = 0
            for texts in _parts(strings(batch.column(1)), lambda t: len(t or "")):
                ids = bpe.encode(texts)
                columns = [batch.column(0).slice(at, len(texts)), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(map(bpe.decode, ids), pa.string()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary" + ", decoded string" * decoded)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """doc_id and decoded, the text of each row's ids (null: empty)."""
    path = path or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            at = 0
            for some in _parts((x.as_py() for x in batch.column(1)), lambda i: len(i or b"")):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array([bpe.decode(i or b"") for i in some], pa.string())], names=["doc_id", "decoded"])
                at += len(some)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded string")


def encoded_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    both = encode(docs, path, decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
