"""Token ids of whole texts by a public tokenizer, with a bounded memo of pieces between spaces."""

from __future__ import annotations

import os
import string
from array import array
from functools import lru_cache

import numpy as np

#: Pieces kept: half of them recent ones, half those that were met before. About 150 bytes each.
MEMO_PIECES = 400_000
#: Longer pieces are not kept.
MEMO_CHARS = 48
#: A mark after a word is a token sequence of its own; a space and letters are one word to the model.
MARKS = ",.;:!?"
#: To this model all of these that follow a word are one sequence.
TAIL = string.punctuation
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level BPE spells a byte that isn't a printable Latin-1 character by the next code point from 256 on.
BYTE_LETTERS = {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}
SPACE = chr(BYTE_LETTERS[0x20])


class _Blank(Exception):
    """A piece of white space alone: how it is split depends on its neighbours."""


class _Memo(dict):
    """Ids of pieces that follow a space; what isn't there is encoded, and kept unless it is long.

    ``earlier`` has the pieces of the memo before this one: what recurs moves on, the rest is forgotten with it.
    """

    def __init__(self, owner: PieceEncoder, earlier: dict[str, bytes]):
        super().__init__()
        self._owner, self._earlier = owner, earlier

    def __missing__(self, p: str) -> bytes:
        if (ids := self._earlier.get(p)) is None:
            ids = self._owner.piece(p)
        if len(p) <= MEMO_CHARS:
            self[p] = ids
        return ids


class PieceEncoder:
    """Encodes texts with a byte-level BPE file of the ``tokenizers`` library.

    The pre-tokenizer never joins a space to what stands before it, so a text may be encoded
    piece by piece, cut before each single space; most pieces recur, and their ids are looked up.
    Texts where such a cut may fall inside a run of white space (double or trailing spaces, or
    nothing but white space between two spaces) are encoded whole. The ids equal those of one ``encode`` call over the text.

    A letter or a mark, a line feed and a letter are three pieces to the model too, and words before and after line feeds are looked up alone.

    Special tokens that stand in a text are one id each, as in the library's plain call. Texts that hold one are
    encoded whole: white space before it is split otherwise.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._memo, self._after_line, self._marks = _Memo(self, {}), {}, {}
        self._line = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, p: str, before: str = SPACE) -> bytes | None:
        """Ids of letters, with or without marks behind them; None of anything else."""
        core = p.rstrip(TAIL)
        if len(p) > MEMO_CHARS or not core.isalpha():
            return None
        if len(core) < len(p) and before:
            return self._memo[core] + self._tail(p[len(core) :])
        spelt = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = array("I", [t.id for t in self._tokenizer.model.tokenize(before + spelt)]).tobytes()
        return ids if len(core) == len(p) else ids + self._tail(p[len(core) :])

    def _tail(self, marks: str) -> bytes:
        if (ids := self._marks.get(marks)) is None:
            if len(self._marks) >= MEMO_PIECES // 40:
                self._marks.clear()
            ids = self._marks[marks] = self._encode([marks])[0]
        return ids

    def _line_start(self, p: str) -> bytes | None:
        """Ids of letters that begin a line."""
        if (ids := self._after_line.get(p)) is None and (ids := self._word(p, "")) is not None:
            if len(self._after_line) >= MEMO_PIECES // 8:
                self._after_line.clear()
            self._after_line[p] = ids
        return ids

    def piece(self, p: str) -> bytes:
        """Ids of a piece without spaces that follows one."""
        if (ids := self._word(p)) is not None:
            return ids
        if p.isspace():
            raise _Blank
        first, *lines = p.split("\n")
        if lines and (ids := self._word(first)) is not None:
            rest = [self._line_start(line) for line in lines]
            if None not in rest:
                return self._line.join([ids, *rest])
        return self._encode([f" {p}"])[0]

    def encode(self, texts: list[str | None], end_id: int | None = 0) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty; ``end_id`` closes each."""
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        texts = [t or "" for t in texts]
        whole = lambda t: "  " in t or t[-1:].isspace() or any(s in t for s in self._special)
        heads = [t if whole(t) else t.split(" ", 1)[0] for t in texts]
        if len(self._memo) > MEMO_PIECES // 2:
            self._memo = _Memo(self, dict(self._memo))
        get, out = self._memo.__getitem__, []
        for text, head, ids in zip(texts, heads, self._encode(heads), strict=True):
            if len(head) < len(text):
                try:
                    ids += b"".join(map(get, text[len(head) + 1 :].split(" ")))
                except _Blank:
                    ids = self._encode([text])[0]
            out.append(ids + end)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file, with the ids of the library's plain call."""
    return PieceEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
