"""Pieces between spaces give the ids that the tokenizer gives for the whole text."""

import random
import zlib
from array import array

from paperloom.llm.tokens import PieceEncoder, default_tokenizer, encoder

ATOMS = ["a", " ", "\n", "\t", "\r", "word", "Hello", "'s", "'", "12", "!", "?!", " ", "　", "é", "日本", "<|endoftext|>", "\x00", "\x1c", "\x85", "a.", "b,", "́", "\U0001d49c", "​"]


def test_ids_equal_those_of_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_tokenizer())
    pieces, rng = PieceEncoder(default_tokenizer()), random.Random(5)
    texts = [None, "", *("".join(rng.choices(ATOMS, k=rng.randint(0, 9))) for _ in range(5000))]
    for text, ids in zip(texts, pieces.encode(texts, None), strict=True):
        assert ids == array("I", whole.encode(text or "", add_special_tokens=False).ids).tobytes(), repr(text)


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids


def test_operators_take_the_ids_of_the_plain_call():
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(default_tokenizer()), random.Random(6)
    assert array("I", encoder(default_tokenizer()).encode(["x <|endoftext|> y"], None)[0]).tolist() == [87, 220, 50256, 331]
    texts = [None, "", "a\n <|endoftext|>", *("".join(rng.choices([*ATOMS, "<|endoftext|>"], k=rng.randint(0, 9))) for _ in range(5000))]
    for text, ids in zip(texts, encoder(default_tokenizer()).encode(texts, None), strict=True):
        assert ids == array("I", whole.encode(text or "", add_special_tokens=False).ids).tobytes(), repr(text)


def test_special_token_in_a_document(spark):
    from paperloom.llm import packing, token_files

    rows = [(1, "x <|endoftext|> y"), (2, "a\n <|endoftext|>"), (3, "plain words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: [*plain_ids(t), 0] for i, t in rows}
    crc = {i: zlib.crc32(array("I", ids).tobytes()) for i, ids in want.items()}
    at = 0
    for r in sorted(token_files.token_file_round_trip(docs).collect()):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want[r["doc_id"]]), crc[r["doc_id"]])
        at += r["n_tokens"]
    assert {(p["doc_id"], p["doc_tokens"], p["ids_crc32"]) for p in packing.pack(docs).collect()} == {(i, len(ids), crc[i]) for i, ids in want.items()}


def test_words_at_lines_and_marks_are_looked_up(monkeypatch):
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from paperloom.llm import tokens

    path, rng = tokens.default_tokenizer(), random.Random(6)
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "MEMO_PIECES", 80)
    parts = ["a", "Th", "é", "ß", "n", "'s", "'", "12", "\n", "\n", "\t", "\r\n", " ", " ", " ", "***", ".", "!?", "_", "-", " ", "😀", "中文", "ª", "²", "́", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)] + ["x <|endoftext|> y\nz", "a \n b", "b\n c", "a \nb", "a\n\nb c"]
    encoder = tokens.PieceEncoder(path)
    for at in range(0, len(texts), 37):
        some = texts[at : at + 37]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some, None)] == [library.encode(t, add_special_tokens=False).ids for t in some]
    # only first words and marks go to the library's own call, and words that recur outlast the memo that held them
    encoder, asked, words = tokens.PieceEncoder(path), [], []
    call, word = encoder._encode, encoder.piece
    encoder._encode = lambda some: asked.extend(some) or call(some)
    encoder.piece = lambda p: words.append(p) or word(p)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for k in range(20):
        encoder.encode([f"first often {a}{letters[k]}.\nNext{b}*** {a}{b}{letters[k]}" for a in letters[:6] for b in letters[:6]])
    assert {*asked} <= {"first", "\n", ".", "***"} and words.count("often") == 1 and len(encoder._memo) < 200
