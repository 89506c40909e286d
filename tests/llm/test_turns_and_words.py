"""Prefix tries, BPE and spelling variants against brute force and on rows that break things."""

import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

# -- 11


def plain_nodes(rows):
    """By definition: every beginning of every rebuilt conversation."""
    said = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [s[2] for s in sorted(x, key=lambda s: s[:2])] for c, x in said.items()}
    full = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = own.get(family, [])[:h] + x[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    leaves, saved, out = {}, {}, []
    for n in members:
        if n:
            children[n[:-1]].append(n)
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) or 1
        saved[n] = sum(saved[k] for k in children[n]) + ((len(members[n]) - 1) * len(n[-1][1]) if n else 0)
        ends = ",".join(str(c) for c in members[n] if len(full[c]) == len(n))
        out.append((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def invented_turns(seed=2):
    """Families with common beginnings, copies, a long conversation twice, ties, repeated turns, nulls and negative ids."""
    rng, rows = random.Random(seed), []
    for c in [*range(12), *range(95, 112), *range(200, 206), -7, -100, -150, 305]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "éé😀", None, ""])))
    for c in (1001, 1002, 1003):  # what 1000 has, then 300 turns in common
        rows += [(c, t, "user", f"turn {t if t < 290 else t * c}") for t in range(310)]
    rows += [(c, t, "user", "same") for c in range(400, 430) for t in range(4)]
    rows += [(None, 1, "user", "x"), *[(7, 3, "user", "again")] * 5]
    rng.shuffle(rows)
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("most", [20_000, 60, 8])
def test_prefix_trie(spark, most):
    from paperloom.llm.prefix_trie import conversation_trie

    rows = invented_turns()
    df = spark.createDataFrame(rows, TURNS).repartition(3).withColumns({c: F.lit("clash") for c in ("key", "pos", "digest", "size", "part", "parent", "depth")})
    assert sorted((tuple(r) for r in conversation_trie(df, most).collect()), key=str) == plain_nodes(rows)


def test_prefix_trie_of_little(spark):
    from paperloom.llm.prefix_trie import NOTHING, conversation_trie

    assert conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0
    # 5 of 105's own turns are taken away and 100 has none to give
    assert zlib.crc32(b"105") % 6 > 0
    rows = [(105, 0, "user", "x")]
    found = [tuple(r) for r in conversation_trie(spark.createDataFrame(rows, TURNS)).collect()]
    assert found == plain_nodes(rows) == [(105, 0, None, 1, 0, 1, 0, hashlib.sha256(b"105").hexdigest())]
    assert NOTHING == hashlib.sha256(b"").hexdigest()


# -- 12


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from paperloom.llm.bpe import default_vocabulary

    return Tokenizer.from_file(default_vocabulary())


@pytest.fixture(scope="module")
def bpe():
    from paperloom.llm.bpe import BpeCodec, default_vocabulary

    return BpeCodec(default_vocabulary())


def same_as_library(bpe, library, texts):
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == array("I", want).tobytes(), repr(text)[:200]
        assert bpe.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_equals_library(bpe, library):
    rng = random.Random(1)
    odd = [chr(c) for c in (0, 0x1C, 0x85, 0xA0, 0x301, 0x338, 0x3A3, 0x130, 0x558, 0x1F1E6, 0x1D49C, 0x200B, 0x2000, 0x3000, 0xFB01, 0x1C5, 0x1C89, 0x65E5)]
    atoms = [*odd, "a", " ", "\n", "\t", "\r", "word", "Hello", "'s", "'S", "'", "12", "!", "?!", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "a.", "aaaa", "it's", "."]
    same_as_library(bpe, library, [None, "", *("".join(rng.choices(atoms, k=rng.randint(0, 12))) for _ in range(6000))])


def test_every_code_point_is_split_as_the_library_does(bpe, library):
    texts = ["".join(f"a{chr(c)}b{chr(c)}1 !{chr(c)}" for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x20000, 64)]
    same_as_library(bpe, library, texts)


def test_long_words(bpe, library, monkeypatch):
    from paperloom.llm import bpe as module

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijé", k=rng.randint(1, 900))) for _ in range(40)]
    same_as_library(bpe, library, [" ".join(words), "x" * 200_000, "ab" * 5000])
    rounds = bpe.merge([w.encode() for w in words])
    assert rounds == [bpe._merge_long(w.encode()) for w in words]
    monkeypatch.setattr(module, "MEMO_CHUNKS", 3)
    same_as_library(bpe, library, words)
    same_as_library(bpe, library, words[::-1])


def test_encoded_digests(spark, bpe, library, edge_docs, no_docs):
    from paperloom.llm.bpe import decode, encode, encoded_digests

    def digests(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        return (doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())

    got = sorted((tuple(r) for r in encoded_digests(edge_docs).collect()), key=str)
    assert got == sorted((digests(r["doc_id"], r["text"]) for r in edge_docs.collect()), key=str)
    assert encoded_digests(no_docs).count() == 0
    once = {r["doc_id"]: r["decoded"] for r in encode(edge_docs.where("doc_id < 8"), decoded=True).collect()}
    assert {r["doc_id"]: r["decoded"] for r in decode(encode(edge_docs.where("doc_id < 8"))).collect()} == once


# -- 13


def plain_groups(rows):
    total = Counter()
    for doc_id, text in rows:
        runs, run = [], ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or 0xC0 <= ord(c) <= 0xFF:
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                runs.append(run)
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    n = {w: k for w, k in total.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    others = {w: [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    form = {}
    for w, found in others.items():
        if found and n[best := min(found, key=lambda x: (-n[x], x))] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(others[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def misspelt(seed):
    rng = random.Random(seed)
    letters = "abé" + chr(0xDF) + chr(0xC9)
    words = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(40)] + ["Running", "xxxxxx", "xxxxxxx", "xxxxx"]
    for w in list(words):
        for _ in range(3):
            k, c = rng.randrange(len(w)), rng.choice(letters)
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], w[:k] + w[k + 1 :] + c]))
    return [(k - 20, rng.choice(", .").join(rng.choices(words, weights=[1 + 200 // (1 + i) for i in range(len(words))], k=80))) for k in range(60)]


@pytest.mark.parametrize("most", [2000, 2])
def test_spelling(spark, edge_docs, no_docs, most, monkeypatch):
    from paperloom.llm import spelling

    monkeypatch.setattr(spelling, "COUNTED", 50)
    long_word = "z" * 3000
    rows = misspelt(most) + [(900 + k, f"{long_word} {long_word[1:]} {long_word}y") for k in range(4)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_groups(rows)
    assert sum(r[4] for r in want) > 50 and any(r[2] != (r[1] or r[0]) for r in want)
    key = lambda r: (r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"])
    assert sorted(map(key, spelling.spelling_groups(df, most).collect()), key=str) == want
    if most > 2:
        docs = edge_docs.unionByName(edge_docs).unionByName(edge_docs)
        assert sorted(map(key, spelling.spelling_groups(docs, most).collect()), key=str) == plain_groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
        assert spelling.spelling_groups(no_docs, most).count() == 0


def test_pairs_of_one_file():
    from paperloom.llm.spelling import near_pairs, one_edit_at

    rng = random.Random(9)
    words = sorted({"ab" + "".join(rng.choices("abc", k=4)) for _ in range(60)})
    longer = sorted({"ab" + "".join(rng.choices("abc", k=5)) for _ in range(90)})
    got = sorted(near_pairs(words, longer, 2, 0))
    want = [(a, b, False) for b in range(len(words)) for a in range(b) if (at := one_edit_at(words[a], words[b])) is not None and at >= 2]
    want += [(a, b, True) for b in range(len(longer)) for a in range(len(words)) if (at := one_edit_at(words[a], longer[b])) is not None and at >= 2]
    assert got == sorted(want)
