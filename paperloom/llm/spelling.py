"""Spelling variants: words of a corpus that are one edit apart, grouped under their most frequent forms.

Words are counted in the tasks that read the texts, then summed. Two words within one edit agree on the
first half of the shorter one or on all that follows it, so each word is filed under the halves that it
may share (with words of its length, and with shorter ones). A file of too many words is split again:
what its words don't share yet is halved in the same way, down to one code point. A pair is looked for in
the one file that fits its first difference, so it is found once, and no file grows with the corpus.

In each file the words' bigrams that touch the unshared part are indexed by place. A word's postings
are merged from a heap, under the limits that one edit sets to places and lengths; words that share
too few of its grams to be one edit away go, all others are compared letter by letter.

What a word finds leaves its file as one row (how many, and the best form), so pairs are never listed.
Roots follow forms by pointer doubling: each form is at least twice as frequent, so chains are short.

Defined results: null and empty texts have no words; a missing id counts as an empty string before the
colon; repeated rows count again; words of any length are taken whole; an empty table, or one without
frequent words, gives no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, in_small_batches, shuffle_partitions, strings

#: Runs of letters, and what of them is lower-cased.
RUN = re.compile(f"[A-Za-z{chr(0xC0)}-{chr(0xFF)}]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: A run of which the checksum is divisible by this loses a letter.
SPOILT = 97
LEAST_CHARS, LEAST_COUNT = 5, 3
#: Distinct words counted in a task before they are sent on.
COUNTED = 300_000
#: Files of more words are split.
FILE_WORDS = 2000
#: Rows of files that a task gets, about.
TASK_ROWS = 100_000


# -- words


def words_of(doc_id: object, text: str | None) -> Counter:
    """The words of a text of at least ``LEAST_CHARS`` code points, with how often they stand there."""
    found: Counter = Counter()
    if not text:
        return found
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.lower() if text.isascii() else text.translate(_LOWER))).items():
        h = zlib.crc32(run.encode(), seed)
        if h % SPOILT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_CHARS:
            found[run] += n
    return found


def counted_words(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word and n of all words that stand at least so often in all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        part = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                total.update(words_of(doc_id, text))
                if len(total) > COUNTED:
                    yield part()
                    total.clear()
        yield part()

    rows = in_small_batches(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# -- files of words that share a beginning or an end


def _filed(rows: DataFrame) -> DataFrame:
    """Rows with the key of their file: the length of its shorter words, and what they share on either side."""
    start = F.substring("word", F.lit(1), F.col("head"))
    end = F.when(F.col("tail") > 0, F.substring("word", -F.col("tail"), F.col("tail"))).otherwise("")
    return rows.withColumn("file", F.xxhash64("size", "head", "tail", start, end))


def _halves(rows: DataFrame, size: Column, head: Column, tail: Column) -> DataFrame:
    """Rows under what may be shared when the edit lies beyond the half, or before it."""
    half = F.floor((size - head - tail) / 2).cast("int")
    sides = F.array(
        F.struct((head + half).alias("head"), tail.alias("tail")),
        F.struct(head.alias("head"), (size - head - half).alias("tail")),
    )
    return rows.withColumn("side", F.explode(sides)).select("word", "n", "size", "longer", F.col("side.head").alias("head"), F.col("side.tail").alias("tail"))


def _files(words: DataFrame, scratch: Scratch, most: int) -> tuple[DataFrame, int]:
    """word, n, size, longer, head, tail and file: each word in each file where it may meet a word one edit away; and how many rows that are.

    ``size`` is the length of a file's shorter words; ``longer`` marks words of one letter more.
    """
    zero = F.lit(0)
    both = words.withColumn("longer", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("size", F.length("word") - F.col("longer").cast("int")).where(F.col("size") >= LEAST_CHARS)
    now = scratch.table(_filed(_halves(both, F.col("size"), zero, zero)), "files")
    kept, n = None, 0
    while True:
        sizes = now.groupBy("file").agg(F.count("*").alias("held"), F.count_if(~F.col("longer")).alias("shorter"), F.max(F.col("size") - F.col("head") - F.col("tail")).alias("open"))
        sizes = scratch.table(sizes.where("held > 1 and shorter > 0"), "sizes")
        split = (F.col("held") > most) & (F.col("open") > 1)
        fit = now.join(sizes.where(~split).select("file"), "file", "left_semi")
        kept = fit if kept is None else kept.unionByName(fit)
        n += sizes.where(~split).agg(F.sum("held")).first()[0] or 0
        large = sizes.where(split).select("file")
        if large.isEmpty():
            return kept, n
        over = now.join(large, "file", "left_semi")
        # what isn't shared gets shorter each time, so this ends
        now = scratch.table(_filed(_halves(over, F.col("size"), F.col("head"), F.col("tail"))), "files")


def one_edit_at(short: str, other: str) -> int | None:
    """The first place where they differ, if other is short with one letter replaced or inserted."""
    at = 0
    for a, b in zip(short, other, strict=False):
        if a != b:
            break
        at += 1
    return at if short != other and short[at + (len(short) == len(other)) :] == other[at + 1 :] else None


def near_pairs(short: list[str], long: list[str], head: int, tail: int) -> Iterator[tuple[int, int, bool]]:
    """Pairs (index into short, index into short or long, whether it is long) one edit apart, where the edit is in the file's open part.

    The words of ``short`` have one length and those of ``long`` one letter more; all share ``head`` and
    ``tail`` letters. A pair belongs to the file if its first difference isn't before the open part, nor after it.
    """
    size = len(short[0])
    stop = size - tail if tail else size + 1
    open_size = size - head - tail
    mark = "\n"  # stands before and after each word
    index: dict[tuple[int, str], list[int]] = defaultdict(list)
    grams = lambda word, more: [(k, f"{mark}{word}{mark}"[k : k + 2]) for k in range(head, head + open_size + 1 + more)]

    def near(lists: list[list[int]], least: int, others: int) -> Iterator[int]:
        if least < 1:
            yield from range(others)
            return
        for k, same in groupby(merge(*lists)):
            if sum(1 for _ in same) >= least:
                yield k

    # an edit touches two of the open part's grams if it replaces a letter, and one of the shorter word's if it inserts one
    for b, word in enumerate(short):
        places = grams(word, 0)
        for a in near([index[g] for g in places if g in index], len(places) - 2, b):
            at = one_edit_at(short[a], word)
            if at is not None and head <= at < stop:
                yield a, b, False
        for g in places:
            index[g].append(b)
    for b, word in enumerate(long):
        places = grams(word, 1)
        # behind an inserted letter everything stands one place later; the same list twice would count twice
        wanted = dict.fromkeys(g for k, x in places for g in ((k, x), (k - 1, x)) if g in index)
        for a in near([index[g] for g in wanted], open_size, len(short)):
            at = one_edit_at(short[a], word)
            if at is not None and head <= at < stop:
                yield a, b, True


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[int, int, list, list]]:
    """head, tail, shorter and longer words (word, n) of each file; what shares a file's number by chance is told apart."""
    for _, some in groupby(rows, key=lambda r: r[0]):
        held: dict[tuple, tuple[list, list]] = {}
        for _, head, tail, longer, word, n in some:
            key = (head, tail, len(word) - longer, word[:head], word[len(word) - tail :])
            held.setdefault(key, ([], []))[longer].append((word, n))
        for (head, tail, *_), (short, long) in held.items():
            if short and len(short) + len(long) > 1:
                yield head, tail, short, long


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each word of a file finds there: how many words, and the most frequent one (of these the first)."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)

    words, counts, bests, rivals = [], [], [], []
    for head, tail, short, long in _groups(rows()):
        best: dict[str, list] = {}

        def meets(x: tuple[str, int], y: tuple[str, int], best=best) -> None:
            row = best.setdefault(x[0], [0, 0, ""])
            row[0] += 1
            if (-y[1], y[0]) < (-row[1], row[2]):
                row[1], row[2] = y[1], y[0]

        for a, b, is_long in near_pairs([w for w, _ in short], [w for w, _ in long], head, tail):
            other = (long if is_long else short)[b]
            meets(short[a], other)
            meets(other, short[a])
        for word, (n, rival_n, rival) in best.items():
            words.append(word)
            counts.append(n)
            bests.append(rival_n)
            rivals.append(rival)
        if len(words) > 20_000:
            yield _batch(words, counts, bests, rivals)
            words, counts, bests, rivals = [], [], [], []
    yield _batch(words, counts, bests, rivals)


def _batch(words: list, counts: list, bests: list, rivals: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(bests, pa.int64()), pa.array(rivals, pa.string())], names=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame, scratch: Scratch, most: int = FILE_WORDS) -> DataFrame:
    """words (word, n): n_near, and the most frequent near word as form and form_n, of each word that has one."""
    rows, n = _files(words, scratch, most)
    filed = rows.repartition(max(shuffle_partitions(words.sparkSession), -(-n // TASK_ROWS)), "file").sortWithinPartitions("file")
    found = filed.select("file", "head", "tail", "longer", "word", "n").mapInArrow(_found, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


# -- forms and roots


def spelling_groups(docs: DataFrame, most: int = FILE_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of each frequent word; see the module's text."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.table(counted_words(docs), "words")
    near = near_words(words, scratch, most)
    takes = F.col("form_n") >= 2 * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n"))
    formed = scratch.only(joined, "formed")
    # pointer doubling over the words that have a form
    at = scratch.table(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.table(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return scratch.only(formed.join(at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling")
