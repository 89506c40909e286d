"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

* The index is a stored table of postings (term, row, pos) for every term that a test window holds, and
  a closing row for each document with its number of words. It is written where the texts are read: one
  scan, no shuffle. Its lists lie in the files of their documents, so no term gathers in one place.
* Lists are counted from the table. A window starts from the list of its rarest term, shifted by the
  term's offset; the list of the next rarest term, shifted alike, is intersected with it by a join on
  (row, term, position); what is left is intersected with the lists of all other terms at once. Where
  every list holds its position, the window stands in the document, word by word.
* Proximity queries join two lists of the same table by position blocks.
* Items are joined to the phrases found by window id, at the end.

A join key is a position of a document, so neither a frequent term nor a passage in a third of all
documents gathers in one task. Windows and terms reach the tasks in blocks of at most
``BLOCK_WINDOWS`` and ``BLOCK_TERMS`` (each a broadcast of bounded size): a larger benchmark costs more
scans, not memory.

Defined results: null or wordless texts have no words and no hits; rows that share an id are judged
apart; repeated rows all appear, judged alike; null items and items without words have no windows;
items that share an id are one item; empty tables give no rows or no hits; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import SENT_KEYS, Scratch, sent_if_few

WINDOW = 13
BLOCK_WINDOWS = 50_000
BLOCK_TERMS = 500_000
BROADCAST_ROWS = SENT_KEYS
#: ASCII characters that aren't part of words (after lower-casing A-Z).
_GAPS = "".join(chr(c) for c in range(0x80) if not chr(c).isdigit() and not chr(c).islower())
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_column(text: Column) -> Column:
    """Lower-cased words of a text, in order; an empty array for null."""
    low = F.btrim(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_GAPS))
    return F.when(F.length(low) > 0, F.split(low, _GAP)).otherwise(F.array().cast("array<string>"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a number of their own. To be written before it is used: it depends on how rows are dealt."""
    return rows.withColumn(name, F.monotonically_increasing_id())


def _blocks(table: DataFrame, key: str, size: int) -> list[DataFrame]:
    blocks = max(1, -(-table.count() // size))
    return [table.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k) for k in range(blocks)]


def positional_index(docs: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """The stored index of ``docs`` (words, and columns that are kept) for ``terms`` (term, term_id).

    Rows (row, term_id, pos) for each place where a term stands, and one row for each document with a
    null term_id, its number of words as pos, and the kept columns.
    """
    kept = [c for c in docs.columns if c != "words"]
    made, blocks = None, _blocks(terms, "term", BLOCK_TERMS)
    rows = numbered(docs, "row")
    if len(blocks) > 1:  # several scans must see the same numbers
        rows = scratch.table(rows, "numbered")
    for k, block in enumerate(blocks):
        # the closing null gives each document a row of its own
        tokens = rows.select("row", *kept, F.posexplode(F.array_append("words", F.lit(None).cast("string"))).alias("pos", "term"))
        closing = F.col("term").isNull()
        found = tokens.join(F.broadcast(block.select("term", "term_id")), "term", "left").where("term_id is not null" if k else "term is null or term_id is not null")
        found = found.select("row", "term_id", "pos", *(F.when(closing, F.col(c)).alias(c) for c in kept))
        made = found if made is None else made.unionByName(found)
    return scratch.table(made, "index")


def _near(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Postings of the wanted documents (row, distinct)."""
    return rows.join(sent_if_few(wanted, BROADCAST_ROWS), "row", "left_semi")


def phrase_matches(index: DataFrame, windows: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, win_id, start, length): where windows (win_id, terms: an array of term ids) stand, exactly."""
    postings = index.where("term_id is not null").select("row", "term_id", "pos")
    counts = scratch.table(postings.groupBy("term_id").agg(F.count("*").alias("n")), "counts")
    spread = windows.select("win_id", F.posexplode("terms").alias("offset", "term_id")).join(counts, "term_id", "left")
    by = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term_id", "offset")))
    ranked = scratch.table(spread.groupBy("win_id").agg(by.alias("by")).where(F.col("by")[0]["n"] > 0).select("win_id", F.size("by").alias("length"), "by"), "queries")
    found = None
    for block in _blocks(ranked, "win_id", BLOCK_WINDOWS):
        first = block.select("win_id", "length", F.col("by")[0]["term_id"].alias("term_id"), F.col("by")[0]["offset"].alias("offset"))
        starts = postings.join(F.broadcast(first), "term_id").select("row", "win_id", "length", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
        # the next rarest list
        second = block.select("win_id", F.get("by", F.lit(1))["term_id"].alias("term_id"), F.get("by", F.lit(1))["offset"].alias("offset")).where("term_id is not null")
        lists = postings.join(F.broadcast(second.select("term_id").distinct()), "term_id", "left_semi")
        both = starts.where("length > 1").join(F.broadcast(second), "win_id").withColumn("pos", F.col("start") + F.col("offset")).join(lists, ["row", "term_id", "pos"])
        both = scratch.table(starts.where("length = 1").select("row", "win_id", "start", "length").unionByName(both.select("row", "win_id", "start", "length")), "starts")
        # all others
        rest = block.where("length > 2").select("win_id", F.explode(F.slice("by", F.lit(3), F.col("length"))).alias("one")).select("win_id", "one.term_id", "one.offset")
        asked = both.where("length > 2").join(F.broadcast(rest), "win_id").select("row", "win_id", "start", "length", "term_id", (F.col("start") + F.col("offset")).alias("pos"))
        lists = _near(postings, both.where("length > 2").select("row").distinct())
        all_of = asked.join(lists, ["row", "term_id", "pos"]).groupBy("row", "win_id", "start", "length").agg(F.count("*").alias("held")).where("held = length - 2")
        whole = both.where("length <= 2").unionByName(all_of.drop("held")).select("row", "win_id", "start", "length")
        found = whole if found is None else found.unionByName(whole)
    return scratch.table(found, "phrases")


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """(row, first, second, pos, second_pos): where both terms of ``pairs`` (ids first, second) stand within so many words.

    Positions are cut into blocks of ``within``; what is near lies in the same block or in one beside it.
    """
    postings = index.where("term_id is not null").select("row", "term_id", "pos")
    block = lambda c: F.floor(F.col(c) / within)
    x = postings.join(F.broadcast(pairs), F.col("term_id") == F.col("first")).select("row", "first", "second", "pos", F.explode(F.array(*(block("pos") + k for k in (-1, 0, 1)))).alias("block"))
    ends = pairs.select(F.col("second").alias("term_id")).distinct()
    y = postings.join(F.broadcast(ends), "term_id").select("row", F.col("term_id").alias("second"), F.col("pos").alias("second_pos"), block("pos").alias("block"))
    return x.join(y, ["row", "second", "block"]).where((F.col("pos") != F.col("second_pos")) & (F.abs(F.col("pos") - F.col("second_pos")) <= within)).select("row", "first", "second", "pos", "second_pos")


def test_windows(benchmark: DataFrame, scratch: Scratch, size: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct windows (win_id, terms), their terms (term, term_id), and the items that hold them (win_id, item)."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words_column(F.col("text").cast("string")).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    held = items.where(F.size("words") > 0).withColumn("at", F.explode(starts)).select("item", F.slice("words", F.col("at"), F.lit(size)).alias("win")).distinct()
    distinct = scratch.table(numbered(held.select("win").distinct(), "win_id"), "windows")
    terms = scratch.table(numbered(distinct.select(F.explode("win").alias("term")).distinct(), "term_id"), "terms")
    spelt = distinct.select("win_id", F.posexplode("win").alias("k", "term")).join(terms, "term").groupBy("win_id").agg(F.array_sort(F.collect_list(F.struct("k", "term_id"))).alias("by"))
    windows = scratch.table(spelt.select("win_id", F.transform("by", lambda x: x["term_id"]).alias("terms")), "spelt")
    return windows, terms, scratch.table(held.join(distinct, "win").select("win_id", "item"), "held")


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    scratch = Scratch(documents.sparkSession)
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash"), words_column(text).alias("words"))
    windows, terms, held = test_windows(benchmark, scratch, size)
    index = positional_index(docs, terms, scratch)
    phrases = phrase_matches(index, windows, scratch)
    # the union of intervals of a document: each adds what lies beyond the furthest end so far
    spans = phrases.groupBy("row", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    items = phrases.select("row", "win_id").distinct().join(held, "win_id").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("found"))
    lengths = index.where("term_id is null").select("row", "doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    joined = lengths.join(covered.join(items, "row"), "row", "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    judged = joined.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(found, ","), "UTF-8"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
    return scratch.only(judged, "judged")


def uncontaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``documents``, all columns, that aren't contaminated."""
    bad = sent_if_few(contamination(documents, benchmark, size, share).where("contaminated").select(F.col("doc_id").alias("_paperloom_id"), F.col("text_hash").alias("_paperloom_hash")).distinct(), BROADCAST_ROWS)
    text_hash = F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0))
    same = text_hash.eqNullSafe(F.col("_paperloom_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_paperloom_id"))
    return documents.join(bad, same, "left_anti").select(*documents.columns)
