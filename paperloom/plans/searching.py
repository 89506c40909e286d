"""Search over titles and graph nodes through a stored index of letter trigrams.

The index is two Parquet tables. ``texts`` has the texts, numbered as they were read; the number is a block's and a place
in it. ``grams`` has lists of places: a row for each trigram, block and some ``LETTERS`` letters of texts, in folders by a
hash of the trigram and ordered by it, so a query's few lists are read from their folders alone. A query intersects its
lists, the rarest first; what holds all trigrams is looked up and compared. Queries of fewer than three letters have no
trigram: their texts are read, all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import GRAM, few
from ..schemas import PAPER
from ..session import in_small_batches

FOLDERS = 64
TITLE, NODE = "title", "node"
TEXTS = "number long, kind string, id string, text string"
#: Texts of a block (places are 16-bit numbers), and letters that a task makes lists of at a time.
BLOCK, LETTERS = 1 << 15, 2 << 20
LISTS = "gram string, block long, places array<smallint>"


def node_texts(nodes: DataFrame) -> DataFrame:
    """What of graph nodes is searched: a paper's title, or else a node's name."""
    text = F.coalesce(F.when(F.col("label") == PAPER, F.col("props")["title"]), F.col("props")["name"])
    return nodes.select(F.lit(NODE).alias("kind"), F.col("element_id").alias("id"), text.alias("text"))


def title_texts(papers: DataFrame, key: str = "id", title: str = "title") -> DataFrame:
    return papers.select(F.lit(TITLE).alias("kind"), F.col(key).cast("string").alias("id"), F.col(title).alias("text"))


def _folder(column: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(folders)).cast("int")


def _lists_of(numbers: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Of some texts the rows of ``LISTS``."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    alphabet = np.flatnonzero(np.bincount(letters))
    size, n = len(alphabet), len(texts)
    if size**3 * n >= 1 << 63 and n > 1:
        for half in (slice(0, n // 2), slice(n // 2, n)):
            yield from _lists_of(numbers[half], texts[half])
        return
    rank = np.zeros(int(letters.max()) + 1, np.int64)
    rank[alphabet] = np.arange(size)
    ranks, owner = rank[letters], np.repeat(np.arange(n), [len(t) for t in texts])
    whole = owner[: 1 - GRAM] == owner[GRAM - 1 :]
    codes = np.zeros(len(whole), np.int64)
    for k in range(GRAM):
        codes = codes * size + ranks[k : k + len(whole)]
    keys = np.sort(codes[whole] * n + owner[: 1 - GRAM][whole])
    keys = keys[np.diff(keys, prepend=-1) != 0]
    codes, at = keys // n, numbers[keys % n]
    begins = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(at // BLOCK, prepend=-1) != 0))
    spelt = np.stack([alphabet[codes[begins] // size**k % size] for k in reversed(range(GRAM))], 1).astype("<u4").tobytes().decode("utf-32-le")
    grams = pa.array([spelt[k : k + GRAM] for k in range(0, len(spelt), GRAM)])
    places = pa.ListArray.from_arrays(pa.array(np.append(begins, len(at)).astype(np.int32)), pa.array((at % BLOCK).astype(np.int16)))
    yield pa.RecordBatch.from_arrays([grams, pa.array(at[begins] // BLOCK), places], names=["gram", "block", "places"])


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts (number, text) the rows of ``LISTS``. A very long text is cut; its pieces overlap."""
    numbers, texts, held = [], [], 0
    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            for at in range(0, len(text) - GRAM + 1, LETTERS):
                numbers.append(number)
                texts.append(text[at : at + LETTERS + GRAM - 1])
                held += len(texts[-1])
                if held >= LETTERS or len(texts) == BLOCK:
                    yield from _lists_of(np.array(numbers), texts)
                    numbers, texts, held = [], [], 0
    if texts:
        yield from _lists_of(np.array(numbers), texts)


@dataclass(frozen=True)
class TextIndex:
    """An index below ``root``; see the module's text. Case doesn't count."""

    spark: SparkSession
    root: str
    folders: int = FOLDERS

    def build(self, texts: DataFrame) -> TextIndex:
        """Write the index of texts (kind, id, text); rows without a text are found by no query and left out."""
        # stored before lists are made: the numbers then stay, whatever is computed again
        numbered = texts.where("text is not null").select(F.monotonically_increasing_id().alias("number"), "kind", "id", "text")
        numbered.write.mode("overwrite").parquet(f"{self.root}/texts")
        lists = in_small_batches(self._texts().select("number", F.lower("text").alias("lowered"))).mapInArrow(_lists, LISTS)
        lists = lists.withColumn("folder", _folder(F.col("gram"), self.folders))
        # a frequent trigram's list is long: its folder is written by several tasks, each part in order
        spread = F.pmod(F.xxhash64("block"), F.lit(8))
        lists.repartition("folder", spread).sortWithinPartitions("folder", "gram", "block").write.mode("overwrite").partitionBy("folder").parquet(f"{self.root}/grams")
        return self

    def _texts(self) -> DataFrame:
        return self.spark.read.schema(TEXTS).parquet(f"{self.root}/texts")

    def _lists(self, wanted: list[str]) -> DataFrame:
        """The lists of some trigrams; folders of no such trigram aren't opened."""
        numbers = self.spark.range(1).select(F.array(*(_folder(F.lit(g), self.folders) for g in wanted)).alias("folders")).first()["folders"]
        lists = self.spark.read.schema(f"{LISTS}, folder int").parquet(f"{self.root}/grams")
        return lists.where(F.col("folder").isin(*set(numbers)) & F.col("gram").isin(*wanted))

    def candidates(self, query: str) -> DataFrame | None:
        """Numbers of the texts that have all trigrams of the query; None for a query without any."""
        lowered = self.spark.range(1).select(F.lower(F.lit(query)).alias("q")).first()["q"]
        wanted = sorted({lowered[k : k + GRAM] for k in range(len(lowered) - GRAM + 1)})
        if not wanted:
            return None
        lists = self._lists(wanted)
        sizes = {r["gram"]: r["n"] for r in lists.groupBy("gram").agg(F.sum(F.size("places")).alias("n")).collect()}
        number = lists.select("gram", "block", F.explode("places").alias("place")).select("gram", (F.col("block") * BLOCK + F.col("place")).alias("number"))
        if len(sizes) < len(wanted):
            return number.where("false").select("number")
        first, *others = sorted(wanted, key=lambda g: (sizes[g], g))
        found = number.where(F.col("gram") == first).select("number").distinct()
        if others:
            rest = number.where(F.col("gram") != first).join(few(found), "number", "left_semi")
            found = rest.groupBy("number").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(others)).select("number")
        return found

    def search(self, query: str) -> DataFrame:
        """kind, id and text of what contains the query, whatever the case. The empty query finds every text."""
        hit = F.contains(F.lower("text"), F.lower(F.lit(query)))
        found = self.candidates(query)
        texts = self._texts() if found is None else self._texts().join(few(found), "number", "left_semi")
        return texts.where(hit).select("kind", "id", "text")
