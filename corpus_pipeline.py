"""From raw documents to packed training sequences.

Each stage works on all that the one before kept; stages are written as Parquet in the shared
folder and read again, so a lost executor costs at most the stage that runs.

All stages but the last return every column of their input, whatever it is named, and rows in no
order. Texts are taken whole, however long. An empty table gives an empty table. What each stage does
with nulls, empty texts, ties and repeated rows is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.decontaminate import uncontaminated
from paperloom.llm.near_dup import one_of_each
from paperloom.llm.packing import pack
from paperloom.llm.pii import redact_personal_data
from paperloom.llm.quality import good_documents
from paperloom.llm.shared import drop_path, new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go.

    A null or empty text scores the share of good labels in the sample; without any label all stay
    (0.5 is no rejection). Repeated rows score alike; a missing id changes nothing.
    """
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, and of its repeated rows one.

    Rows without an id go if a document with an id, or another such row that stays, has their shingle
    set; what is only near to them doesn't remove them, and those without words all stay.
    """
    return one_of_each(docs, words=5, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Null and empty texts, and those without words, stay. Rows are judged by their text, so repeated
    rows and rows without an id go or stay alike. An empty benchmark leaves all.
    """
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts; no document goes.

    Null texts stay null and empty ones empty; repeated rows change alike. Where spans overlap the
    first names the replacement. ``n_chars`` is counted anew.
    """
    return redact_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences.

    A null or empty text is one piece, of the closing id. Repeated rows, and rows without an id, are
    packed one by one, each with pieces of its own.
    """
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("packing", packing)]

#: SQL can't express the classifier, the field and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # nothing reads it any more
            drop_path(spark, before)
        before = path
    return docs
