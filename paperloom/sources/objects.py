"""The object store: listings and text objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import object_key

STORED = "key string, text string, bytes long, version long, year string, month string"


def file_view(objects: DataFrame) -> DataFrame:
    """name, size and lastModified with their defaults."""
    return objects.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("lastModified", F.timestamp_seconds(F.lit(0))).alias("lastModified"))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """All objects below ``root``; their bytes aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return file_view(found.select(F.col("path").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("lastModified")))


def store_texts(texts: DataFrame, root: str, version: int = 0) -> None:
    """Put texts (id, text) under their keys, below version, year and month.

    A version is written whole, and again if its batch is repeated; it replaces single objects of
    earlier versions, never their month (see ``stored_texts``).
    """
    keyed = texts.withColumn("key", object_key(F.col("id"))).withColumn("parts", F.split("key", "/"))
    rows = keyed.select("key", "text", F.octet_length("text").cast("long").alias("bytes"), F.element_at("parts", 1).alias("year"), F.element_at("parts", 2).alias("month"))
    rows.write.mode("overwrite").partitionBy("year", "month").parquet(f"{root.rstrip('/')}/version={version}")


def stored_texts(spark: SparkSession, root: str) -> DataFrame:
    """key, text and bytes of each object, as written last."""
    rows = spark.read.schema(STORED).parquet(root)
    return rows.groupBy("key").agg(F.max_by(F.struct("text", "bytes"), "version").alias("last")).select("key", "last.text", "last.bytes")
