"""Keyed tables without MERGE: from (current, batch) to the next state, by joins.

All are idempotent: the same batch again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept_table
from .within import names_within


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The earliest row of each key. One struct minimum combines on the map side, so a hot key sends one row a task."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    least = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("row")
    return rows.groupBy(key).agg(least).select(*(F.col("row")[c].alias(c) if c != key else F.col(key) for c in rows.columns))


def latest_of_each(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last value of each key."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


#: Keys of a batch that are sent to every task (a few MB); more are joined by a shuffle.
FEW_KEYS = 200_000


def few(keys: DataFrame, most: int = FEW_KEYS) -> DataFrame:
    """Keys marked for a broadcast if a count finds at most so many; the same keys, unmarked, else."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def insert_absent(current: DataFrame, batch: DataFrame, key: str, *order: str) -> DataFrame:
    """First write wins: of the batch only keys that are new, and of those the earliest row."""
    fresh = first_of_each(batch, key, *order).join(current.select(key), key, "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def update_by_key(current: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Set columns of matching rows, to null too; updates has unique keys."""
    new = updates.select(key, F.struct(*columns).alias("_new"))
    joined = current.join(new, key, "left")
    hit = F.col("_new").isNotNull()
    return joined.select(*(F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns))


def set_status(current: DataFrame, keys: DataFrame, key: str, status: str) -> DataFrame:
    """One column of matching rows; the others keep what they have."""
    marks = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return current.join(marks, key, "left").withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).select(*current.columns)


def merge_rows(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Match or create: rows whose keys aren't there yet, each once."""
    fresh = batch.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def rate_windows(requests: DataFrame, client: str, at: str, window: str, limit: int) -> DataFrame:
    """Per client and window the requests seen, and those allowed."""
    counted = requests.groupBy(client, F.window(at, window).alias("w")).agg(F.count("*").alias("seen"))
    return counted.select(client, F.col("w.start").alias("window_start"), "seen", F.least("seen", F.lit(limit)).cast("long").alias("allowed"))


def joined_in_order(rows: DataFrame, key: str, text: str, *order: str) -> DataFrame:
    """Texts of each key in order, each followed by a line feed."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(key).agg(parts.alias("parts")).select(key, F.concat(F.array_join(F.transform("parts", lambda p: F.coalesce(p[text], F.lit(""))), "\n"), F.lit("\n")).alias(text))


#: Letters of the pieces by which texts are looked up.
GRAM = 3


def contained(required: DataFrame, available: DataFrame, name: str = "name") -> DataFrame:
    """The distinct required names that an available name contains.

    Neither side is compared with the whole other one, and no available name is sent anywhere: see ``within``. The empty
    name is contained in any. Null names contain nothing and are contained in nothing.
    """
    wanted = required.select(name).where(F.col(name).isNotNull()).distinct()
    return names_within(kept_table(wanted, "names"), available.select(name))


def missing(required: DataFrame, available: DataFrame, name: str = "name") -> DataFrame:
    """Required names that no available name contains."""
    return required.join(contained(required, available, name), name, "left_anti")
