"""Reading a feed from a checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(feed: DataFrame, n: int, by: str = "published", pos: str = "pos") -> DataFrame:
    """The page that a feed serves: its n newest entries. What a burst pushes off the page is lost."""
    return feed.orderBy(F.desc(by), pos).limit(n)


def is_new(published: Column, checkpoint: str | Column | None) -> Column:
    """Later than the checkpoint, as text; without one, or with an empty one, all are new."""
    at = checkpoint if isinstance(checkpoint, Column) else F.lit(checkpoint).cast("string")
    return at.isNull() | (at == "") | (published > at)


def emitted(page: DataFrame, checkpoint: str | None, by: str = "published") -> DataFrame:
    """New entries of a page, which keeps its positions: the last position is emitted first."""
    return page.where(F.coalesce(is_new(F.col(by), checkpoint), F.lit(False)))


def oldest_first(entries: DataFrame, pos: str = "pos") -> DataFrame:
    """Entries in the order in which they are sent on: a page lists the newest first."""
    return entries.orderBy(F.desc(pos))


def advanced(entries: DataFrame, checkpoint: str | None, by: str = "published", pos: str = "pos") -> DataFrame:
    """The next checkpoint: the time of the entry emitted last, which need not be the largest; else the old one."""
    return entries.agg(F.coalesce(F.min_by(by, pos), F.lit(checkpoint).cast("string")).alias("checkpoint"))
