"""Keyed tables for micro-batches: rows lie in folders by a hash of their key, and a batch touches only its own.

A table is a set of Parquet folders, one for each bucket that has rows. A batch replaces the buckets
of its keys by new folders under its own version, and says so in one small file; what readers of an
older version use is never overwritten, and a repeated batch writes its version again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import few


@dataclass(frozen=True)
class Keyed:
    """A table's schema and keys; ``route``, a SQL expression of the keys, decides the bucket (all keys, if none is given)."""

    schema: T.StructType
    keys: list[str]
    route: str | None = None

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*([F.expr(self.route)] if self.route else map(F.col, self.keys))), F.lit(buckets))


#: Files of a bucket from which its rows are brought together when it is written again.
CROWDED = 4


class KeyedTables:
    """The tables of one folder. Buckets should be about as many as a table has files of a good size; their number is fixed."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Keyed], buckets: int = 64, keep: int = 20):
        self.spark, self.root, self.tables, self.buckets, self.keep = spark, root.rstrip("/"), tables, buckets, keep
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- versions: which folder holds each bucket

    def _listed(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._listed("versions") if n.endswith(".json"))

    def _places(self, before: int | None) -> dict[str, dict[str, int]]:
        """Of each table the version that each bucket was written in, as of the newest version (older than ``before``)."""
        last = max((v for v in self.versions() if before is None or v < before), default=None)
        if last is None:
            return {name: {} for name in self.tables}
        stream = self._fs.open(self._path(f"{self.root}/versions/{last}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, places: dict[str, dict[str, int]]) -> None:
        draft = self._path(f"{self.root}/drafts/{version}.json")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(places).encode()))
        stream.close()
        final = self._path(f"{self.root}/versions/{version}.json")
        self._fs.mkdirs(final.getParent())
        self._fs.delete(final, False)
        self._fs.rename(draft, final)

    def _folder(self, table: str, version: int, bucket: int | str) -> str:
        return f"{self.root}/{table}/version={version}/bucket={bucket}"

    # -- rows

    def touched(self, table: str, rows: DataFrame) -> set[int]:
        """The buckets of rows that have the columns which decide it: at most as many numbers as there are buckets."""
        return {r[0] for r in rows.select(self.tables[table].bucket(self.buckets).alias("b")).distinct().collect()}

    def read(self, table: str, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """A table's rows, or those of the buckets ``only``; other folders aren't opened."""
        places = self._places(before)[table]
        paths = [self._folder(table, v, b) for b, v in sorted(places.items()) if only is None or int(b) in only]
        schema = self.tables[table].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _next(self, table: str, kept: DataFrame, changed: DataFrame, crowded: bool) -> DataFrame:
        """What the touched buckets hold afterwards; stored rows stay in the tasks that read them, unless their files are many."""
        bucket = self.tables[table].bucket(self.buckets)
        kept = kept.join(few(changed.select(*self.tables[table].keys)), self.tables[table].keys, "left_anti")
        if crowded:
            return kept.unionByName(changed).withColumn("bucket", bucket).repartition("bucket")
        return kept.withColumn("bucket", bucket).unionByName(changed.withColumn("bucket", bucket).repartition("bucket"))

    def write(self, version: int, changes: dict[str, DataFrame]) -> None:
        """Put the rows of a version, each key at most once, in place of what their keys had."""
        places = self._places(version)
        for name, df in changes.items():
            schema = self.tables[name].schema
            # changes may be read from the very buckets that they replace, so they are fixed first
            draft = f"{self.root}/drafts/{name}-{version}"
            df.select(*schema.names).write.mode("overwrite").parquet(draft)
            changed = self.spark.read.schema(schema).parquet(draft)
            buckets = self.touched(name, changed)
            if buckets:
                crowded = any(str(b) in places[name] and len(self._listed(self._folder(name, places[name][str(b)], b).removeprefix(f"{self.root}/"))) > CROWDED for b in buckets)
                rows = self._next(name, self.read(name, version, buckets), changed, crowded)
                rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/version={version}")
                places[name] |= {str(b): version for b in buckets}
            self._fs.delete(self._path(draft), True)
        self._commit(version, places)
        self._forget(version)

    def _forget(self, version: int) -> None:
        """Drop versions that nobody may ask for any more, and the folders that only they name."""
        known = [v for v in self.versions() if v <= version]
        for v, after in list(zip(known, known[1:], strict=False))[: max(0, len(known) - self.keep)]:
            stays = self._places(after + 1)
            for name, buckets in self._places(v + 1).items():
                for b, at in buckets.items():
                    if stays[name].get(b) != at:
                        self._fs.delete(self._path(self._folder(name, at, b)), True)
            self._fs.delete(self._path(f"{self.root}/versions/{v}.json"), False)
