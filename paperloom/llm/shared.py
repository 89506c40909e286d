"""Shared storage, lineage cuts and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import in_small_batches as in_small_batches


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests), a folder of this process is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session has gone: the folder's owner cleans up
            pass

    atexit.register(remove)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there.

    Executors lost later cost no recomputation, and what follows may read it many times. The table
    stays until the driver ends; see ``Scratch`` for tables that go sooner.
    """
    return _written(df, new_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator in the shared folder, deleted as soon as nothing reads them."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self._spark, name)
        self._paths.append((made := _written(df, path), path))
        return made

    def drop(self, *tables: DataFrame) -> None:
        for table, path in self._paths:
            if any(table is t for t in tables):
                drop_path(self._spark, path)
        self._paths = [(table, path) for table, path in self._paths if not any(table is t for t in tables)]

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table; all others of this scratch go."""
        made = materialize(df, name)
        self.drop(*(table for table, _ in self._paths))
        return made


#: Keys that are sent to every task (a few MB); more are joined by a shuffle.
SENT_KEYS = 500_000


def sent_if_few(keys: DataFrame, most: int = SENT_KEYS) -> DataFrame:
    """Keys marked for a broadcast if a count finds at most so many; the same keys, unmarked, else."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def strings(column: pa.ChunkedArray | pa.Array) -> Iterator[str | None]:
    """Values of a string column, a few at a time, so that no second copy of a whole batch is held."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
