"""The session that the library expects."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def session(name: str = "paperloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI SQL and adaptive plans; sizes are left to the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=fixed | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, unless their Python path is known to hold it already.

    The driver's own path says so only where the executors run in its place; a cluster's executors have theirs from the
    session's settings.
    """
    root = os.path.dirname(_PACKAGE)
    sc = spark.sparkContext
    theirs = os.environ.get("PYTHONPATH", "") if sc.master.startswith("local") else sc.getConf().get("spark.executorEnv.PYTHONPATH") or ""
    if root in map(os.path.abspath, filter(None, theirs.split(os.pathsep))) or getattr(sc, "_paperloom_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="paperloom-"), "paperloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    sc.addPyFile(archive)
    sc._paperloom_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``, deleted when the driver ends.

    The folder is shared by driver and executors, so lost executors cost nothing; only a session of one machine that names none
    gets a folder of its own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='paperloom-')}")
        root = sc.getCheckpointDir()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has gone: the folder's owner cleans up
            pass

    atexit.register(remove)
    return path


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table below ``shared_path``, read back: what follows doesn't compute it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of whole texts that a Python worker gets at a time; Spark's own bound of bytes holds beside it.
TEXT_ROWS = 1000


def in_small_batches(texts: DataFrame) -> DataFrame:
    """``texts``, for a Python worker; from here on this session sends at most ``TEXT_ROWS`` rows in a batch.

    A batch of texts is held by the JVM and by the worker, and so is what is made of it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(texts.sparkSession.conf.get(name)) <= TEXT_ROWS:
        texts.sparkSession.conf.set(name, str(TEXT_ROWS))
    return texts
