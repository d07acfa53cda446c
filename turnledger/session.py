"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session made by this package; a session that is handed in keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call sites are looked up for every column otherwise, which takes longer than planning
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_WRITTEN: list[str] = []


def build_session(app: str = "turnledger", master: str | None = None, **conf: object) -> SparkSession:
    """A session with DEFAULTS; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master may do without: it gets a temporary
    folder. Anywhere else that would be each machine's own disk, so it is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="turnledger-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(local)
        shared = spark.sparkContext.getCheckpointDir()
    return str(shared)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back: cuts lineage, survives lost executors. What is
    written goes when the application ends, or with ``discard``."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _files(spark, path, "deleteOnExit")
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str, call: str, *more) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    getattr(where.getFileSystem(spark._jsc.hadoopConfiguration()), call)(where, *more)


def discard(spark: SparkSession) -> None:
    """Deletes everything written so far. Only for the end of a query: its DataFrames read these files."""
    while _WRITTEN:
        _files(spark, _WRITTEN.pop(), "delete", True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
