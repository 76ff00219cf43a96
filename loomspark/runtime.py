"""Session set-up, shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes on disk, of a written table up to which it may be sent to every task.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20

_shipped: set[str] = set()
_own_dir: dict[str, str] = {}


def get_spark(app: str = "loomspark", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; settings that a cluster already has win."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine.

    On a cluster without the setting this raises, for a folder of the driver's is none of the executors'.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        path = tempfile.mkdtemp(prefix="loomspark-")
        atexit.register(shutil.rmtree, path, True)
        _own_dir[app] = f"file://{path}"
    return _own_dir[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has already ended
        pass


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder for a file that is written and read again; removed when the driver ends."""
    path = f"{shared_dir(spark)}/loomspark-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _bytes_of(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table that materialize wrote has at most `limit` rows and `most` bytes; read from the files' footers and sizes."""
    return _bytes_of(df.sparkSession, df._written) <= most and df.count() <= limit


def join_checked(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join; the right side is written first unless it is a written table, and broadcast only if that one is small, else both are shuffled."""
    table = right if hasattr(right, "_written") else materialize(right, "side")
    return left.join(F.broadcast(table) if small(table, limit) else table, on, how)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, for clusters whose executors have no copy of the repository."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    base = tempfile.mkdtemp(prefix="loomspark-zip-")
    atexit.register(shutil.rmtree, base, True)
    stage = os.path.join(base, "stage")
    shutil.copytree(root, os.path.join(stage, root.name), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(base, "loomspark_pkg"), "zip", stage))
    _shipped.add(app)


def read(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")
