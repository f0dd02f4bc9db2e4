"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode where none is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lapgraph-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended already; its folder is scratch space
        pass


#: What ``materialize`` wrote within each call of ``settled`` that has not ended, the innermost last.
_within: list[list[DataFrame]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    The written files survive the loss of an executor, and what follows starts from them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _within:
        _within[-1].append(out)
    return out


def settled(make: Callable[..., DataFrame], *args) -> DataFrame:
    """``make(*args)``, written; the tables that ``make`` wrote on its way are deleted, so nothing else may read them."""
    _within.append([])
    try:
        out = materialize(make(*args))
        _within[-1].pop()
    finally:
        release(*_within.pop())
    if _within:
        _within[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path is not None:
            _remove(df.sparkSession, path)
            df._written_to = None


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder the driver runs in.

    On a cluster whose machines do not share that folder, the package is to be installed or sent with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    own = spark.sparkContext.environment
    paths = own.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        own["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
