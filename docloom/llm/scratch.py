"""Materialised intermediate tables in the cluster's shared folder.

Iterative and multi-pass operators cut their lineage by writing a table and
reading it back.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a local
temporary folder is made.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of this application's own below the shared folder."""
    root = f"{shared_dir(spark)}/docloom-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_roots: set[str] = set()


def _remove(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs the tasks that
    ran on it and never the passes before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` has written and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    roots = {f[: f.rindex("/")] for f in df.inputFiles()}
    for root in roots:
        if "/docloom-" in root:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What tasks keep in a Python worker for the next task, and the operator whose tasks ran last.
kept: list[dict] = []
_last: list[str] = [""]


def begin_task(operator: str) -> None:
    """Called first in a task: a reused worker gives back what tasks of another operator left in it."""
    if _last[0] != operator:
        _last[0] = operator
        for cache in kept:
            cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


#: Bytes of input for each partition of a result that is written by partition.
PARTITION_BYTES = 256 << 20


def n_partitions(df: DataFrame) -> int:
    """Partitions for the rows of ``df``: the session's number, or more where its input is large."""
    # the size that the optimizer takes the input to have, from its files
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // PARTITION_BYTES) if size < 1 << 60 else 0
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(wanted, 1 << 20))
