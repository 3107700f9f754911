"""Where intermediate tables live, and how their size decides a join's strategy.

Lineage is cut by writing Parquet under the shared folder named by ``spark.checkpoint.dir``; that folder
outlives executors. Only where the setting is missing and the master is this machine (local tests) a folder of our
own is used; on a cluster without the setting nothing is written. ``scope`` removes what was written within it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables up to so many rows and bytes may be broadcast.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 64 << 20
_OWN: dict[str, str] = {}
_SCOPES: list[list] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; from the session, or one of our own where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    return _OWN["dir"]


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tracewright-{what}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(hadoop_path)
    for scope_ in _SCOPES:
        scope_.append((files, hadoop_path))
    return path


@contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables made within are removed at its end, so the results must be written or gathered before."""
    made: list = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for files, path in made:
            files.delete(path, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a durable cut of the lineage."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the table is counted and found small, in rows and in bytes; else Spark picks a shuffle join.

    ``rows`` may be given where they are known and all columns are of fixed width.
    """
    if rows is None:
        long = [f.name for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
        rows, *sizes = df.agg(F.count("*"), *(F.sum(F.octet_length(F.col(c))) for c in long)).first()
        if sum(x or 0 for x in sizes) + 16 * len(df.columns) * rows > BROADCAST_BYTES:
            return df
    return F.broadcast(df) if rows <= most else df
