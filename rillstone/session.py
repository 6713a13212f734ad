"""What every module needs of the session: tables, the shared folder, microseconds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` of the folder ``root``, as it lies in Parquet."""
    return spark.read.parquet(f"{root}/{name}.parquet")


#: The folder of sessions that name none.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A cluster has to name one, else executors would write to disks that others can't read: that is an error. Only where
    everything runs in this process (``local`` masters, as in tests) it makes a temporary folder, once.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.conf.get("spark.master", None) or "local"
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="rillstone-"))
    return _OWN[0]


#: Paths handed out by :func:`scratch_dir` and not yet swept.
_SCRATCH: list[str] = []


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder. It stays, for results may be read from it later, until :func:`sweep`."""
    _SCRATCH.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def sweep(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder; frames that read from it can't be used any more. Gives the number of paths."""
    n = len(_SCRATCH)
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = scratch_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC of a column: timestamps without zone mean UTC whatever the session's zone is."""
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampNTZType):
        c = f"`{name}`"
        return F.expr(f"unix_date(to_date({c})) * 86400000000L + hour({c}) * 3600000000L + minute({c}) * 60000000L + cast(extract(second from {c}) * 1000000 as bigint)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    return col.cast("bigint")
