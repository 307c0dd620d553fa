"""Tables that are written once and read by many queries of a session."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables of each application by name and state of their source, and all folders that this module has written.
_BUILT: dict[tuple[str, str, str, str], str] = {}
_WRITTEN: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share, spark.checkpoint.dir; without it one of this machine if all tasks run in the driver, else none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        root = tempfile.mkdtemp(prefix="vicinia-tables-")
    return root.rstrip("/") if root else None


def new(spark: SparkSession, name: str) -> str:
    """A path of its own in that folder; on a cluster spark.checkpoint.dir has to name one."""
    root = folder(spark)
    if root is None:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def state(spark: SparkSession, source: str) -> str:
    """A digest of names, sizes and times of a folder's files: another one as soon as any of them changes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    files, seen = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def built(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame], write: Callable[[DataFrame, str], None]) -> DataFrame:
    """The table `name` over a source folder, written at its first use in an application and again when files of the folder have changed;
    worked out anew each time where there is no folder for it."""
    if folder(spark) is None:
        return make()
    key = (spark.sparkContext.applicationId, name, source, state(spark, source))
    if key not in _BUILT:
        path = new(spark, name)
        write(make(), path)
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key])


def release(spark: SparkSession) -> int:
    """Delete all tables that this module has written for the application; call it when its results have been read."""
    mine = spark.sparkContext.applicationId
    for k in [k for k in _BUILT if k[0] == mine]:
        del _BUILT[k]
    paths = _WRITTEN.pop(mine, [])
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared folder: lineage ends there, and what several plans read is worked out once."""
    path = new(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
