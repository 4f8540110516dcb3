"""Tables that a job writes on its way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions without spark.checkpoint.dir, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which a cluster must set.

    A session with a local master, as in tests, has one machine only and gets a temporary folder where it is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="groundspark-")
    return _LOCAL_FOLDERS[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as Parquet in the shared folder, read again: its lineage ends there, and lost executors don't matter."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    folder, store = _folder(spark, path)
    store.delete(folder, True)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Names in a folder of the shared store with their times of change in seconds; none if there is no such folder."""
    folder, store = _folder(spark, path)
    return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in store.listStatus(folder)] if store.exists(folder) else []


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text at once; False, and nothing changed, if there is one.

    The text is written beside it first. Stores with an atomic rename refuse an existing target; a local disk, where a
    rename would replace it, gets a second link to the file instead."""
    target, store = _folder(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if store.exists(target):
            return False
        if store.getScheme() == "file":
            nio, local = spark._jvm.java.nio.file, lambda p: spark._jvm.java.io.File(store.makeQualified(p).toUri().getPath()).toPath()
            nio.Files.createLink(local(target), local(draft))
            return True
        return store.rename(draft, target)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    finally:
        store.delete(draft, False)


def spread(df: DataFrame) -> DataFrame:
    """The table in as many partitions as the session has cores at least; a table of more is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
