"""Where a job keeps the tables it writes between steps.

Model answers must not be recomputed, and a lost executor must not cost them, so
steps that branch or loop write their result as a Parquet table in the folder the
cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode with none set."""
    sc = spark.sparkContext
    folder = spark.conf.get(_KEY, None) or sc.getConf().get(_KEY) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="promptmill-")
    sc.setCheckpointDir(folder)
    return shared_folder(spark)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    The table's exact size is known to the optimizer afterwards, so joins with a
    small written table broadcast it and joins with a large one do not.
    """
    path = folder or fresh_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` made, once nothing reads it any more."""
    spark = df.sparkSession
    folders = {name.rpartition("/")[0] for name in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``; none if there is no such path."""
    place, store = _place(spark, path)
    return [f.getPath().getName() for f in store.listStatus(place) if f.isDirectory()] if store.exists(place) else []


def finished(spark: SparkSession, path: str) -> list[str]:
    """Those that a Spark write has finished."""
    _, store = _place(spark, path)
    return [name for name in folders(spark, path) if store.exists(_place(spark, f"{path}/{name}/_SUCCESS")[0])]


def deleted(spark: SparkSession, path: str) -> None:
    place, store = _place(spark, path)
    store.delete(place, True)


def claimed(spark: SparkSession, staged: str, path: str) -> bool:
    """Give the folder ``staged`` the name ``path`` in one step; false if somebody else has that name.

    A rename onto a folder that is there moves it inside, so ``staged`` needs a name that readers pass over (``_...``).
    """
    place, store = _place(spark, path)
    store.mkdirs(place.getParent())
    if store.exists(place) or not store.rename(_place(spark, staged)[0], place):
        return False
    inside = _place(spark, f"{path}/{staged.rpartition('/')[2]}")[0]
    if store.exists(inside):
        store.delete(inside, True)
        return False
    return True


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows by ``keys`` when their files give fewer tasks than the session has cores.

    Meant for text work over a few files that cannot be split. A table of many files, or a
    stream, is left as it is.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
