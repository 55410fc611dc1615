"""Session defaults and the shared folders a job may write to."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; anything else is left to the cluster.

    ``master`` is only given in tests and in the bench: a cluster sets its own.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Falls back to a new temporary folder only on a local master, where driver
    and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="barloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, for one written table."""
    return f"{shared_dir(spark)}/{name}-{os.urandom(6).hex()}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    For iterative work and plans with several consumers: the lineage is cut at
    files every executor can reach, so a lost executor costs a re-read and not
    a recomputation of everything before it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete the folder that ``materialise`` wrote for a frame, once nothing reads it again."""
    for folder in {file.rpartition("/")[0] for file in stored.inputFiles()}:
        delete(stored.sparkSession, folder)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Inside, an action's shuffle files are deleted when it ends, so a job of many writes holds those of one at a time.

    For actions whose frames are not run again: a second run would work the shuffles out anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one at the path; false if there is. Of several writers one gets true."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    try:
        out = files.create(place, False)
    except Exception as error:
        if files.exists(place):
            return False
        raise error
    out.write(bytearray(text.encode()))
    out.close()
    return True


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Move a written folder to its final name; false if that name is taken."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    if exists(spark, target):
        return False
    return path(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(source), path(target))


def files_key(spark: SparkSession, *paths: str) -> str:
    """A name for the files under some paths as they are: their places, sizes and times, from a listing alone."""
    seen = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
        while found.hasNext():
            one = found.next()
            seen.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The size of what lies under a path, from the file system alone."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def folders(spark: SparkSession, path: str) -> list[str]:
    """What lies directly under a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [str(x.getPath()) for x in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)] if exists(spark, path) else []


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
