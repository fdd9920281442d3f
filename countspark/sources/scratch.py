"""Tables written between two steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may leave it unset (tests), since executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or f"file://{tempfile.gettempdir()}/countspark-scratch").rstrip("/") + "/countspark"


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped: the folder belongs to the cluster's housekeeping then
        return
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table that is the same whenever it is read, whatever executor is lost; it is deleted when the session's driver ends."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def exclusive(spark: SparkSession, path: str, said: str) -> bool:
    """Create a file that nobody else has created, and write into it; False if it is there already."""
    jvm = spark.sparkContext._jvm
    fs, where = filesystem(spark, path)
    fs.mkdirs(where.getParent())
    local = fs.getUri().getScheme() == "file"  # whose create() looks first and creates then
    if local and not jvm.java.io.File(where.toUri().getPath()).createNewFile():
        return False
    try:
        out = fs.create(where, local)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or "AlreadyBeingCreated" in str(e.java_exception):
            return False
        raise
    out.writeBytes(said)
    out.close()
    return True


def text_of(spark: SparkSession, path: str) -> str:
    """What a small file holds."""
    fs, where = filesystem(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it isn't there."""
    fs, where = filesystem(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []
