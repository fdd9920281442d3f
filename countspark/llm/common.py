"""What the operators share: written intermediate tables, shipping the package, and connected components."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import warnings
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_CACHES: dict[str, Callable[[], None]] = {}
_AT_WORK = [""]


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Say how to clear what an operator keeps in a Python worker from task to task."""
    _CACHES[owner] = clear


def at_work(owner: str) -> None:
    """Called where an operator's task begins: what other operators have kept in this worker is let go, so that it holds the caches of one at a time."""
    if _AT_WORK[0] != owner:
        _AT_WORK[0] = owner
        for name, clear in _CACHES.items():
            if name != owner:
                clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local master may leave it unset (tests): executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or f"file://{tempfile.gettempdir()}/countspark-scratch").rstrip("/") + "/countspark"


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, whose files are deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._countspark_path = path
    return out


def drop(*dfs: DataFrame) -> None:
    """Delete tables that materialise() wrote, once nothing reads them any more."""
    for df in dfs:
        _delete(df.sparkSession, df._countspark_path)


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped: the folder belongs to the cluster's housekeeping then
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except (Py4JError, OSError) as e:
        warnings.warn(f"{path} could not be deleted: {e}", stacklevel=2)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.realpath(tempfile.mkdtemp(prefix="countspark-")) + "/countspark_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def _settled(edges: DataFrame) -> bool:
    """True if every edge leads from a member to its root: one parent each, and no parent is a child."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    wrong = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 or (c = 1 and p = 1)")
    return wrong.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node, component being its smallest node.

    Alternates two steps until every edge leads to a root: a node hands its larger neighbours to its smallest one, then
    its smaller neighbours. Each step is a min-aggregate, written out, and a join whose both sides are
    read plainly, so that a root with very many members is split by adaptive skew handling.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while not _settled(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = materialise(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(small.union(down.select("a", F.col("m").alias("b"))).distinct())
        drop(now, low, large, down)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def blocked(rows: DataFrame, keys: list[str], by: str, block: int) -> DataFrame:
    """Each row once for every task that needs it, with its block `own` and the columns i and j of the task, so that every
    pair of rows of a key meets in one whose blocks are theirs.

    A key with up to `block` rows is one task, (0, 0); a larger one is split into blocks by a hash of `by`, and each pair of blocks is a task.
    """
    large = materialise(rows.groupBy(*keys).count().filter(F.col("count") > block))
    blocks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(by, F.lit(7)), F.col("_blocks")).cast("int")
    return (
        rows.join(large, keys, "left")
        .withColumn("_blocks", blocks)
        .withColumn("own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("i", F.least("own", "_other"))
        .withColumn("j", F.greatest("own", "_other"))
        .drop("count", "_blocks", "_other")
    )
