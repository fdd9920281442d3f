"""Batch ingest that can be stopped and started again: each micro-batch is written once, and a ledger says which are whole.

A batch's rows go to target/batch=K, overwriting what a stopped run may have left there; the ledger's rows of the batch, one for each file, follow. The
stream's checkpoint gives a batch the same number and the same files when it is run again, so nothing is repeated or skipped. Readers take
the rows of batches that the ledger calls done.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countspark.sources.scratch import exclusive, filesystem

LEDGER = "batch long, file string, n long, state string, at timestamp"


def files(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", at_once: int = 100) -> DataFrame:
    """New files of a folder as a stream of their rows and, as _file, the file that each is from."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).format(kind).load(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"))


def ingest(stream: DataFrame, target: str, ledger: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, before_done: Callable[[int], None] | None = None) -> None:
    """Take in all that is there now, in batches. One run at a time: a second one finds the lock and fails.

    prepare: what is done to a batch's rows before they are written; it keeps _file. before_done: called between a batch's rows and its ledger.
    A run that was killed leaves its lock, which break_lock() removes.
    """
    spark = stream.sparkSession

    def noted(rows: DataFrame, batch: int, state: str) -> None:
        at = F.lit(datetime.now(timezone.utc)).cast("timestamp")
        said = rows.select(F.lit(batch).cast("long").alias("batch"), "file", F.col("n").cast("long"), F.lit(state).alias("state"), at.alias("at"))
        said.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/part={batch}")

    def take(rows: DataFrame, batch: int) -> None:
        noted(spark.createDataFrame([(None, None)], "file string, n long"), batch, "started")
        (prepare(rows) if prepare else rows).write.mode("overwrite").parquet(f"{target}/batch={batch}")
        if before_done:
            before_done(batch)
        noted(spark.read.parquet(f"{target}/batch={batch}").groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("n")), batch, "done")

    if not exclusive(spark, f"{ledger}/_lock", "running"):
        raise RuntimeError(f"another run holds {ledger}/_lock")
    try:
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        break_lock(spark, ledger)


def break_lock(spark: SparkSession, ledger: str) -> None:
    fs, where = filesystem(spark, f"{ledger}/_lock")
    fs.delete(where, False)


def progress(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger (batch, file, n, state, at): one row for each file of a batch that is done, one without a file for a batch that isn't."""
    return spark.read.schema(LEDGER).parquet(ledger)


def complete(spark: SparkSession, target: str, ledger: str, schema: T.StructType) -> DataFrame:
    """The rows of whole batches, with batch and _file."""
    known = T.StructType([*schema.fields, T.StructField("_file", T.StringType()), T.StructField("batch", T.LongType())])
    done = progress(spark, ledger).filter("state = 'done'").select("batch").distinct()
    return spark.read.schema(known).option("basePath", target).parquet(target).join(done, "batch", "left_semi")
