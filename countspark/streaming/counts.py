"""Incremental counts: every sufficient statistic is a sum, so a stream keeps it up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countspark.plans.spec import DatasetSpec


def record_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def json_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New files of wrapped JSON records, one a line, as a stream of flat rows."""
    wrapped = T.StructType([T.StructField("data", schema), T.StructField("schema", T.StringType())])
    return spark.readStream.schema(wrapped).json(path).select("data.*")


def marginal_stream(stream: DataFrame, spec: DatasetSpec) -> DataFrame:
    """(feature, value, n_pos, n_neg) so far; for update or complete mode. The state has an entry for each value."""
    y = F.col(spec.label)
    tall = spec.prepared(stream).unpivot([spec.label], spec.features, "feature", "value")
    return tall.groupBy("feature", "value").agg(F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"))


def windowed_counts(stream: DataFrame, time: str, by: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, by, n) of tumbling windows; a window is done, and its state dropped, when events are `late` past it."""
    timed = stream.withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def drain(counted: DataFrame, table: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now, into a table in memory; for small results such as counts."""
    query = counted.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counted.sparkSession.table(table)


def settle(counted: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now, into a table of files that holds the whole result: as large as the result may grow, and none of it on the driver."""
    write = lambda rows, _: rows.write.mode("overwrite").parquet(path)
    query = counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counted.sparkSession.read.schema(counted.schema).parquet(path)


def sink(counted: DataFrame, path: str, checkpoint: str):
    """Append closed windows to Parquet, exactly once; start it again with the same checkpoint to go on."""
    return counted.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
