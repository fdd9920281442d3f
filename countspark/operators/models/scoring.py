"""Looking parameters up by feature value, and turning log scores into risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countspark.functions.math import sigmoid

MOST_IN_A_MAP = 256  # larger domains are joined


def attach(df: DataFrame, key: Column, values: dict[str, float], name: str, default: float) -> DataFrame:
    """df with a column that looks key up; small tables are a literal map in the expression, larger ones a broadcast join.

    The tables have an entry for each value of a declared domain at most.
    """
    if not values:
        return df.withColumn(name, F.lit(float(default)))
    if len(values) <= MOST_IN_A_MAP:
        table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        return df.withColumn(name, F.coalesce(F.try_element_at(table, key), F.lit(float(default))))
    rows = df.sparkSession.createDataFrame([(k, float(v)) for k, v in values.items()], f"_key string, {name} double")
    joined = df.withColumn("_at", key).join(F.broadcast(rows), F.col("_at") == F.col("_key"), "left").drop("_at", "_key")
    return joined.withColumn(name, F.coalesce(name, F.lit(float(default))))


def with_risk(df: DataFrame, log_pos: Column, log_neg: Column, strict: bool, threshold: float = 0.5) -> DataFrame:
    """df with log_pos, log_neg, risk and pred; strict: class 1 needs the larger log score, else the threshold."""
    out = df.withColumns({"log_pos": log_pos, "log_neg": log_neg})
    out = out.withColumn("risk", sigmoid(F.col("log_pos") - F.col("log_neg")))
    hit = F.col("log_pos") > F.col("log_neg") if strict else F.col("risk") >= threshold
    return out.withColumn("pred", hit.cast("int"))
