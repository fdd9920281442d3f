"""Reports as tidy DataFrames, and one plain renderer."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countspark.functions.math import DOUBLING, SECOND_EXPONENT, linear_cost, power_law
from countspark.operators import metrics
from countspark.operators.ordering import paired


def comparison(scored: dict[str, DataFrame], threshold: float = 0.5, **how) -> DataFrame:
    """(model, metrics): one row for each model's scored test rows."""
    out = None
    for name, df in scored.items():
        row = metrics.metrics(df, threshold=threshold, **how).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def confusion_cells(scored: DataFrame, pred: str = "pred", label: str = "y", weight: str | None = None) -> DataFrame:
    """(actual, predicted, n). weight: a column of how many rows a row stands for."""
    n = F.count("*") if weight is None else F.sum(weight)
    return scored.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(n.alias("n"))


def validation(a: DataFrame, b: DataFrame, key: list[str], label: str = "y", order: list[str] | None = None) -> DataFrame:
    """One row: how often two models agree on the same rows, and their accuracies.

    Where keys are shared, order names columns that both tables have: rows of a key then pair by their place in that order.
    """
    if order is None:
        joined = a.select(*key, label, F.col("pred").alias("_a")).join(b.select(*key, F.col("pred").alias("_b")), key)
    else:
        both = paired(a.select(*key, *order, "pred"), b.select(*key, *order, "pred"), key, order)
        joined = both.filter(F.col("pred").isNotNull() & F.col("pred_b").isNotNull()).select(label, F.col("pred").alias("_a"), F.col("pred_b").alias("_b"))
    share = lambda c, n: F.avg(c.cast("double")).alias(n)
    return joined.agg(F.count("*").alias("n"), share(F.col("_a") == F.col("_b"), "agreement"), share(F.col("_a") == F.col(label), "accuracy_a"), share(F.col("_b") == F.col(label), "accuracy_b"))


def decisions(scored: DataFrame, columns: list[str], n: int = 5, risk: str = "risk", threshold: float = 0.5, order: list[str] | None = None) -> DataFrame:
    """The first n denied and the first n approved rows, in the order given."""
    said = F.when(F.col(risk) >= threshold, "DENY").otherwise("APPROVE")
    out = scored.withColumn("decision", said).select(*columns, risk, "decision")
    some = lambda d: (out.filter(F.col("decision") == d).orderBy(*order) if order else out.filter(F.col("decision") == d)).limit(n)
    return some("DENY").union(some("APPROVE"))


def importance_match(a: DataFrame, b: DataFrame, within: float = 0.15) -> DataFrame:
    """(feature, a, b, match) of two models' importances."""
    joined = a.select("feature", F.col("importance").alias("a")).join(b.select("feature", F.col("importance").alias("b")), "feature")
    return joined.withColumn("match", F.abs(F.col("a") - F.col("b")) < within)


def scaling(spark: SparkSession, seconds: float, rows: int, to_rows: list[int]) -> DataFrame:
    """(rows, seconds by the doubling law and by the second exponent)."""
    at = spark.createDataFrame([(n,) for n in to_rows], "row_count long")
    return at.select("row_count", power_law(seconds, rows, F.col("row_count"), DOUBLING).alias("seconds"), power_law(seconds, rows, F.col("row_count"), SECOND_EXPONENT).alias("seconds_second"))


def cost(spark: SparkSession, records: list[int], seconds_each: float, dollars_an_hour: float) -> DataFrame:
    at = spark.createDataFrame([(n,) for n in records], "records long")
    return at.withColumn("dollars", linear_cost(F.col("records"), seconds_each, dollars_an_hour))


@dataclass
class Timings:
    """Wall-clock times of named steps."""

    rows: list[tuple[str, float]] = field(default_factory=list)

    @contextmanager
    def step(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter() - began))

    def summary(self, spark: SparkSession) -> DataFrame:
        """(step, n, least, mean, most, total, p50, p95) in seconds."""
        s = F.col("s")
        df = spark.createDataFrame(self.rows, "step string, s double")
        return df.groupBy("step").agg(F.count("*").alias("n"), F.min(s).alias("least"), F.avg(s).alias("mean"), F.max(s).alias("most"), F.sum(s).alias("total"), F.percentile(s, 0.5).alias("p50"), F.percentile(s, 0.95).alias("p95"))


def side_by_side(rows: DataFrame, measures: list[str], model: str = "model", first: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, metric, a column for each model, delta, best): metrics of models as a table, one row for each metric.

    rows: a row for each model (and each value of by), as comparison() gives. delta: the largest distance of a model from the first one; best: the models
    that share the largest value, in alphabetical order. As many rows come to the driver as there are models.
    """
    models = sorted(r[0] for r in rows.select(model).distinct().collect())
    models = [first, *[m for m in models if m != first]] if first else models
    tall = rows.unpivot([*(by or []), model], measures, "metric", "value")
    wide = tall.groupBy(*(by or []), "metric").pivot(model, models).agg(F.first("value"))
    others = [F.abs(F.col(m) - F.col(models[0])) for m in models[1:]]
    most = F.greatest(*[F.col(m) for m in models]) if len(models) > 1 else F.col(models[0])
    best = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(m) == most, F.lit(m)) for m in models]))), ",")
    delta = F.greatest(*others) if len(others) > 1 else others[0] if others else F.lit(0.0)
    return wide.select(*(by or []), "metric", *models, delta.alias("delta"), best.alias("best"))


def training_summary(splits: dict[str, DataFrame], features: list[str], label: str = "y") -> DataFrame:
    """(split, n, n_pos, share_pos, n_features, n_values): what models are trained and tested on, one row for each table."""
    out = None
    for name, df in splits.items():
        row = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"), *[F.count_distinct(f).alias(f"_{i}") for i, f in enumerate(features)])
        row = row.select(F.lit(name).alias("split"), "n", "n_pos", F.try_divide(F.col("n_pos").cast("double"), F.col("n")).alias("share_pos"), F.lit(len(features)).alias("n_features"), sum((F.col(f"_{i}") for i in range(len(features))), F.lit(0)).alias("n_values"))
        out = row if out is None else out.unionByName(row)
    return out


def html(df: DataFrame, title: str = "", digits: int = 4, most: int = 1000) -> str:
    """A report table as HTML; larger tables than a report's are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    show = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(show(x))}</td>" for x in r) + "</tr>" for r in rows)
    return f"<table><caption>{escape(title)}</caption><tr>{head}</tr>{body}</table>"
