"""Filtered scans and single aggregates over a table."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countspark.plans.filters import AGGREGATES, aggregate_of, predicate


@dataclass(frozen=True)
class Catalog:
    """A place that holds tables as Parquet: root/name.parquet, or catalog tables where root is None."""

    spark: SparkSession
    root: str | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name) if self.root is None else self.spark.read.parquet(f"{self.root.rstrip('/')}/{PurePosixPath(name)}.parquet")


def query(df: DataFrame, filters: str | list[str] | None = None, limit: int | None = None, offset: int = 0, order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows that pass the filters. Give an order with a limit or offset, or which rows they are is left to the scan."""
    out = df.filter(predicate(df, filters))
    if order:
        out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*columns) if columns else out


def count_only(df: DataFrame, filters: str | list[str] | None = None) -> DataFrame:
    """One row (value): the number of rows that pass; no row leaves the executors."""
    return df.agg(F.count_if(predicate(df, filters)).alias("value"))


def aggregate(df: DataFrame, agg: str, filters: str | list[str] | None = None) -> DataFrame:
    """One row (value) for "field:function(range)" over the rows that pass the range and the filters; null over none."""
    fn, field, within = aggregate_of(df, agg)
    kept = df.filter(predicate(df, filters) & within)
    return kept.agg((F.count("*") if fn == "count" else AGGREGATES[fn](field)).alias("value"))


def scalar(df: DataFrame) -> float:
    """The number that aggregate() holds, 0.0 over no rows."""
    value = df.first()[0]
    return 0.0 if value is None else float(value)


def count_upper_bound(df: DataFrame, filters: list[str]) -> DataFrame:
    """One row (value): the least count over the filters with any one left out, which bounds the count with all of them."""
    counts = [F.count_if(predicate(df, [f for j, f in enumerate(filters) if j != i])) for i in range(len(filters))] or [F.count("*")]
    return df.agg((F.least(*counts) if len(counts) > 1 else counts[0]).alias("value"))


def sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows in the order of a digest of the seed and the keys, so that the same rows come whatever the partitions."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(digest, *keys).limit(n)
