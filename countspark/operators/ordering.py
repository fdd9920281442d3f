"""Numbers for rows by their order, and pairs of rows of two tables by these numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countspark.sources.scratch import written


def occurrences(df: DataFrame, key: list[str], order: list[str], to: str = "_nth") -> DataFrame:
    """df with the number of each row, from 1, among those of its key.

    A key's rows may be many: they are sorted by ranges of key and order, so that a large key takes several tasks. Each task numbers
    its own rows, and a key goes on in the next range from where the ranges before it end: a row for each key that crosses a range.
    """
    by = [*key, *[c for c in order if c not in key]]
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))  # parts equal rows, whose order is no matter
    dealt = written(df.withColumn("_turn", turn).repartitionByRange(*by, "_turn").withColumn("_part", F.spark_partition_id()).drop("_turn"))
    here = Window.partitionBy("_part", *key).orderBy(*by)
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter("_base > 0")
    named = base.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)], F.col("_part").alias("_of"), "_base")
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_key{i}"))
    out = dealt.withColumn(to, F.row_number().over(here).cast("long")).join(named, same, "left")
    return out.withColumn(to, F.col(to) + F.coalesce("_base", F.lit(0))).select(*df.columns, to)


def paired(a: DataFrame, b: DataFrame, key: list[str], order: list[str], suffix: str = "_b") -> DataFrame:
    """Rows of two tables side by side: the first of a key with the first, the second with the second, and so on, in the same order on both sides.

    Columns of b but the key are renamed by a suffix. A row whose partner is missing stays, with nulls. Null keys pair like any other.
    """
    left, right = occurrences(a, key, order), occurrences(b, key, order)
    named = right.select(*[F.col(c).alias(f"{c}{suffix}") for c in right.columns])
    same = F.col("_nth") == F.col(f"_nth{suffix}")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}{suffix}"))
    both = left.join(named, same, "full").withColumns({c: F.coalesce(c, f"{c}{suffix}") for c in key})
    return both.drop("_nth", f"_nth{suffix}", *[f"{c}{suffix}" for c in key])
