"""Small-cell suppression and anonymity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CELL = 11  # fixed value: cells below it are suppressed in health statistics


def midpoint(k: int) -> int:
    return max(1, k // 2)


def suppressed(count: Column, k: int = MIN_CELL) -> Column:
    """0 stays, 1 to k - 1 become the midpoint, k and more stay; k of 1 or less changes nothing."""
    return count if k <= 1 else F.when((count > 0) & (count < k), F.lit(midpoint(k))).otherwise(count)


def suppress(counts: DataFrame, columns: list[str], k: int = MIN_CELL) -> DataFrame:
    """Counts with the given columns suppressed, and how many of them were in each row."""
    hit = sum((((F.col(c) > 0) & (F.col(c) < k)).cast("int") for c in columns), F.lit(0)) if k > 1 else F.lit(0)
    return counts.withColumn("n_suppressed", hit).withColumns({c: suppressed(F.col(c), k) for c in columns})


def policy(k: int = MIN_CELL) -> str:
    return "none" if k <= 1 else f"cms_k{k}_fixed_midpoint_{midpoint(k)}"


def independence_estimates(pairs: DataFrame, marginals: DataFrame, n_total: int, k: int = MIN_CELL) -> DataFrame:
    """Pair counts of which those from 1 to k - 1 are what independence would give: count_a * count_b / n_total."""
    one = marginals.select("feature", "value", (F.col("n_pos") + F.col("n_neg")).alias("n"))
    a, b = (one.select(F.col("feature").alias(f"f{s}"), F.col("value").alias(f"v{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    joined = pairs.join(F.broadcast(a), ["fa", "va"]).join(F.broadcast(b), ["fb", "vb"])  # as large as the declared domains
    estimate = F.col("n_a") * F.col("n_b") / F.lit(float(n_total))
    small = (F.col("cnt") > 0) & (F.col("cnt") < k)
    return joined.select("fa", "va", "fb", "vb", F.when(small, estimate).otherwise(F.col("cnt").cast("double")).alias("cnt"))


def anonymity(df: DataFrame, quasi_ids: list[str], tiers: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """One row: the smallest class of equal quasi-identifiers, the number of classes, and whether each tier may be released."""
    smallest = df.groupBy(*quasi_ids).count().agg(F.min("count").alias("min_class"), F.count("*").alias("n_classes"))
    return smallest.select("*", *[(F.col("min_class") >= k).alias(f"release_k{k}") for k in tiers])


def split_allowed(left_pos: Column, right_pos: Column, k: int) -> Column:
    """A split is refused if it would show a side with 1 to k - 1 positives."""
    ok = lambda c: (c == 0) | (c >= k)
    return ok(left_pos) & ok(right_pos)
