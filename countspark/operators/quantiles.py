"""Exact percentiles of a column by narrowing ranges: no sort of all values, and no map of them in one task.

Each wanted rank has a range of values that holds it. One pass gives a sketch's guess on either side of each rank (a bounded summary
that tasks merge), the next one exact counts below and up to these guesses, by which the range narrows to a few ten-thousandths of its rows.
A range that holds FEW rows at most comes to the driver as counted values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW = 4096  # rows of a range that are counted out
ACCURACY = 10_000  # of the sketch: its guesses are off by this part of the rows, at most


@dataclass
class Range:
    """Values from low to high, of which open ends are no part; so many rows are below it, and in it."""

    low: float
    high: float
    below: int
    inside: int
    open_low: bool = False
    open_high: bool = False

    def holds(self, v: Column) -> Column:
        return (v > self.low if self.open_low else v >= self.low) & (v < self.high if self.open_high else v <= self.high)

    def narrowed(self, rank: int, guesses: list[tuple[float, int, int]]) -> Range:
        """The part that holds a rank. guesses: rising values, the rows below each in all, and up to it."""
        low, below, open_low = self.low, self.below, self.open_low
        for value, less, upto in guesses:
            if rank < less:
                return Range(low, value, below, less - below, open_low, True)
            if rank < upto:
                return Range(value, value, less, upto - less)
            low, below, open_low = value, upto, True
        return Range(low, self.high, below, self.below + self.inside - below, open_low, self.open_high)


def order_statistics(df: DataFrame, column: str, ranks: list[int], few: int = FEW) -> dict[int, float]:
    """The values at ranks from 0 among those of the column that are not null; at most two passes for each narrowing."""
    v = F.col("v")
    given = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    values = given.filter(~F.isnan("v"))
    number = F.when(~F.isnan("v"), v)
    total, n, low, high = given.agg(F.count("*"), F.count(number), F.min(number), F.max(number)).first()
    if any(not 0 <= r < total for r in ranks):
        raise ValueError(f"ranks must be from 0 to {total - 1}")
    beyond, ranks = {r: math.nan for r in ranks if r >= n}, [r for r in ranks if r < n]
    at = {r: Range(low, high, 0, n) for r in ranks}
    while wide := [r for r, x in at.items() if x.low < x.high and x.inside > few]:
        guess = []
        for r in wide:
            x = at[r]
            share, off = (r - x.below + 0.5) / x.inside, 2 / ACCURACY
            guess.append(F.percentile_approx(F.when(x.holds(v), v), [max(0.0, share - off), min(1.0, share + off)], ACCURACY))
        guessed = {r: sorted(set(g)) for r, g in zip(wide, values.agg(*[g.alias(f"g{i}") for i, g in enumerate(guess)]).first())}
        asked = sorted({g for gs in guessed.values() for g in gs})
        found = values.agg(*[c for g in asked for c in (F.count_if(v < g), F.count_if(v <= g))]).first()
        counted = {g: (found[2 * i], found[2 * i + 1]) for i, g in enumerate(asked)}
        for r in wide:
            at[r] = at[r].narrowed(r, [(g, *counted[g]) for g in guessed[r]])
    out = {r: x.low for r, x in at.items() if x.low == x.high}
    last = {(x.low, x.high, x.open_low, x.open_high): x for r, x in at.items() if r not in out}
    if last:
        within = F.explode(F.array_compact(F.array(*[F.when(x.holds(v), F.lit(i)) for i, x in enumerate(last.values())])))
        rows = values.select(within.alias("i"), "v").groupBy("i", "v").count().collect()  # `few` for each range, at most
        for i, x in enumerate(last.values()):
            mine = sorted((r["v"], r["count"]) for r in rows if r["i"] == i)
            for r in (r for r in ranks if at[r] == x):
                so_far = x.below
                for value, times in mine:
                    so_far += times
                    if r < so_far:
                        out[r] = value
                        break
    return out | beyond


def percentiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.5, 0.75, 0.95, 0.99), few: int = FEW) -> DataFrame:
    """(p, value): exact percentiles with linear interpolation; null where there is no value. NaN counts as the largest value, as in Spark's order."""
    n = df.agg(F.count(F.col(column).cast("double"))).first()[0]
    schema = "p double, value double"
    if not n:
        return df.sparkSession.createDataFrame([(float(p), None) for p in at], schema)
    places = {p: p * (n - 1) for p in at}
    found = order_statistics(df, column, sorted({f(x) for x in places.values() for f in (math.floor, math.ceil)}), few)
    rows = []
    for p, x in places.items():
        a, b = found[math.floor(x)], found[math.ceil(x)]
        rows.append((float(p), a if a == b else a + (b - a) * (x - math.floor(x))))
    return df.sparkSession.createDataFrame(rows, schema)
