"""Scalar functions of the models, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO, ONE = 0.0, 1.0


def share(n_pos: Column, n: Column) -> Column:
    return F.try_divide(n_pos.cast("double"), n.cast("double"))


def gini(n_pos: Column, n_neg: Column) -> Column:
    """2 p (1 - p); 0 where there is nothing."""
    p = share(n_pos, n_pos + n_neg)
    return F.coalesce(ONE - p * p - (ONE - p) * (ONE - p), F.lit(ZERO))


def entropy(n_pos: Column, n_neg: Column) -> Column:
    """In bits; 0 where there is nothing or only one class."""
    p = share(n_pos, n_pos + n_neg)
    mixed = (n_pos > 0) & (n_neg > 0)
    return F.when(mixed, -(p * F.log2(p) + (ONE - p) * F.log2(ONE - p))).otherwise(ZERO)


IMPURITY = {"gini": gini, "entropy": entropy}


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(z: Column) -> Column:
    return ONE / (ONE + F.exp(-clipped(z, -500.0, 500.0)))


def gaussian_log_density(x: Column, mean: float, variance: float) -> Column:
    d = x - F.lit(mean)
    return F.lit(-0.5) * (F.lit(math.log(2 * math.pi * variance)) + d * d / F.lit(variance))


def recalibrate(risk: Column, cohort_prior: float, population_prior: float) -> Column:
    """Odds moved from one prior to another; 0 and 1 stay."""
    ratio = (population_prior / cohort_prior) * ((1 - cohort_prior) / (1 - population_prior))
    odds = risk / (ONE - risk) * F.lit(ratio)
    return F.when(risk <= 0, ZERO).when(risk >= 1, ONE).otherwise(odds / (ONE + odds))


def apply_platt(risk: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) * risk + F.lit(b))


def power_law(seconds: float, rows: int, to_rows: Column, exponent: float) -> Column:
    """How long a fit takes at another size: seconds * (to_rows / rows) ^ exponent."""
    return F.lit(float(seconds)) * F.pow(to_rows / F.lit(float(rows)), F.lit(float(exponent)))


#: Twice the rows take 1.735 times as long; a second calculator takes 0.73 as the exponent.
DOUBLING, SECOND_EXPONENT = math.log2(1.735), 0.73


def linear_cost(records: Column, seconds_each: float, dollars_an_hour: float) -> Column:
    """Dollars for so many records at a constant time each."""
    return records * F.lit(seconds_each * dollars_an_hour / 3600)
