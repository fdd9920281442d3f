"""Statistics that follow from counts and moments: tests, rules, outliers, discriminants, components, modes, boosted regression."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import exp, lgamma

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countspark.functions.math import sigmoid
from countspark.operators.models.trees import equal
from countspark.plans.spec import DatasetSpec


def chi_square(marginals: DataFrame) -> DataFrame:
    """(feature, chi2, dof): each feature against the class, over the values that occur."""
    n = F.col("n_pos") + F.col("n_neg")
    total = Window.partitionBy("feature")
    pos, all_ = F.sum("n_pos").over(total).cast("double"), F.sum(n).over(total).cast("double")
    e_pos, e_neg = n * pos / all_, n * (all_ - pos) / all_
    cell = F.pow(F.col("n_pos") - e_pos, 2) / e_pos + F.pow(F.col("n_neg") - e_neg, 2) / e_neg
    return marginals.filter(n > 0).withColumn("cell", cell).groupBy("feature").agg(F.sum("cell").alias("chi2"), (F.count("*") - 1).alias("dof"))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """The two-sided probability of a 2 x 2 table at least as unlikely as this one, margins given.

    The likelihood has one peak, so both tails are summed outwards from where they begin, until nothing is added.
    """
    rows, cols, n = a + b, a + c, a + b + c + d
    low, high = max(0, rows + cols - n), min(rows, cols)
    choose = lambda x, k: lgamma(x + 1) - lgamma(k + 1) - lgamma(x - k + 1)
    log = lambda k: choose(cols, k) + choose(n - cols, rows - k) - choose(n, rows)
    peak = min(max((rows + 1) * (cols + 1) // (n + 2), low), high)
    bound = log(a) + 1e-9 * max(1.0, abs(log(a)))

    def tail(end: int, step: int) -> float:
        inside, outside = peak, end + step  # the likelihood falls from the peak to the end: find where it is small enough
        while abs(outside - inside) > 1:
            middle = (inside + outside) // 2
            inside, outside = (inside, middle) if log(middle) <= bound else (middle, outside)
        k = inside if log(inside) <= bound else outside
        total = 0.0
        while k != end + step:
            p = exp(log(k))
            if p <= total * 1e-18:
                break
            total, k = total + p, k + step
        return total

    if log(peak) <= bound:
        return 1.0
    return min(1.0, tail(low, -1) + tail(high, 1))


def fisher_tests(marginals: DataFrame) -> DataFrame:
    """(feature, value, p_value): each value against all others of its feature, by class; as many rows as the domains."""
    rows = marginals.collect()
    total: dict[str, list[int]] = {}
    for r in rows:
        t = total.setdefault(r["feature"], [0, 0])
        t[0] += r["n_pos"]
        t[1] += r["n_neg"]
    out = [(r["feature"], r["value"], fisher_exact(r["n_pos"], r["n_neg"], total[r["feature"]][0] - r["n_pos"], total[r["feature"]][1] - r["n_neg"])) for r in rows]
    return marginals.sparkSession.createDataFrame(out, "feature string, value string, p_value double")


def association_rules(pairs: DataFrame, marginals: DataFrame, n_total: int, least_support: float = 0.01, least_confidence: float = 0.1) -> DataFrame:
    """(fa, va, fb, vb, support, confidence, lift) of "a then b" for the pairs of values that are frequent."""
    one = marginals.select("feature", "value", (F.col("n_pos") + F.col("n_neg")).alias("n"))
    a, b = (F.broadcast(one.select(F.col("feature").alias(f"f{s}"), F.col("value").alias(f"v{s}"), F.col("n").alias(f"n_{s}"))) for s in "ab")  # as large as the domains
    n = F.lit(float(n_total))
    rules = pairs.join(a, ["fa", "va"]).join(b, ["fb", "vb"]).select(
        "fa", "va", "fb", "vb", (F.col("cnt") / n).alias("support"), (F.col("cnt") / F.col("n_a")).alias("confidence"), (F.col("cnt") * n / (F.col("n_a") * F.col("n_b"))).alias("lift")
    )
    return rules.filter((F.col("support") >= least_support) & (F.col("confidence") >= least_confidence))


def z_scores(df: DataFrame, value: str, by: list[str], most: float = 3.0) -> DataFrame:
    """df with mean, deviation, z and outlier of a value within its group. Groups are aggregated, then joined back."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    out = df.join(stats, by).withColumn("z", F.try_divide(F.col(value) - F.col("mean"), F.col("deviation")))
    return out.withColumn("outlier", F.coalesce(F.abs("z") > most, F.lit(False)))


def covariances(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, population covariances) by one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    x = [F.col(c).cast("double") for c in columns]
    row = df.agg(F.count("*"), *[F.avg(c) for c in x], *[F.covar_pop(x[i], x[j]) for i, j in pairs]).first()
    means = np.array([row[1 + i] or 0.0 for i in range(len(columns))])
    cov = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row[1 + len(columns) :]):
        cov[i, j] = cov[j, i] = v or 0.0
    return row[0], means, cov


@dataclass
class Discriminant:
    """Linear discriminant analysis with a pooled covariance."""

    columns: list[str]
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], label: str = "y") -> Discriminant:
        (n1, m1, c1), (n0, m0, c0) = (covariances(df.filter(F.col(label) == c), columns) for c in (1, 0))
        if not n1 or not n0:
            raise ValueError("both classes are needed")
        pooled = (n1 * c1 + n0 * c0) / (n1 + n0) + 1e-9 * np.eye(len(columns))
        w = np.linalg.solve(pooled, m1 - m0)
        return cls(columns, w, float(-w @ (m1 + m0) / 2 + np.log(n1 / n0)))

    def transform(self, df: DataFrame) -> DataFrame:
        z = sum((F.col(c).cast("double") * float(w) for c, w in zip(self.columns, self.weights)), F.lit(self.bias))
        out = df.withColumn("risk", sigmoid(z))
        return out.withColumn("pred", (F.col("risk") >= 0.5).cast("int"))


def principal_components(df: DataFrame, columns: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(variances, components as rows), largest first, the first nonzero weight of each positive; the matrix comes from one aggregation."""
    _, _, cov = covariances(df, columns)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    parts = vectors[:, order].T
    signs = np.array([np.sign(p[np.flatnonzero(np.abs(p) > 1e-12)[0]]) if np.abs(p).max() > 1e-12 else 1.0 for p in parts])
    return values[order], parts * signs[:, None]


def k_modes(cube: DataFrame, spec: DatasetSpec, centers: list[dict[str, str]], rounds: int = 10) -> tuple[list[dict[str, str]], Column]:
    """Cluster centers of categorical rows, and the expression that gives a row's cluster: fewest differing values, then the first."""

    def cluster(now: list[dict[str, str]]) -> Column:
        apart = [sum((F.when(equal(f, v), 0).otherwise(1) for f, v in c.items()), F.lit(0)) for c in now]
        return (F.array_position(F.array(*apart), F.array_min(F.array(*apart))) - 1).cast("int")

    for _ in range(rounds):
        at = cube.withColumn("cluster", cluster(centers)).withColumn("n", F.col("n_pos") + F.col("n_neg"))
        long = at.unpivot(["cluster", "n"], spec.features, "feature", "value").groupBy("cluster", "feature", "value").agg(F.sum("n").alias("n"))
        modes = long.groupBy("cluster", "feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")).collect()
        new = [dict(c) for c in centers]
        for r in modes:
            new[r["cluster"]][r["feature"]] = r["value"]
        if new == centers:
            break
        centers = new
    return centers, cluster(centers)


@dataclass
class BoostedStumps:
    """Regression stumps on the residuals of the logistic loss: (feature, value, left, right) steps on top of a base score."""

    base: float
    steps: list[tuple[str, str, float, float]] = field(default_factory=list)

    def score(self) -> Column:
        return sum((F.when(equal(f, v), F.lit(a)).otherwise(F.lit(b)) for f, v, a, b in self.steps), F.lit(self.base))

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("risk", sigmoid(self.score()))
        return out.withColumn("pred", (F.col("risk") >= 0.5).cast("int"))


def boosted_stumps(cube: DataFrame, spec: DatasetSpec, n_estimators: int = 10, learning_rate: float = 0.3) -> BoostedStumps:
    """Each round sums residuals and curvatures for each feature value, and takes the split with the largest gain."""
    p, n = cube.agg(F.sum("n_pos"), F.sum("n_neg")).first()
    if not p or not n:
        return BoostedStumps(30.0 if p else -30.0)
    model = BoostedStumps(float(np.log(p / n)))
    index = {(f, v): i for f, v, i in spec.candidates()}
    for _ in range(n_estimators):
        mu, m = sigmoid(model.score()), F.col("n_pos") + F.col("n_neg")
        at = cube.withColumns({"g": F.col("n_pos") - m * mu, "h": m * mu * (1.0 - mu)}).unpivot(["g", "h"], spec.features, "feature", "value")
        rows = at.groupBy("feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # as many as the domains have values
        g, h = (sum(r[c] for r in rows if r["feature"] == spec.features[0]) for c in "gh")
        best = None
        for r in sorted((r for r in rows if (r["feature"], r["value"]) in index), key=lambda r: index[r["feature"], r["value"]]):
            rg, rh = g - r["g"], h - r["h"]
            gain = r["g"] ** 2 / (r["h"] + 1) + rg**2 / (rh + 1)
            if best is None or round(gain, 9) > round(best[0], 9):
                best = (gain, r["feature"], r["value"], learning_rate * r["g"] / (r["h"] + 1), learning_rate * rg / (rh + 1))
        if best is None:
            break
        model.steps.append(best[1:])
    return model
