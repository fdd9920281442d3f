"""Least squares and logistic regression from counts, and Platt scaling."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countspark.functions.math import apply_platt, clipped, sigmoid
from countspark.operators.models.providers import codes
from countspark.operators.models.scoring import attach
from countspark.operators.suppress import midpoint
from countspark.plans.spec import DatasetSpec


def dummies(spec: DatasetSpec, reference: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """The feature values that get a coefficient: all but the reference one, by default the last, of each feature."""
    left_out = {f: (reference or {}).get(f, vs[-1]) for f, vs in spec.domains.items()}
    return [(f, v) for f, vs in spec.domains.items() for v in vs if v != left_out[f]]


def sums(cube: DataFrame, spec: DatasetSpec, measures: dict[str, Column]) -> DataFrame:
    """(fa, va, fb, vb, measures): sums over all rows (all null), each feature's values (fb null) and pairs of values."""
    fs = spec.features
    sets = [[], *[[F.col(f)] for f in fs], *[[F.col(a), F.col(b)] for a, b in combinations(fs, 2)]]
    found = cube.groupingSets(sets, *[F.col(f) for f in fs]).agg(*[F.sum(m).alias(n) for n, m in measures.items()], F.grouping_id().alias("gid"))
    bit = {f: 1 << (len(fs) - 1 - i) for i, f in enumerate(fs)}
    given = lambda f: F.col("gid").bitwiseAND(F.lit(bit[f])) == 0
    names = F.array_compact(F.array(*[F.when(given(f), F.struct(F.lit(f).alias("f"), F.col(f).alias("v"))) for f in fs]))
    at = lambda i: F.get(F.col("names"), F.lit(i))
    return found.withColumn("names", names).select(at(0)["f"].alias("fa"), at(0)["v"].alias("va"), at(1)["f"].alias("fb"), at(1)["v"].alias("vb"), *measures)


def gram(rows: list[dict], index: list[tuple[str, str]]) -> np.ndarray:
    """The matrix of a design with an intercept and the given dummies, from weights w of all rows, of values a and of pairs a, b."""
    at = {k: i + 1 for i, k in enumerate(index)}
    out = np.zeros((len(index) + 1, len(index) + 1))
    for r in rows:
        a, b = at.get(r["a"]), at.get(r["b"])
        if r["a"][0] is None:
            out[0, 0] = r["w"]
        elif r["b"][0] is None and a:
            out[0, a] = out[a, 0] = out[a, a] = r["w"]
        elif r["b"][0] is not None and a and b:
            out[a, b] = out[b, a] = r["w"]
    return out


def moment(rows: list[dict], index: list[tuple[str, str]]) -> np.ndarray:
    at = {k: i + 1 for i, k in enumerate(index)}
    out = np.zeros(len(index) + 1)
    for r in rows:
        if r["a"][0] is None:
            out[0] = r["wy"]
        elif r["b"][0] is None and (a := at.get(r["a"])):
            out[a] = r["wy"]
    return out


@dataclass
class Logistic:
    spec: DatasetSpec
    index: list[tuple[str, str]]
    beta: np.ndarray
    ridge: float = 0.0
    threshold: float = 0.5

    @classmethod
    def fit(cls, cube: DataFrame, spec: DatasetSpec, n_pos: int, n_neg: int, ridge: float = 0.01, balanced: bool = False, exact_weights: bool = False, reference: dict[str, str] | None = None, threshold: float = 0.5, k_min: int = 0) -> Logistic:
        """Weighted least squares of the label. balanced: both classes weigh the same in total.

        Pairs of features weigh by the mean of the class weights unless exact_weights asks for their own. k_min: counts are
        suppressed before the fit, those of values to the midpoint, those of pairs to what independence would give.
        """
        total = n_pos + n_neg
        wp, wn = (total / (2 * n_pos), total / (2 * n_neg)) if balanced and n_pos and n_neg else (1.0, 1.0)
        found = sums(cube, spec, {"n_pos": F.col("n_pos"), "n_neg": F.col("n_neg")}).collect()  # bounded by the domains
        small = lambda c: 0 < c < k_min
        shown = lambda c: midpoint(k_min) if small(c) else c
        marginal = {(r["fa"], r["va"]): (shown(r["n_pos"]), shown(r["n_neg"])) for r in found if r["fa"] is not None and r["fb"] is None}
        rows = []
        for r in found:
            a, b, p, n = (r["fa"], r["va"]), (r["fb"], r["vb"]), r["n_pos"], r["n_neg"]
            if a[0] is None or b[0] is None:
                p, n = marginal.get(a, (p, n))
                rows.append({"a": a, "b": b, "w": wp * p + wn * n, "wy": wp * p})
            elif small(p + n):
                rows.append({"a": a, "b": b, "w": sum(marginal[a]) * sum(marginal[b]) / total * (wp + wn) / 2})
            else:
                rows.append({"a": a, "b": b, "w": wp * p + wn * n if exact_weights else (p + n) * (wp + wn) / 2})
        index = dummies(spec, reference)
        left = gram(rows, index) + ridge * np.eye(len(index) + 1)
        beta, *_ = np.linalg.lstsq(left, moment(rows, index), rcond=None)
        return cls(spec, index, beta, ridge, threshold)

    def linear(self, df: DataFrame, name: str = "_z") -> DataFrame:
        """df with the linear predictor."""
        out = df
        for f in self.spec.features:
            own = {v: float(b) for (g, v), b in zip(self.index, self.beta[1:]) if g == f}
            out = attach(out, F.lower(F.col(f).cast("string")), own, f"_{f}_z", 0.0)
        names = [f"_{f}_z" for f in self.spec.features]
        return out.withColumn(name, sum((F.col(c) for c in names), F.lit(float(self.beta[0])))).drop(*names)

    def refine(self, cube: DataFrame, max_iter: int = 25, tol: float = 1e-6) -> Logistic:
        """Newton steps of the logistic likelihood, each one grouped sum over the cube.

        A line of the cube has one dummy for each feature at most, so it adds its weight to the few cells of the matrix of products that its
        pairs of dummies name; these are numbered once. The sums by cell come to the driver: the dummies' number squared, at most.
        """
        size, beta = len(self.beta), self.beta.copy()
        place = {k: i + 1 for i, k in enumerate(self.index)}
        where = F.array(*[F.lit(place.get((f, v), -1)) for f, v, _ in self.spec.candidates()])
        own = F.filter(F.transform(codes(self.spec), lambda c: F.when(c >= 0, F.get(where, c)).otherwise(-1)), lambda c: c > 0)
        named = cube.select(F.concat(F.array(F.lit(0)), own).alias("x"), "n_pos", (F.col("n_pos") + F.col("n_neg")).alias("n")).filter("n > 0")
        cells = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 1, F.size("x")), lambda b: a * size + b)))
        lines = named.withColumn("cells", cells).persist()
        try:
            for _ in range(max_iter):
                known = F.array(*[F.lit(float(b)) for b in beta])
                z = clipped(F.aggregate("x", F.lit(0.0), lambda s, c: s + F.get(known, c)), -500.0, 500.0)
                mu = clipped(sigmoid(F.col("z")), 1e-10, 1 - 1e-10)
                w = F.col("n") * F.col("mu") * (1.0 - F.col("mu"))
                ready = lines.withColumn("z", z).withColumn("mu", mu).withColumn("w", w)
                answer = F.col("w") * F.col("z") + F.col("n_pos") - F.col("n") * F.col("mu")
                sums = ready.select(F.explode("cells").alias("cell"), "w", answer.alias("wy")).groupBy("cell").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
                left, right = np.zeros((size, size)), np.zeros(size)
                for r in sums.collect():
                    a, b = divmod(r["cell"], size)
                    left[a, b] = left[b, a] = r["w"]
                    if a == 0:
                        right[b] = r["wy"]
                new = np.linalg.solve(left + self.ridge * np.eye(size), right)
                moved, beta = np.abs(new - beta).max(), new
                if moved < tol:
                    break
        finally:
            lines.unpersist()
        return Logistic(self.spec, self.index, beta, self.ridge, self.threshold)

    def transform(self, df: DataFrame, use_sigmoid: bool = True) -> DataFrame:
        """df with risk and pred; without the sigmoid the predictor itself, clipped to 0 and 1, is the risk."""
        out = self.linear(df)
        out = out.withColumn("risk", sigmoid(F.col("_z")) if use_sigmoid else clipped(F.col("_z"), 0.0, 1.0)).drop("_z")
        return out.withColumn("pred", (F.col("risk") >= self.threshold).cast("int"))


def fit_platt(scored: DataFrame, score: str = "risk", label: str = "y", steps: int = 50, weight: str | None = None) -> tuple[float, float]:
    """(a, b) of P(y = 1) = sigmoid(a score + b), by Newton steps on sums over the distinct scores. weight: a column of how many rows a row stands for."""
    each = F.lit(1) if weight is None else F.col(weight)
    points = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, each).otherwise(0)).alias("p"), F.sum(each).alias("n")).persist()
    a, b = 1.0, 0.0
    try:
        for _ in range(steps):
            mu = apply_platt(F.col("s"), a, b)
            w, d = F.col("n") * mu * (1.0 - mu), F.col("n") * mu - F.col("p")
            r = points.agg(F.sum(d * F.col("s")), F.sum(d), F.sum(w * F.col("s") * F.col("s")), F.sum(w * F.col("s")), F.sum(w)).first()
            if r[0] is None:
                break
            hessian = np.array([[r[2], r[3]], [r[3], r[4]]]) + 1e-9 * np.eye(2)
            step = np.linalg.solve(hessian, np.array([r[0], r[1]]))
            step = np.clip(step, -10, 10)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
    finally:
        points.unpersist()
    return float(a), float(b)
