"""Categorical and Gaussian naive Bayes, and a Bayesian network classifier."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countspark.functions.math import gaussian_log_density
from countspark.operators import counts
from countspark.operators.models.scoring import attach, with_risk
from countspark.plans.spec import DatasetSpec


def likelihoods(marginals: DataFrame, spec: DatasetSpec, n_pos: int, n_neg: int) -> DataFrame:
    """(feature, value, lik_pos, lik_neg): (count + 1) / (class total + size of the domain)."""
    size = F.create_map(*[F.lit(x) for f, vs in spec.domains.items() for x in (f, len(vs))])[F.col("feature")]
    lik = lambda c, n: ((F.col(c) + 1.0) / (F.lit(float(n)) + size)).alias(c.replace("n_", "lik_"))
    return marginals.select("feature", "value", lik("n_pos", n_pos), lik("n_neg", n_neg))


@dataclass
class NaiveBayes:
    """A value that the domain lacks has the same probability in both classes, so it says nothing."""

    spec: DatasetSpec
    prior_pos: float
    prior_neg: float
    table: dict[str, dict[str, tuple[float, float]]]
    unseen: float = 0.1

    @classmethod
    def fit(cls, marginals: DataFrame, spec: DatasetSpec, n_pos: int, n_neg: int, prior: float | None = None) -> NaiveBayes:
        if n_pos + n_neg == 0:
            raise ValueError("no rows to train from")
        table: dict[str, dict[str, tuple[float, float]]] = {f: {} for f in spec.features}
        for r in likelihoods(marginals, spec, n_pos, n_neg).collect():  # as many rows as the domains have values
            table[r["feature"]][r["value"]] = (r["lik_pos"], r["lik_neg"])
        p = n_pos / (n_pos + n_neg) if prior is None else prior
        return cls(spec, p, 1 - p, table)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with log_pos, log_neg, risk and pred."""
        eps, names = 1e-10, []
        out = df
        for f in self.spec.features:
            for c, side in enumerate(("pos", "neg")):
                logs = {v: math.log(max(p[c], eps)) for v, p in self.table[f].items()}
                out = attach(out, F.lower(F.col(f).cast("string")), logs, f"_{f}_{side}", math.log(self.unseen))
                names.append(f"_{f}_{side}")
        total = lambda side, prior: sum((F.col(n) for n in names if n.endswith(side)), F.lit(math.log(prior + eps)))
        return with_risk(out, total("_pos", self.prior_pos), total("_neg", self.prior_neg), strict=True).drop(*names)

    def importance(self) -> list[tuple[str, float]]:
        """Each feature's largest minus smallest probability of a value in the positive class, over the most of them."""
        spread = {f: max(p for p, _ in t.values()) - min(p for p, _ in t.values()) for f, t in self.table.items() if t}
        most = max(spread.values(), default=0) or 1.0
        return sorted(((f, s / most) for f, s in spread.items()), key=lambda x: (-x[1], x[0]))


@dataclass
class GaussianNaiveBayes:
    prior_pos: float
    prior_neg: float
    stats: dict[str, dict[int, tuple[float, float]]]  # feature -> class -> (mean, variance)
    threshold: float = 0.5

    @classmethod
    def fit(cls, sums: DataFrame, var_smoothing: float = 1e-9, threshold: float = 0.5) -> GaussianNaiveBayes:
        """From gaussian_stats(). The smoothing takes the largest variance, over all rows or within a class, of any feature."""
        rows = sums.collect()  # two for each feature
        if not rows:
            raise ValueError("no features to train from")
        moment = lambda n, s, q: (s / n, max(q / n - (s / n) ** 2, 0.0)) if n else (0.0, 0.0)
        stats: dict[str, dict[int, tuple[float, float]]] = {}
        overall: dict[str, list[float]] = {}
        n = {0: 0, 1: 0}
        for r in rows:
            stats.setdefault(r["feature"], {})[r["cls"]] = moment(r["n"], r["total"], r["total_sq"])
            overall[r["feature"]] = [a + b for a, b in zip(overall.get(r["feature"], [0, 0.0, 0.0]), (r["n"], r["total"], r["total_sq"]))]
            n[r["cls"]] = max(n[r["cls"]], r["n"])
        widest = max([v for by in stats.values() for _, v in by.values()] + [moment(*t)[1] for t in overall.values()])
        eps = max(var_smoothing * widest, 1e-12)
        smoothed = {f: {c: (m, max(v + eps, 1e-12)) for c, (m, v) in by.items()} for f, by in stats.items()}
        total = n[0] + n[1]
        return cls(n[1] / total, n[0] / total, smoothed, threshold)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with log_pos, log_neg, risk and pred; a feature that is null or no number is left out for that row."""
        eps = 1e-12
        sums = {1: F.lit(math.log(self.prior_pos + eps)), 0: F.lit(math.log(self.prior_neg + eps))}
        for f, by in sorted(self.stats.items()):
            x = F.col(f).try_cast("double")
            for c, (mean, var) in by.items():
                sums[c] = sums[c] + F.coalesce(gaussian_log_density(x, mean, var), F.lit(0.0))
        return with_risk(df, sums[1], sums[0], strict=False, threshold=self.threshold)


@dataclass
class BayesNet:
    """Each feature given the class and its parents; a parent state outside the domains falls back to the feature's own distribution."""

    spec: DatasetSpec
    prior_pos: float
    prior_neg: float
    tables: dict[str, dict[str, tuple[float, float]]]  # feature -> parent state, value -> probabilities
    own: dict[str, dict[str, tuple[float, float]]]
    default: dict[str, tuple[float, float]]
    backoff: bool = True
    threshold: float = 0.5

    @classmethod
    def fit(cls, cpt: DataFrame, spec: DatasetSpec, n_pos: int, n_neg: int, alpha: float = 1.0, backoff: bool = True, threshold: float = 0.5) -> BayesNet:
        if alpha < 0:
            raise ValueError("alpha must not be negative")
        cells: dict[str, dict[str, dict[str, list[int]]]] = {f: {} for f in spec.features}
        for r in cpt.collect():  # as many rows as the domains of features and parents have combinations
            cells[r["feature"]].setdefault(r["parent_state"], {})[r["value"]] = [r["n_pos"], r["n_neg"]]
        tables, own, default = {}, {}, {}
        for f, states in cells.items():
            k = max(1, len(spec.domains[f]))
            prob = lambda n, total: (n + alpha) / (total + alpha * k) if total + alpha * k > 0 else 1 / k  # noqa: B023, E731
            sums = {v: [sum(s.get(v, [0, 0])[c] for s in states.values()) for c in (0, 1)] for v in spec.domains[f]}
            totals = [sum(s[c] for s in sums.values()) for c in (0, 1)]
            own[f] = {v: tuple(prob(s[c], totals[c]) for c in (0, 1)) for v, s in sums.items()}
            default[f] = tuple(prob(0, t) for t in totals)
            tables[f] = {}
            for state, values in states.items():
                t = [sum(v[c] for v in values.values()) for c in (0, 1)]
                for v in spec.domains[f]:
                    tables[f][f"{state}\x00{v}"] = tuple(prob(values.get(v, [0, 0])[c], t[c]) for c in (0, 1))
        total = n_pos + n_neg
        p = n_pos / total if total else 0.5
        return cls(spec, p, 1 - p, tables, own, default, backoff, threshold)

    def transform(self, df: DataFrame) -> DataFrame:
        eps, out, names = 1e-12, df, []
        for f in self.spec.features:
            value = F.lower(F.col(f).cast("string"))
            state = counts.parent_state(self.spec, f)
            known = {k.split("\x00")[0] for k in self.tables[f]}
            for c, side in enumerate(("pos", "neg")):
                log = lambda p: math.log(max(p, eps))
                unseen = log(self.default[f][c])
                key = F.concat_ws("\x00", state, value)
                out = attach(out, key, {k: log(p[c]) for k, p in self.tables[f].items()}, f"_{f}_{side}", unseen)
                if self.backoff and self.spec.parents.get(f):
                    out = attach(out, value, {v: log(p[c]) for v, p in self.own[f].items()}, "_own", unseen)
                    out = out.withColumn(f"_{f}_{side}", F.when(state.isin(sorted(known)), F.col(f"_{f}_{side}")).otherwise(F.col("_own"))).drop("_own")
                names.append(f"_{f}_{side}")
        total = lambda side, prior: sum((F.col(n) for n in names if n.endswith(side)), F.lit(math.log(prior + eps)))
        return with_risk(out, total("_pos", self.prior_pos), total("_neg", self.prior_neg), strict=False, threshold=self.threshold).drop(*names)
