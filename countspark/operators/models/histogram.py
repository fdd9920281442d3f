"""A classifier that averages each feature value's smoothed risk, weighted by how much the feature tells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countspark.operators.models.scoring import attach
from countspark.plans.spec import DatasetSpec


def buckets(marginals: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(feature, value, support, bucket_risk)."""
    support = F.col("n_pos") + F.col("n_neg")
    return marginals.select("feature", "value", support.alias("support"), ((F.col("n_pos") + alpha) / (support + 2 * alpha)).alias("bucket_risk"))


def weights(found: DataFrame, prior: float) -> DataFrame:
    """(feature, weight): 1 + the mean distance of the buckets' risks from the prior, weighted by support."""
    part = F.col("support") / F.sum("support").over(Window.partitionBy("feature"))
    return found.withColumn("d", F.coalesce(part, F.lit(0.0)) * F.abs(F.col("bucket_risk") - prior)).groupBy("feature").agg((1.0 + F.sum("d")).alias("weight"))


@dataclass
class HistogramClassifier:
    spec: DatasetSpec
    prior: float
    risks: dict[str, dict[str, float]]
    weight: dict[str, float]
    threshold: float

    @classmethod
    def fit(cls, marginals: DataFrame, spec: DatasetSpec, n_pos: int, n_neg: int, alpha: float = 1.0, weighted: bool = True, threshold: float | None = None) -> HistogramClassifier:
        prior = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.5
        found = buckets(marginals, alpha)
        risks: dict[str, dict[str, float]] = {f: {} for f in spec.features}
        for r in found.collect():  # as many rows as the domains have values
            risks[r["feature"]][r["value"]] = r["bucket_risk"]
        w = {r["feature"]: r["weight"] for r in weights(found, prior).collect()} if weighted else dict.fromkeys(spec.features, 1.0)
        return cls(spec, prior, risks, w, prior if threshold is None else threshold)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for f in self.spec.features:
            out = attach(out, F.lower(F.col(f).cast("string")), self.risks[f], f"_{f}", self.prior)
        total = sum(self.weight.values())
        risk = sum((F.col(f"_{f}") * self.weight[f] for f in sorted(self.spec.features)), F.lit(0.0)) / F.lit(total)
        out = out.withColumn("risk", risk).drop(*[f"_{f}" for f in self.spec.features])
        return out.withColumn("pred", (F.col("risk") >= self.threshold).cast("int"))

    def importance(self) -> list[tuple[str, float]]:
        return sorted(self.weight.items(), key=lambda x: (-x[1], x[0]))
