"""Decision trees, forests and boosted stumps, grown level by level from grouped counts."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countspark.functions.math import IMPURITY, sigmoid
from countspark.operators.models.providers import CountProvider, CubeCounts, Known, Path, equal
from countspark.operators.suppress import split_allowed
from countspark.plans.spec import DatasetSpec

ROUND = 12  # digits at which gains and errors tie


@dataclass
class Node:
    n_pos: int
    n_neg: int
    feature: str | None = None
    value: str | None = None
    gain: float = 0.0

    @property
    def risk(self) -> float:
        n = self.n_pos + self.n_neg
        return self.n_pos / n if n else 0.0


@dataclass
class Tree:
    """nodes by number: the root is 1, the children of i are 2 i (the value) and 2 i + 1 (any other)."""

    nodes: dict[int, Node]

    def where(self, leaf, i: int = 1) -> Column:
        """An expression over feature columns that gives leaf(i, node) for the node that a row ends in."""
        node = self.nodes[i]
        if node.feature is None:
            return leaf(i, node)
        return F.when(equal(node.feature, node.value), self.where(leaf, 2 * i)).otherwise(self.where(leaf, 2 * i + 1))

    def risk(self) -> Column:
        return self.where(lambda _, node: F.lit(float(node.risk)))

    def describe(self, i: int = 1, indent: str = "") -> str:
        node = self.nodes[i]
        if node.feature is None:
            return f"{indent}risk {node.risk:.4f} ({node.n_pos} of {node.n_pos + node.n_neg})\n"
        return f"{indent}{node.feature} = {node.value}?\n" + self.describe(2 * i, indent + "  ") + self.describe(2 * i + 1, indent + "  ")

    def table(self, spark) -> DataFrame:
        rows = [(i, i // 2 or None, int(math.log2(i)), n.feature, n.value, n.n_pos, n.n_neg, n.gain, n.feature is None, n.risk) for i, n in sorted(self.nodes.items())]
        return spark.createDataFrame(rows, "node_id long, parent long, depth int, feature string, value string, n_pos long, n_neg long, gain double, is_leaf boolean, risk double")


def split_gains(histogram: DataFrame, totals: DataFrame, candidates: DataFrame, criterion: str = "gini", k_min: int = 0) -> DataFrame:
    """(node, feature, value, col_idx, left_pos, left_neg, node_pos, node_neg, gain) for each split that is allowed.

    histogram: level_histogram(); totals: (node, node_pos, node_neg); candidates: (node, feature, value, col_idx).
    """
    imp = IMPURITY[criterion]
    at = candidates.join(histogram, ["node", "feature", "value"]).join(F.broadcast(totals), "node")
    lp, ln, p, q = F.col("n_pos"), F.col("n_neg"), F.col("node_pos"), F.col("node_neg")
    n, left = p + q, lp + ln
    right = n - left
    part = lambda m, a, b: m / n * imp(a, b)
    gain = imp(p, q) - (part(left, lp, ln) + part(right, p - lp, q - ln))
    ok = (left > 0) & (right > 0)
    if k_min:
        ok = ok & split_allowed(lp, p - lp, k_min)
    return at.filter(ok).select("node", "feature", "value", "col_idx", lp.alias("left_pos"), ln.alias("left_neg"), "node_pos", "node_neg", gain.alias("gain"))


def best_splits(gains: DataFrame) -> DataFrame:
    """The best split of each node; of equal gains the first candidate."""
    order = Window.partitionBy("node").orderBy(F.desc(F.round("gain", ROUND)), "col_idx")
    return gains.filter("gain > 0").withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


@dataclass
class Forest:
    spec: DatasetSpec
    trees: list[Tree]
    subsets: list[list[str]]
    threshold: float = 0.5

    def transform(self, df: DataFrame) -> DataFrame:
        """df with risk, the mean of the trees' risks, and pred."""
        risk = sum((t.risk() for t in self.trees), F.lit(0.0)) / float(len(self.trees))
        out = df.withColumn("risk", risk)
        return out.withColumn("pred", (F.col("risk") >= self.threshold).cast("int"))

    def describe(self) -> str:
        return "".join(f"tree {i}, features {', '.join(s)}\n{t.describe()}" for i, (t, s) in enumerate(zip(self.trees, self.subsets)))


def impurity(criterion: str, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """What IMPURITY computes, for arrays of counts."""
    n = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        p = pos / n
        if criterion == "gini":
            return np.where(n > 0, 1.0 - p * p - (1.0 - p) * (1.0 - p), 0.0)
        return np.where((pos > 0) & (neg > 0), -(p * np.log2(p) + (1.0 - p) * np.log2(1.0 - p)), 0.0)


def best_split(left: np.ndarray, n_pos: int, n_neg: int, order: np.ndarray, criterion: str, k_min: int) -> tuple[int, float] | None:
    """The candidate with the largest gain, of equal ones (to ROUND digits) the first in an order of candidates; None where no split gains.

    left: (positives, others) that each candidate puts on its left.
    """
    lp, ln = left[0, order], left[1, order]
    rp, rn, n = n_pos - lp, n_neg - ln, n_pos + n_neg
    gain = impurity(criterion, np.array(n_pos), np.array(n_neg)) - ((lp + ln) / n * impurity(criterion, lp, ln) + (rp + rn) / n * impurity(criterion, rp, rn))
    ok = (lp + ln > 0) & (rp + rn > 0) & (gain > 0)
    if k_min:
        ok &= ((lp == 0) | (lp >= k_min)) & ((rp == 0) | (rp >= k_min))
    if not ok.any():
        return None
    k = int(np.argmax(np.where(ok, np.round(gain, ROUND), -np.inf)))
    return int(order[k]), float(gain[k])


def grow(source: DataFrame | CountProvider, spec: DatasetSpec, subsets: list[list[str]], n_pos: int, n_neg: int, max_depth: int = 3, criterion: str = "gini", k_min: int = 0) -> list[Tree]:
    """One tree for each subset of features, all from one pass over the source per level: a cube of counts, or any CountProvider.

    A node's counts are one dense array over all candidates. Trees that come along the same path share it, the right side of a split is
    its node less the left one, and so a level asks for the left sides only: at most 2 ^ depth arrays a tree come to the driver, each as long as the domains.
    """
    if criterion not in IMPURITY:
        raise ValueError(f"criterion must be one of {sorted(IMPURITY)}")
    known = Known(CubeCounts(source, spec) if isinstance(source, DataFrame) else source)
    named = [(f, v) for f, v, _ in spec.candidates()]
    orders = [np.array([known.at[f, v] for f in s for v in spec.domains[f]], int) for s in subsets]
    trees = [Tree({1: Node(n_pos, n_neg)}) for _ in subsets]
    frontier: list[tuple[int, int, Path]] = [(k, 1, ()) for k in range(len(subsets))]
    for _ in range(max_depth):
        frontier = [(k, i, path) for k, i, path in frontier if trees[k].nodes[i].n_pos and trees[k].nodes[i].n_neg]
        if not frontier:
            break
        below: list[tuple[int, int, Path]] = []
        for (k, i, path), left in zip(frontier, known([path for *_, path in frontier])):
            nodes = trees[k].nodes
            node = nodes[i]
            found = best_split(left, node.n_pos, node.n_neg, orders[k], criterion, k_min)
            if found is None:
                continue
            at, node.gain = found
            node.feature, node.value = named[at]
            nodes[2 * i] = Node(int(left[0, at]), int(left[1, at]))
            nodes[2 * i + 1] = Node(node.n_pos - nodes[2 * i].n_pos, node.n_neg - nodes[2 * i].n_neg)
            below += [(k, 2 * i + side, (*path, (node.feature, node.value, not side))) for side in (0, 1)]
        frontier = below
    return trees


def decision_tree(cube: DataFrame | CountProvider, spec: DatasetSpec, n_pos: int, n_neg: int, max_depth: int = 3, criterion: str = "gini", k_min: int = 0, threshold: float = 0.5) -> Forest:
    """A forest of one tree over all features."""
    return Forest(spec, grow(cube, spec, [spec.features], n_pos, n_neg, max_depth, criterion, k_min), [spec.features], threshold)


def n_features_of(rule, n: int) -> int:
    """How many features a tree sees: None or "all", "sqrt", "log2", a share or a number; roots and shares are rounded up."""
    if rule is None or rule == "all":
        return n
    if rule in ("sqrt", "log2"):
        return max(1, math.ceil(math.sqrt(n) if rule == "sqrt" else math.log2(max(2, n))))
    if isinstance(rule, float) and 0 < rule <= 1:
        return max(1, math.ceil(rule * n))
    if isinstance(rule, int) and rule >= 1:
        return min(rule, n)
    raise ValueError(f"not a rule for the number of features: {rule!r}")


def feature_subsets(features: list[str], n_trees: int, rule, seed: int) -> list[list[str]]:
    """Random subsets in random order; the first tree sees all features, in their own order, where the others see fewer."""
    n, rng, out = n_features_of(rule, len(features)), np.random.default_rng(seed), []
    for i in range(n_trees):
        if n < len(features):
            out.append(list(features) if i == 0 else rng.choice(features, size=n, replace=False).tolist())
        else:
            every = list(features)
            rng.shuffle(every)
            out.append(every)
    return out


def random_forest(cube: DataFrame | CountProvider, spec: DatasetSpec, n_pos: int, n_neg: int, n_trees: int = 7, max_depth: int = 3, max_features=4, seed: int = 42, criterion: str = "gini", k_min: int = 0, threshold: float = 0.5) -> Forest:
    """Trees on feature subsets, without resampling of rows."""
    subsets = feature_subsets(spec.features, n_trees, max_features, seed)
    return Forest(spec, grow(cube, spec, subsets, n_pos, n_neg, max_depth, criterion, k_min), subsets, threshold)


@dataclass
class Stump:
    feature: str
    value: str
    left_pred: int
    alpha: float
    error: float
    left_pos: int
    left_neg: int
    right_pos: int
    right_neg: int

    def sign(self) -> Column:
        """+1 where the stump says positive, else -1."""
        left = 1.0 if self.left_pred else -1.0
        return F.when(equal(self.feature, self.value), F.lit(left)).otherwise(F.lit(-left))


@dataclass
class AdaBoost:
    stumps: list[Stump] = field(default_factory=list)
    threshold: float = 0.5

    def score(self) -> Column:
        return sum((s.sign() * s.alpha for s in self.stumps), F.lit(0.0))

    def transform(self, df: DataFrame) -> DataFrame:
        """df with risk = sigmoid(2 score) and pred; without stumps both are 0."""
        out = df.withColumn("risk", sigmoid(self.score() * 2) if self.stumps else F.lit(0.0))
        return out.withColumn("pred", (F.col("risk") >= self.threshold).cast("int") if self.stumps else F.lit(0))

    def describe(self) -> str:
        return "".join(f"{s.feature} = {s.value} says {s.left_pred}, weight {s.alpha:.4f}, error {s.error:.4f}\n" for s in self.stumps)


def weighted_histogram(cube: DataFrame, spec: DatasetSpec, score: Column | None = None) -> DataFrame:
    """(feature, value, n_pos, n_neg, w_pos, w_neg): counts, and boosting weights of rows with a score, positives e^-s, others e^s."""
    s = F.lit(0.0) if score is None else score
    weighed = cube.withColumns({"w_pos": F.col("n_pos") * F.exp(-s), "w_neg": F.col("n_neg") * F.exp(s)})
    keep = ["n_pos", "n_neg", "w_pos", "w_neg"]
    return weighed.unpivot(keep, spec.features, "feature", "value").groupBy("feature", "value").agg(*[F.sum(c).alias(c) for c in keep])


def heaviest_regions(cube: DataFrame, stumps: list[Stump], score: Column, most: int) -> Column:
    """Whether a row is in one of the regions of largest weight, a region being what all stumps say of a row."""
    said = F.concat_ws(",", *[F.when(s.sign() > 0, "1").otherwise("0") for s in stumps])
    weight = F.sum(F.col("n_pos") * F.exp(-score) + F.col("n_neg") * F.exp(score))
    kept = cube.groupBy(said.alias("region")).agg(weight.alias("w")).orderBy(F.desc(F.round("w", ROUND)), F.desc("region")).limit(most).collect()
    return said.isin([r["region"] for r in kept])


def adaboost(cube: DataFrame, spec: DatasetSpec, n_estimators: int = 10, learning_rate: float = 1.0, k_min: int = 0, threshold: float = 0.5, max_regions: int | None = None) -> AdaBoost:
    """Stumps by boosting. A row's weight follows from the stumps so far, so each round is one grouped sum over the cube.

    A candidate is used once, and not if both its sides say the same; it stops where no candidate errs on less than half.
    max_regions: after each round, later rounds see only that many of the heaviest regions; off unless given.
    """
    model, used, eps = AdaBoost([], threshold), set(), 1e-12
    index = {(f, v): i for f, v, i in spec.candidates()}
    for _ in range(n_estimators):
        rows = {(r["feature"], r["value"]): r for r in weighted_histogram(cube, spec, model.score()).collect()}  # as many as the domains have values
        first = [r for (f, _), r in rows.items() if f == spec.features[0]]
        p, n, wp, wn = (sum(r[c] for r in first) for c in ("n_pos", "n_neg", "w_pos", "w_neg"))
        if not first or wp + wn <= eps:
            break
        best = None
        for key in sorted(set(index) & set(rows), key=index.get):
            r = rows[key]
            left, right = r["n_pos"] + r["n_neg"], p + n - r["n_pos"] - r["n_neg"]
            if key in used or not left or not right or k_min and any(0 < c < k_min for c in (r["n_pos"], p - r["n_pos"])):
                continue
            says, other = int(r["w_pos"] >= r["w_neg"]), int(wp - r["w_pos"] >= wn - r["w_neg"])
            if says == other:
                continue
            wrong = (r["w_neg"] if says else r["w_pos"]) + (wn - r["w_neg"] if other else wp - r["w_pos"])
            error = wrong / (wp + wn)
            if best is None or round(error, ROUND) < round(best[0], ROUND):
                best = (error, key, says, r)
        if best is None or best[0] >= 0.5:
            break
        error, key, says, r = best
        safe = min(max(error, eps), 1 - eps)
        alpha = learning_rate * 0.5 * math.log((1 - safe) / safe)
        model.stumps.append(Stump(*key, says, alpha, error, r["n_pos"], r["n_neg"], p - r["n_pos"], n - r["n_neg"]))
        used.add(key)
        if error <= eps:
            break
        if max_regions is not None:
            cube = cube.filter(heaviest_regions(cube, model.stumps, model.score(), max_regions))
    return model
