"""Models against plain versions of their formulas on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from countspark.operators import analysis, baselines, counts, metrics, report, suppress
from countspark.operators.models import histogram, linear, naive_bayes, trees
from countspark.plans import queries
from countspark.plans.spec import DatasetSpec, discover

SPEC = DatasetSpec({"color": ["red", "blue", "green"], "shape": ["round", "square"], "size": ["1", "2", "3", "10"]}, numeric=("score",), parents={"shape": ("color",)})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(240):
        c, s, z = rng.choice(SPEC.domains["color"]), rng.choice(SPEC.domains["shape"]), rng.choice(SPEC.domains["size"])
        y = int(rng.random() < 0.15 + 0.5 * (c == "red") + 0.25 * (s == "round") * (z != "10"))
        out.append({"i": i, "color": c.upper(), "shape": s, "size": int(z), "score": 3.0 * y + rng.random(), "y": y})
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows)


def value(r, f):
    return str(r[f]).lower()


def totals(rows):
    p = sum(r["y"] for r in rows)
    return p, len(rows) - p


def scored(model, df, **how):
    return {r["i"]: (r["risk"], r["pred"]) for r in model.transform(df, **how).collect()}


def test_marginals_sum_to_totals(df, rows):
    p, n = totals(rows)
    got = counts.marginals(df, SPEC).collect()
    for f in SPEC.features:
        assert (sum(r.n_pos for r in got if r.feature == f), sum(r.n_neg for r in got if r.feature == f)) == (p, n)
    again = counts.marginals_of_cube(counts.cube(df, SPEC), SPEC).collect()
    assert sorted(got) == sorted(again)
    pairs = counts.pairwise(counts.cube(df, SPEC), SPEC).collect()
    for v in SPEC.domains["color"]:
        assert sum(r.cnt for r in pairs if r.fa == "color" and r.va == v and r.fb == "size") == sum(value(r, "color") == v for r in rows)
    cpt = counts.cpt(df, SPEC).collect()
    for v in SPEC.domains["shape"]:
        assert sum(r.n_pos for r in cpt if r.feature == "shape" and r.value == v) == next(r.n_pos for r in got if r.feature == "shape" and r.value == v)


def test_discovered_domains(df):
    assert discover(df, ["size", "shape"]).domains == {"size": ["1", "2", "3", "10"], "shape": ["round", "square"]}


@pytest.mark.parametrize("bad", [{"color": ("color",)}, {"color": ("shape",), "shape": ("color",)}, {"color": ("nothing",)}])
def test_bad_parents(bad):
    with pytest.raises(ValueError):
        DatasetSpec(SPEC.domains, parents=bad)


def test_naive_bayes(df, rows):
    p, n = totals(rows)
    got = scored(naive_bayes.NaiveBayes.fit(counts.marginals(df, SPEC), SPEC, p, n), df)
    for r in rows:
        lp, ln = math.log(p / (p + n) + 1e-10), math.log(n / (p + n) + 1e-10)
        for f in SPEC.features:
            k = len(SPEC.domains[f])
            same = [x["y"] for x in rows if value(x, f) == value(r, f)]
            lp += math.log((sum(same) + 1) / (p + k))
            ln += math.log((len(same) - sum(same) + 1) / (n + k))
        assert got[r["i"]][0] == pytest.approx(1 / (1 + math.exp(ln - lp)), abs=1e-9)
        assert got[r["i"]][1] == int(lp > ln)


def test_unseen_value_says_nothing(spark, df, rows):
    p, n = totals(rows)
    model = naive_bayes.NaiveBayes.fit(counts.marginals(df, SPEC), SPEC, p, n, prior=0.5)
    new = spark.createDataFrame([("violet", "hex", "77", 0), (None, None, None, 0)], "color string, shape string, size string, i int")
    assert [round(r.risk, 9) for r in model.transform(new).collect()] == [0.5, 0.5]


def test_gaussian(df, rows):
    got = scored(naive_bayes.GaussianNaiveBayes.fit(counts.gaussian_stats(df, ("score",))), df)
    x = {c: np.array([r["score"] for r in rows if r["y"] == c]) for c in (0, 1)}
    eps = 1e-9 * max(np.var([r["score"] for r in rows]), x[0].var(), x[1].var())
    for r in rows:
        log = {c: math.log(len(x[c]) / len(rows) + 1e-12) - 0.5 * (math.log(2 * math.pi * (x[c].var() + eps)) + (r["score"] - x[c].mean()) ** 2 / (x[c].var() + eps)) for c in (0, 1)}
        assert got[r["i"]][0] == pytest.approx(1 / (1 + math.exp(log[0] - log[1])), abs=1e-6)


def test_gaussian_refuses_gaps(spark):
    with pytest.raises(Exception, match="must be a number"):
        counts.gaussian_stats(spark.createDataFrame([("a", 1), ("2", 0)], "score string, y int"), ("score",)).collect()


def test_bayes_net(spark, df, rows):
    p, n = totals(rows)
    model = naive_bayes.BayesNet.fit(counts.cpt(df, SPEC), SPEC, p, n)
    got = scored(model, df)
    for r in rows[:60]:
        log = {1: math.log(p / (p + n) + 1e-12), 0: math.log(n / (p + n) + 1e-12)}
        for f in SPEC.features:
            like = [x for x in rows if all(value(x, q) == value(r, q) for q in SPEC.parents.get(f, ()))]
            for c in (0, 1):
                at = [x for x in like if x["y"] == c]
                log[c] += math.log((sum(value(x, f) == value(r, f) for x in at) + 1) / (len(at) + len(SPEC.domains[f])))
        assert got[r["i"]][0] == pytest.approx(1 / (1 + math.exp(log[0] - log[1])), abs=1e-9)
    # an unknown parent falls back to the feature's own distribution
    new = spark.createDataFrame([("violet", "round", "1", 1)], "color string, shape string, size string, i int")
    assert 0 < scored(model, new)[1][0] < 1


def test_histogram(df, rows):
    p, n = totals(rows)
    model = histogram.HistogramClassifier.fit(counts.marginals(df, SPEC), SPEC, p, n)
    got = scored(model, df)
    prior = p / (p + n)
    risk, weight = {}, {}
    for f in SPEC.features:
        for v in SPEC.domains[f]:
            at = [x["y"] for x in rows if value(x, f) == v]
            risk[f, v] = (sum(at) + 1) / (len(at) + 2)
        weight[f] = 1 + sum(sum(value(x, f) == v for x in rows) / len(rows) * abs(risk[f, v] - prior) for v in SPEC.domains[f])
    for r in rows:
        want = sum(weight[f] * risk[f, value(r, f)] for f in weight) / sum(weight.values())
        assert got[r["i"]] == (pytest.approx(want, abs=1e-9), int(want >= prior))


def slow_tree(rows, features, depth, k_min=0):
    p, n = totals(rows)
    if not depth or not p or not n:
        return p / (p + n) if rows else 0.0
    gini = lambda a, b: 1 - (a / (a + b)) ** 2 - (b / (a + b)) ** 2 if a + b else 0.0
    best = None
    for f, v in ((f, v) for f in features for v in SPEC.domains[f]):
        left = [r for r in rows if value(r, f) == v]
        a, b = totals(left)
        if not left or len(left) == len(rows) or k_min and any(0 < x < k_min for x in (a, p - a)):
            continue
        gain = gini(p, n) - len(left) / len(rows) * gini(a, b) - (len(rows) - len(left)) / len(rows) * gini(p - a, n - b)
        if best is None or round(gain, 12) > round(best[0], 12):
            best = (gain, f, v)
    if best is None or best[0] <= 0:
        return p / (p + n)
    _, f, v = best
    return f, v, slow_tree([r for r in rows if value(r, f) == v], features, depth - 1, k_min), slow_tree([r for r in rows if value(r, f) != v], features, depth - 1, k_min)


def walk(tree, r):
    while isinstance(tree, tuple):
        tree = tree[2] if value(r, tree[0]) == tree[1] else tree[3]
    return tree


@pytest.mark.parametrize(("depth", "k_min"), [(1, 0), (3, 0), (4, 5)])
def test_decision_tree(df, rows, depth, k_min):
    p, n = totals(rows)
    cube = counts.cube(df, SPEC).persist()
    got = scored(trees.decision_tree(cube, SPEC, p, n, max_depth=depth, k_min=k_min), df)
    want = slow_tree(rows, SPEC.features, depth, k_min)
    assert all(got[r["i"]][0] == pytest.approx(walk(want, r), abs=1e-12) for r in rows)


def test_forest(df, rows):
    p, n = totals(rows)
    cube = counts.cube(df, SPEC).persist()
    model = trees.random_forest(cube, SPEC, p, n, n_trees=4, max_depth=2, max_features=2, seed=1)
    assert model.subsets[0] == SPEC.features and all(len(s) == 2 for s in model.subsets[1:])
    got = scored(model, df)
    want = [slow_tree(rows, s, 2) for s in model.subsets]
    assert all(got[r["i"]][0] == pytest.approx(sum(walk(t, r) for t in want) / 4, abs=1e-12) for r in rows)
    assert model.describe().count("tree ") == 4


@pytest.mark.parametrize(("rule", "want"), [(None, 7), ("all", 7), ("sqrt", 3), ("log2", 3), (0.5, 4), (4, 4), (99, 7)])
def test_number_of_features(rule, want):
    assert trees.n_features_of(rule, 7) == want


def test_adaboost(df, rows):
    model = trees.adaboost(counts.cube(df, SPEC), SPEC, n_estimators=4)
    w = [1 / len(rows)] * len(rows)
    score, used = [0.0] * len(rows), set()
    for stump in model.stumps:
        best = None
        for f, v in ((f, v) for f in SPEC.features for v in SPEC.domains[f]):
            left = [value(r, f) == v for r in rows]
            if (f, v) in used or not any(left) or all(left):
                continue
            says = {}
            for side in (True, False):
                at = [(r["y"], x) for r, x, s in zip(rows, w, left) if s == side]
                says[side] = sum(x for y, x in at if y) >= sum(x for y, x in at if not y)
            if says[True] == says[False]:
                continue
            error = sum(x for r, x, s in zip(rows, w, left) if says[s] != bool(r["y"])) / sum(w)
            if best is None or round(error, 12) < round(best[0], 12):
                best = (error, f, v, says, left)
        error, f, v, says, left = best
        assert (stump.feature, stump.value) == (f, v) and stump.error == pytest.approx(error)
        alpha = 0.5 * math.log((1 - error) / error)
        for i, r in enumerate(rows):
            h = 1 if says[left[i]] else -1
            score[i] += alpha * h
            w[i] *= math.exp(-alpha * h * (1 if r["y"] else -1))
        used.add((f, v))
    got = scored(model, df)
    assert all(got[r["i"]][0] == pytest.approx(1 / (1 + math.exp(-2 * s))) for r, s in zip(rows, score))


def design(rows, index):
    return np.array([[1.0] + [float(value(r, f) == v) for f, v in index] for r in rows])


def test_least_squares_and_logistic(df, rows):
    p, n = totals(rows)
    cube = counts.cube(df, SPEC).persist()
    model = linear.Logistic.fit(cube, SPEC, p, n, ridge=0.01)
    x, y = design(rows, model.index), np.array([r["y"] for r in rows])
    assert np.allclose(model.beta, np.linalg.solve(x.T @ x + 0.01 * np.eye(x.shape[1]), x.T @ y))
    w = np.where(y == 1, len(y) / (2 * p), len(y) / (2 * n))
    exact = linear.Logistic.fit(cube, SPEC, p, n, ridge=0.01, balanced=True, exact_weights=True)
    assert np.allclose(exact.beta, np.linalg.solve((x.T * w) @ x + 0.01 * np.eye(x.shape[1]), x.T @ (w * y)))
    refined = model.refine(cube)
    beta = refined.beta
    mu = 1 / (1 + np.exp(-(x @ beta)))
    assert np.abs(x.T @ (y - mu) - 0.01 * beta).max() < 1e-4
    got = scored(refined, df)
    assert np.allclose([got[r["i"]][0] for r in rows], mu)
    clipped = scored(model, df, use_sigmoid=False)
    assert np.allclose([clipped[r["i"]][0] for r in rows], np.clip(x @ model.beta, 0, 1))


def test_platt(df, rows):
    scored_rows = df.selectExpr("y", "score / 4 as risk")
    a, b = linear.fit_platt(scored_rows)
    x, y = np.array([[r["score"] / 4, 1] for r in rows]), np.array([r["y"] for r in rows])
    assert abs(a) > 1 or np.abs(x.T @ (y - 1 / (1 + np.exp(-(x @ [a, b]))))).max() < 1e-3


def test_metrics(spark, rows):
    rng = random.Random(1)
    data = [(round(rng.random() * 0.6 + 0.3 * r["y"], 1), r["y"]) for r in rows]
    got = metrics.metrics(spark.createDataFrame(data, "risk double, y int")).first()
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    f1 = max(2 * sum(a >= t for a in pos) / (sum(a >= t for a in pos) + sum(b >= t for b in neg) + len(pos)) for t in {s for s, _ in data})
    ap, last = 0.0, 0
    for t in sorted({s for s, _ in data}, reverse=True):
        tp, fp = sum(a >= t for a in pos), sum(b >= t for b in neg)
        ap, last = ap + (tp - last) / len(pos) * tp / (tp + fp), tp
    assert (got.roc_auc, got.pr_auc, got.f1_best) == (pytest.approx(auc), pytest.approx(ap), pytest.approx(f1))
    assert got.f1_shifted == pytest.approx(f1) and got.tp == sum(a >= 0.5 for a in pos)


def test_metrics_read_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def score(x):
        read.add(1)
        return x

    df = spark.range(100).select(F.udf(score, "double")(F.col("id") / 100).alias("risk"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = metrics.metrics(df).first()
    assert (got.tp + got.fn, got.fp + got.tn) == (34, 66)
    assert read.value == 100


def test_metrics_of_counts(spark, rows):
    data = [(r["score"] / 4, r["y"]) for r in rows] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(data, "risk double, y int").withColumn("pred", (F.col("risk") >= 0.6).cast("int"))
    cells = df.groupBy("risk", "y", "pred").agg(F.count("*").alias("n"))
    both = lambda f: (f(df, None), f(cells, "n"))
    for f in (
        lambda d, w: metrics.metrics(d, weight=w),
        lambda d, w: metrics.evaluate_with(d, F.col("risk"), weight=w),
        lambda d, w: metrics.ranking(metrics.curve(d, F.col("risk"), weight=w)),
        lambda d, w: counts.agreement(d, "pred", "y", weight=w),
        lambda d, w: report.confusion_cells(d.filter("y is not null and pred is not null"), weight=w).orderBy("actual", "predicted"),
    ):
        one, other = both(f)
        assert [tuple(r) for r in one.collect()] == [pytest.approx(tuple(r)) for r in other.collect()]
    known = df.filter("risk is not null and y is not null")
    assert linear.fit_platt(known) == pytest.approx(linear.fit_platt(known.groupBy("risk", "y").agg(F.count("*").alias("n")), weight="n"))


def test_metrics_of_naive_bayes_join_once(spark):
    """What these queries return reads counts of the lines, not the lines."""
    for name in ("full_metrics", "roc_auc", "nb_confusion", "model_agreement", "confusion_cells"):
        assert not [f for f in queries.queries()[name](spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


def test_one_class_has_no_ranking(spark):
    got = metrics.metrics(spark.createDataFrame([(0.5, 1), (0.7, 1)], "risk double, y int")).first()
    assert got.roc_auc is None and got.pr_auc is None and got.f1_best is None
    assert metrics.metrics(spark.createDataFrame([], "risk double, y int")).first().tp == 0


def test_suppression(spark):
    df = spark.createDataFrame([(0,), (1,), (10,), (11,)], "cnt long")
    assert [r.cnt for r in suppress.suppress(df, ["cnt"]).collect()] == [0, 5, 5, 11]
    assert [r.cnt for r in suppress.suppress(df, ["cnt"], k=1).collect()] == [0, 1, 10, 11]
    assert suppress.policy() == "cms_k11_fixed_midpoint_5" and suppress.policy(1) == "none"


def test_analyses(df, rows):
    cube = counts.cube(df, SPEC).persist()
    lda = analysis.Discriminant.fit(df, ["score"]).transform(df)
    assert metrics.confusion(lda, lda.pred).first().acc > 0.9
    values, parts = analysis.principal_components(df.selectExpr("score", "size"), ["score", "size"], 2)
    want = np.linalg.eigh(np.cov(np.array([[r["score"], r["size"]] for r in rows]).T, bias=True))[0][::-1]
    assert np.allclose(values, want) and np.allclose(parts @ parts.T, np.eye(2))
    centers, _ = analysis.k_modes(cube, SPEC, [{"color": "red", "shape": "round", "size": "1"}, {"color": "blue", "shape": "square", "size": "2"}])
    assert len(centers) == 2
    boosted = analysis.boosted_stumps(cube, SPEC, n_estimators=20).transform(df)
    assert metrics.confusion(boosted, boosted.pred).first().acc >= max(totals(rows)) / len(rows)


def test_region_pruning(df):
    cube = counts.cube(df, SPEC).persist()
    every = trees.adaboost(cube, SPEC, n_estimators=4)
    assert trees.adaboost(cube, SPEC, n_estimators=4, max_regions=1000).stumps == every.stumps
    few = trees.adaboost(cube, SPEC, n_estimators=4, max_regions=2)
    assert few.stumps[:1] == every.stumps[:1] and len(few.stumps) >= 1


@pytest.mark.parametrize("table", [(3, 1, 1, 3), (10, 0, 2, 9), (0, 5, 5, 0), (7, 7, 7, 7), (0, 0, 3, 4), (1, 30, 4, 25), (200, 90, 150, 260)])
def test_fisher(table):
    a, b, c, d = table
    rows, cols, n = a + b, a + c, a + b + c + d
    p = {k: math.comb(cols, k) * math.comb(n - cols, rows - k) / math.comb(n, rows) for k in range(max(0, rows + cols - n), min(rows, cols) + 1)}
    assert analysis.fisher_exact(*table) == pytest.approx(min(1, sum(x for x in p.values() if x <= p[a] * (1 + 1e-9))), rel=1e-6)


def test_empty_cube(spark):
    empty = spark.createDataFrame([], "color string, shape string, size string, score double, y int")
    cube = counts.cube(empty, SPEC)
    assert all(r.n_pos == 0 for r in counts.marginals_of_cube(cube, SPEC).collect())
    assert trees.adaboost(cube, SPEC).stumps == []
    with pytest.raises(ValueError):
        naive_bayes.NaiveBayes.fit(counts.marginals(empty, SPEC), SPEC, 0, 0)


@pytest.mark.parametrize("kind", ["tree", "logistic", "svm"])
def test_baselines_fit_cells(df, kind, monkeypatch):
    """A fit sees each different row once, with its weight, and decides as one on all rows does."""
    from pyspark.ml import Pipeline

    sizes, fitted = [], Pipeline._fit
    monkeypatch.setattr(Pipeline, "_fit", lambda self, rows: sizes.append(rows.count()) or fitted(self, rows))
    by_cells = baselines.fit(kind, df, SPEC)
    monkeypatch.setattr(baselines, "WEIGHTED", ())
    by_rows = baselines.fit(kind, df, SPEC)
    assert sizes == [df.select("y", *SPEC.features).distinct().count(), df.count()]
    a, b = ([r.pred for r in baselines.transform(m, df, SPEC).orderBy("i").collect()] for m in (by_cells, by_rows))
    assert a == b


def test_baselines_agree(df, rows):
    p, n = totals(rows)
    ours = scored(trees.decision_tree(counts.cube(df, SPEC).persist(), SPEC, p, n), df)
    theirs = {r["i"]: r["pred"] for r in baselines.transform(baselines.fit("tree", df, SPEC), df, SPEC).collect()}
    assert np.mean([ours[i][1] == theirs[i] for i in theirs]) > 0.95  # it merges leaves of one class, so only classes compare
    g = scored(naive_bayes.GaussianNaiveBayes.fit(counts.gaussian_stats(df, ("score",))), df)
    m = {r["i"]: r["pred"] for r in baselines.transform(baselines.fit_gaussian(df, ["score"]), df).collect()}
    assert np.mean([g[i][1] == m[i] for i in m]) > 0.98
