"""String neighbours, percentiles by ranges, numbering and pairing, count providers, Newton steps."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from countspark.operators import metrics, neighbours, ordering, quantiles, report
from countspark.operators.models import linear, providers, trees
from countspark.plans.spec import DatasetSpec


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return sorted({"".join(rng.choices("abé", k=rng.randint(0, 9))) for _ in range(150)} | {"", "a", "x" * 40, "x" * 38 + "yz"})


@pytest.mark.parametrize(("most", "q"), [(0, 2), (1, 2), (2, 2), (3, 2), (2, 3)])
def test_neighbours_within_a_distance(spark, words, most, q):
    df = spark.createDataFrame([(w,) for w in words], "text string")
    got = Counter(map(tuple, neighbours.within(df, df, most, q).collect()))
    assert got == Counter((a, b, d) for a in words for b in words if (d := distance(a, b)) <= most)


def test_neighbours_in_several_blocks(spark):
    """Addresses share nearly all of their grams; blocks of a length meet each other, and none is larger than asked for."""
    rng = random.Random(4)
    urls = sorted({f"http{rng.choice(['', 's'])}://{rng.choice(['blog', 'm'])}.é.example.com/en/{rng.randrange(900)}" for _ in range(200)})
    df = spark.createDataFrame([(u,) for u in urls], "text string")
    got = Counter(map(tuple, neighbours.within(df, df, 3, block=16).collect()))
    assert got == Counter((a, b, d) for a in urls for b in urls if abs(len(a) - len(b)) <= 3 and (d := distance(a, b)) <= 3)


def test_nearest(spark, words):
    left = spark.createDataFrame([(w, 1) for w in words[::3]] * 2 + [(None, 1)], "s string, n int")
    right = spark.createDataFrame([(w,) for w in words], "t string")
    got = sorted(map(tuple, neighbours.nearest(left, right, "s", k=2, most=3, to="t").collect()))
    want = []
    for a in words[::3]:
        near = sorted((d, b) for b in words if b != a and (d := distance(a, b)) <= 3)[:2]
        want += [(a, b, d, k) for k, (d, b) in enumerate(near, 1)]
    assert got == sorted(want)
    assert neighbours.nearest(left.limit(0), right, "s", k=2, most=3, to="t").count() == 0


def test_percentiles(spark):
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=3000), np.round(rng.exponential(size=4000), 1), np.r_[np.zeros(2000), np.ones(1500)], np.r_[rng.normal(size=500) * 1e-9, rng.normal(size=500) * 1e9], np.array([7.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        at = (0.0, 0.01, 0.5, 0.75, 0.95, 0.99, 1.0)
        got = {r.p: r.value for r in quantiles.percentiles(df, "v", at, few=64).collect()}
        assert got == pytest.approx({p: np.percentile(values, 100 * p) for p in at}, rel=1e-12, abs=1e-15)
    assert [r.value for r in quantiles.percentiles(df.limit(0), "v").collect()] == [None] * 4
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (float("inf"),)], "v double")
    got = quantiles.order_statistics(odd, "v", [0, 1, 2, 3])
    assert [got[r] for r in range(3)] == [1.0, 2.0, float("inf")] and np.isnan(got[3])
    with pytest.raises(ValueError):
        quantiles.order_statistics(odd, "v", [4])


def test_ranges_narrow_to_few_rows(spark):
    """No value map of all rows: what comes to the driver is at most `few` values for each rank."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    seen = []
    collect = type(df).collect
    try:
        type(df).collect = lambda self: (seen.append(len(out := collect(self))), out)[1]
        quantiles.order_statistics(df, "v", [100_000], few=100)
    finally:
        type(df).collect = collect
    assert max(seen) <= 100


def test_occurrences_and_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.randint(0, 5), k) for k in range(900)]
    df = spark.createDataFrame(rows, "k int, v int, n int").repartition(5)
    got = ordering.occurrences(df, ["k"], ["v", "n"]).collect()
    want = {}
    for key in {r[0] for r in rows}:
        for i, r in enumerate(sorted(r for r in rows if r[0] == key), 1):
            want[r[2]] = i
    assert {r.n: r["_nth"] for r in got} == want and len(got) == len(rows)
    other = spark.createDataFrame([(k, v, n) for k, v, n in rows[:600]] + [(9, 9, 9)], "k int, v int, n int")
    pairs = ordering.paired(df, other, ["k"], ["v", "n"]).collect()
    left, right = Counter(r[0] for r in rows), Counter([*(r[0] for r in rows[:600]), 9])
    assert len(pairs) == sum((left | right).values())
    assert sum(r.n is not None and r.n_b is not None for r in pairs) == sum((left & right).values())
    assert ordering.paired(df.limit(0), other.limit(0), ["k"], ["v"]).count() == 0


def test_validation_pairs_shared_keys(spark):
    a = spark.createDataFrame([(1, 0, 0.2, 0), (1, 1, 0.9, 1), (1, 1, 0.4, 0), (2, 1, 0.6, 1)], "k int, y int, risk double, pred int")
    b = a.withColumn("pred", (F.col("risk") >= 0.4).cast("int"))
    got = report.validation(a, b, ["k"], order=["y", "risk"]).first()
    assert (got.n, got.agreement, got.accuracy_a, got.accuracy_b) == (4, 0.75, 0.75, 1.0)


SPEC = DatasetSpec({"color": ["red", "blue", "green"], "shape": ["round", "square"], "size": ["s", "m", "l", "xl"]})


@pytest.fixture(scope="module")
def table():
    rng = random.Random(8)
    rows = []
    for _ in range(2000):
        r = {f: rng.choice([*vs, "other"] if f == "size" else vs) for f, vs in SPEC.domains.items()}
        p = 0.1 + 0.5 * (r["color"] == "red") + 0.3 * (r["shape"] == "round") * (r["size"] in ("s", "other"))
        rows.append((*r.values(), int(rng.random() < p)))
    return rows


def test_tree_from_a_users_counts(spark, table):
    """A tree fitted through a function that counts one path, value and class equals the one over the cube; each path is asked for once."""
    names = [*SPEC.features, "y"]
    df = spark.createDataFrame(table, "color string, shape string, size string, y int")
    cube = df.groupBy(*SPEC.features).agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg")).persist()
    p = sum(r[-1] for r in table)

    def count(path, feature, value, cls):
        rows = (dict(zip(names, r)) for r in table)
        return sum(r["y"] == cls and r[feature] == value and all((r[f] == v) == branch for f, v, branch in path) for r in rows)

    for criterion, k_min in (("gini", 0), ("entropy", 0), ("gini", 11)):
        own = providers.Known(providers.QueryCounts(spark, SPEC, count))
        fitted = trees.random_forest(cube, SPEC, p, len(table) - p, n_trees=3, max_features=2, criterion=criterion, k_min=k_min)
        users = trees.random_forest(own.provider, SPEC, p, len(table) - p, n_trees=3, max_features=2, criterion=criterion, k_min=k_min)
        assert [t.nodes for t in fitted.trees] == [t.nodes for t in users.trees]
        paths = [(), (("color", "red", True),), (("color", "red", False),), (("color", "red", False), ("shape", "round", True)), (("shape", "round", True), ("color", "red", False))]
        known = providers.Known(providers.CubeCounts(cube, SPEC))
        for path, found in zip(paths, known(paths)):
            assert [found[0].tolist(), found[1].tolist()] == [[count(path, f, v, cls) for f, v, _ in SPEC.candidates()] for cls in (1, 0)]
        assert known.asked == 3  # all rows, red, and red's complement with round: the rest follows
        known(paths)
        assert known.asked == 3


def test_newton_steps_against_numpy(spark, table):
    df = spark.createDataFrame(table, "color string, shape string, size string, y int")
    cube = df.groupBy(*SPEC.features).agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))
    p = sum(r[-1] for r in table)
    model = linear.Logistic.fit(cube, SPEC, p, len(table) - p).refine(cube)
    x = np.array([[1.0, *(float(r[SPEC.features.index(f)] == v) for f, v in model.index)] for r in table])
    y, beta = np.array([r[-1] for r in table], float), np.zeros(len(model.index) + 1)
    for _ in range(40):
        mu = 1 / (1 + np.exp(-x @ beta))
        w = mu * (1 - mu)
        beta = np.linalg.solve(x.T @ (x * w[:, None]) + 0.01 * np.eye(len(beta)), x.T @ (w * (x @ beta) + y - mu))
    assert model.beta == pytest.approx(beta, abs=1e-5)
    assert "Python" not in cube._jdf.queryExecution().toString()
    empty = linear.Logistic.fit(cube.limit(0), SPEC, 0, 0).refine(cube.limit(0))
    assert not empty.beta.any()


def test_metrics_at_the_populations_rate(spark):
    """Weighing classes is the same as repeating rows until positives have the population's share."""
    rng = random.Random(9)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.5)) for _ in range(400)]
    p, n = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    df = spark.createDataFrame(rows, "risk double, y int")
    rate = p / (p + 9 * n)  # each negative nine times
    got = metrics.at_population_rate(metrics.curve(df, F.col("risk")), p / (p + n), rate).first()
    many = spark.createDataFrame([r for r in rows for _ in range(1 if r[1] else 9)], "risk double, y int")
    want = metrics.ranking(metrics.curve(many, F.col("risk"))).first()
    assert got.f1_population == pytest.approx(want.f1_best) and got.pr_auc_population == pytest.approx(want.pr_auc)
    assert metrics.at_population_rate(metrics.curve(df.filter("y = 1"), F.col("risk")), 0.5, 0.1).first().f1_population is None
