from collections import Counter

import numpy as np
import pytest

from countspark.llm import embeddings, queries


def slow(rows, least=0.95):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(len(v), []).append(k)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for ks in ok.values():
        x = np.array([rows[k][1] for k in ks], float)
        n = np.linalg.norm(x, axis=1)
        near = x @ x.T / (n[:, None] * n) >= least
        for a in range(len(ks)):
            links[ks[a]] = int(near[a].sum()) - 1
            for b in np.flatnonzero(near[a]):
                root[max(find(ks[a]), find(ks[b]))] = min(find(ks[a]), find(ks[b]))
    best = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        best[r] = min((x for x in (best.get(r), i) if x is not None), default=None)
    return [(i, links[k], best[find(k)], None if i is None else best[find(k)] == i) for k, (i, _) in enumerate(rows)]


def rows_of():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(600, 32)).astype(np.float32)
    rows = [(5000 - k, v.tolist()) for k, v in enumerate(base)]
    rows += [(6000 + k, (v + 0.12 * rng.normal(size=32)).astype(np.float32).tolist()) for k, v in enumerate(base[:200])]
    rows += [(7000 + k, base[0].tolist()) for k in range(150)]
    rows += [(8000 + k, (base[1] + 0.1 * rng.normal(size=32)).astype(np.float32).tolist()) for k in range(300)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [None] + [1.0] * 31), (9005, [float("inf")] + [1.0] * 31)]
    return rows + [(9010, [1.0, 2.0]), (9011, [2.0, 4.0]), (9012, [-1.0]), (9013, [3.0]), (9014, [1.0])]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x, y = embeddings.unit(rng.normal(size=(2000, 64))), embeddings.unit(rng.normal(size=(200, 64)))
    codes, factors = embeddings.encode(x)
    estimate, error = embeddings.bounds(y, codes, factors)
    off = estimate - y @ x.T
    assert abs(off.mean()) < 0.002 and (np.abs(off) > error).mean() < 1e-3


@pytest.mark.parametrize("block", [embeddings.BLOCK, 60])
def test_against_brute_force(spark, block):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, kept string").repartition(6)
    got = {tuple(r) for r in embeddings.near_duplicates(df, block=block).collect()}
    want = set(slow(rows))
    assert len(got) == len(rows)
    assert len(got - want) <= 0.002 * len(rows)
    links, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.999 * true <= links <= true


EXACT = {"nearest": None, "deviations": None}


@pytest.mark.parametrize("how", [EXACT, {}])
def test_repeated_and_null_ids_against_brute_force(spark, how):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 24))
    rows = [(int(k) % 9 if k % 5 else None, (v + 0.05 * rng.normal(size=24)).tolist()) for k in range(3) for v in base]
    rows = [(None if k % 5 == 0 else k % 9, v) for k, (_, v) in enumerate(rows)] + [(3, base[0].tolist())] * 4 + [(None, base[1].tolist())] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, embeddings.near_duplicates(df, block=50, **how).collect())) == Counter(slow(rows))


def test_links_belong_to_rows_not_ids(spark):
    schema = "vec_id long, embedding array<float>"
    got = Counter(map(tuple, embeddings.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01])], schema)).collect()))
    assert got == Counter([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False)])
    got = Counter(map(tuple, embeddings.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.01])], schema)).collect()))
    assert got == Counter([(1, 1, 1, True), (None, 1, 1, None)])


def test_strings_and_extreme_numbers(spark):
    rows = [("b", [1e200, 0.0]), ("a", [1e-200, 1e-202]), ("c", [0.0, 5.0]), (None, None)]
    got = Counter(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()))
    assert got == Counter([("b", 1, "a", False), ("a", 1, "a", True), ("c", 0, "c", True), (None, 0, None, None)])


def test_the_threshold_does_not_depend_on_the_block(spark):
    """Many pairs at exactly the threshold, in dense and in sparse blocks."""
    rng = np.random.default_rng(3)
    rows = [(k, (np.array([19.0, np.sqrt(39.0)]) if k % 2 else np.array([20.0, 0.0])).tolist() + [0.0] * 14) for k in range(6)]
    rows = [(k, [x * float(f) for x in v]) for (k, v), f in zip(rows, rng.integers(1, 9, 6))]
    rows += [(10 + k, rng.normal(size=16).tolist()) for k in range(300)]
    schema = "vec_id long, embedding array<double>"
    one = {(r.vec_id, r.n_links) for r in embeddings.near_duplicates(spark.createDataFrame(rows, schema), **EXACT).collect() if r.vec_id < 10}
    two = {(r.vec_id, r.n_links) for r in embeddings.near_duplicates(spark.createDataFrame(rows[:6], schema), **EXACT).collect()}
    three = {(r.vec_id, r.n_links) for r in embeddings.near_duplicates(spark.createDataFrame(rows, schema)).collect() if r.vec_id < 10}
    assert one == two == three


def recall(got, want):
    """The share of the true links that were found; no false ones."""
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))
    return sum(r[1] for r in got) / sum(r[1] for r in want)


def test_recall_near_the_threshold(spark):
    """2,000 pairs at cosines from 0.95 to 0.96 among 10,000 vectors: the hardest that there are."""
    rng = np.random.default_rng(9)
    base = embeddings.unit(rng.normal(size=(8000, 64)))
    aside = rng.normal(size=(2000, 64))
    aside = embeddings.unit(aside - (aside * base[:2000]).sum(1, keepdims=True) * base[:2000])
    c = rng.uniform(0.9501, 0.96, (2000, 1))
    every = np.concatenate([base, c * base[:2000] + np.sqrt(1 - c * c) * aside]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(every)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect()
    found = recall([tuple(r) for r in got], slow(rows))
    print("recall at 0.95-0.96:", found)
    assert found >= 0.99


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, sf, tmp_path):
    """The table as it is, and with vectors at cosines from 0.95 to 0.96 beside its own."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op6_embeddings(spark, f"/root/testdata/{sf}").collect()) == Counter(slow(rows))
    base = embeddings.unit(np.array([v for _, v in rows[:1000] if v], float))
    rng = np.random.default_rng(2)
    aside = rng.normal(size=base.shape)
    aside = embeddings.unit(aside - (aside * base).sum(1, keepdims=True) * base)
    c = rng.uniform(0.9501, 0.96, (len(base), 1))
    rows += [(10**6 + k, v.tolist()) for k, v in enumerate((c * base + np.sqrt(1 - c * c) * aside).astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = recall([tuple(r) for r in queries.op6_embeddings(spark, str(tmp_path)).collect()], slow(rows))
    print("recall", sf, found)
    assert found >= 0.99


def test_nulls_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = {tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None), (None, [0.0, 1.0])], schema)).collect()}
    assert got == {(1, 1, 1, True), (None, 1, 1, None), (None, 0, None, None)}
