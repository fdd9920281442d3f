import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from countspark.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_gradient_by_recovery():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    s = x @ np.array([1.5, -1.0, 0.0]) + rng.logistic(size=4000)
    y = np.searchsorted([0.0, 1.0, 2.5], s)
    w, t = toxicity.fit_ordinal(toxicity.Rows(*np.nonzero(x), x[np.nonzero(x)], x.shape), y, 3, ridge=0, steps=600)
    assert np.allclose(w, [1.5, -1.0, 0.0], atol=0.15)
    assert np.allclose(t, [0.0, 1.0, 2.5], atol=0.2)


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.filter(~held))
    graded = toxicity.grade(docs, model).join(labels.filter(held).select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    caught = graded[graded.y == 1].toxic.mean()
    wrong = graded[graded.y == 0].toxic.mean()
    print("recall", caught, "false positives", wrong)
    assert caught > 0.9 and wrong < 0.01
    assert graded[graded.y == 1].severity.mean() > graded[graded.y == 0].severity.mean() + 0.8
    assert graded.severity.between(0, toxicity.GRADES).all()
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.grade(docs, model).filter("not toxic").count()


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(1, None), (None, 1)]])
def test_nothing_to_learn(spark, labels):
    docs = spark.createDataFrame([(1, "an idiot", 5), (2, None, 6), (None, "", 7), (1, "an idiot", 5)], "doc_id long, text string, severity int")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r.toxic for r in toxicity.grade(docs, model).collect()] == [False] * 4
    assert toxicity.drop_toxic(docs, model).count() == 4
    assert toxicity.grade(docs.limit(0), model).count() == 0


def plain_features(text):
    out = {}
    for word in re.findall(r"\w+", (text or "").lower()):
        for said in {"=" + word} | {word[:n] for n in (4, 5, 6) if len(word) >= n}:
            f = zlib.crc32(said.encode())
            out[f] = out.get(f, 0) + 1
    return out


def plain_grade(model, text):
    s = sum(model.weights[model.index[f]] * math.log1p(n) for f, n in sorted(plain_features(text).items()) if f in model.index)
    over = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
    each = [a - b for a, b in zip([1, *over], [*over, 0])]
    return sum(over), over[0], max(range(len(each)), key=lambda k: each[k]), over[0] >= model.cut


def test_query_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    by_text = {}
    for i, y in toxic.items():
        if i in texts and texts[i] is not None and y is not None:
            by_text[texts[i]] = max(y, by_text.get(texts[i], 0))
    order = sorted(by_text, key=lambda t: hashlib.md5(t.encode()).digest())
    found = [plain_features(t) for t in order]
    given = pa.table({"toxic": [by_text[t] for t in order], "keys": pa.array([np.array(sorted(f), np.uint32).view(np.int32) for f in found], pa.list_(pa.int32())), "counts": pa.array([[f[k] for k in sorted(f)] for f in found], pa.list_(pa.int32()))})
    sizes = {y: sum(v == y for v in by_text.values()) for y in (0, 1)}
    model = toxicity._fit(given.combine_chunks(), sizes)
    got = queries.op2_toxicity(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        severity, p, grade, cut = plain_grade(model, texts[r.doc_id])
        assert abs(r.severity - severity) < 1e-6 and abs(r.p_toxic - p) < 1e-6
        assert r.grade == grade and (r.toxic == cut or abs(p - model.cut) < 1e-9)


def made(n_toxic, n_other, each=1):
    rows = [(k, f"some words {k} vilest{k % 3} insult " * each) for k in range(n_toxic)] + [(10_000 + k, f"other words {k} kind talk " * each) for k in range(n_other)]
    return rows, [(i, int(i < 10_000)) for i, _ in rows]


def test_rare_and_few_toxic_texts_are_learnt(spark):
    for n_toxic, n_other, how in ((3, 30, {}), (5, 3000, {"sample": 400}), (60, 200, {"sample": 40}), (4, 40, {"features": None, "support": 0})):
        rows, labels = made(n_toxic, n_other)
        docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
        model = toxicity.fit(docs, spark.createDataFrame(labels + [(10**6, 1)], "doc_id long, toxic int"), **how)
        got = {r.doc_id: r.toxic for r in toxicity.grade(docs, model).collect()}
        assert got == {i: i < 10_000 for i, _ in rows}


def test_one_toxic_text_is_learnt_and_every_telling_feature_kept(spark):
    rows, labels = made(1, 30)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.grade(docs, toxicity.fit(docs, marks)).collect()}
    assert got == {i: i < 10_000 for i, _ in rows}
    many = [(k, " ".join(f"vile{k % 12}x{j}" for j in range(150))) for k in range(60)] + [(10_000 + k, f"kind {k} talk") for k in range(300)]
    docs, marks = spark.createDataFrame(many, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 10_000)) for i, _ in many], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, marks).index) > 1800  # a word and its beginnings for each


def test_long_texts_count_alike_in_fit_and_scores(spark):
    rows, labels = made(20, 60, each=500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.grade(docs, model).collect()
    assert {r.doc_id: r.toxic for r in got} == dict((i, bool(y)) for i, y in labels)
    for r in got[:3] + got[-3:]:
        assert abs(r.severity - plain_grade(model, dict(rows)[r.doc_id])[0]) < 1e-6
    long = spark.createDataFrame([(1, "insult " * 300_000), (2, "word " * 300_000)], "doc_id long, text string")
    assert {r.doc_id: r.toxic for r in toxicity.grade(long, model).collect()} == {1: True, 2: False}


def test_a_repeated_id_is_bounded_and_ties_of_the_cut_are_toxic(spark):
    rows, labels = made(30, 300)
    docs = spark.createDataFrame([(7, t) for _, t in rows[:30]] * 20 + rows, "doc_id long, text string")
    assert toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), sample=50).weights.size
    model = toxicity.Severity({}, np.zeros(0), np.array([0.0, 1.0, 2.0]), cut=0.5)
    assert all(r.toxic for r in toxicity.grade(docs, model).collect())
