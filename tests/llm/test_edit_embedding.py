import hashlib

import numpy as np
import pytest

from countspark.llm import edit_embedding as ee
from countspark.llm import queries


def slow_walk(text):
    bits = np.random.default_rng(ee.SEED).integers(0, 2, (ee.CLASSES, ee.PERIOD))
    bits[:, -1] = 1
    out, i, step = [], 0, 0
    while i < len(text):
        out.append(text[i])
        i += bits[(ord(text[i]) * 2654435761 >> 12) % ee.CLASSES, step % ee.PERIOD]
        step += 1
    return out


@pytest.mark.parametrize("text", ["", "a", "The quick brown fox é " * 50, "ab" * 9000])
def test_walk_and_samples(text):
    written = slow_walk(text)
    steps = ee.walk(text)
    assert len(written) == (steps[-1] if len(text) else 0)
    _, choices = ee._shared()
    got = ee.samples(text, steps)
    if text:
        want = [written[max(c for c in row if c < len(written))] for row in choices.tolist()]
        codes = {c: int((((ord(c) * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 40) % 255 + 1) for c in set(want)}
        assert got.tolist() == [codes[c] for c in want]
    for cut in {0, min(1, len(text)), len(text) // 2}:
        assert np.array_equal(np.concatenate([steps[:cut], ee.walk(text[cut:], int(steps[cut - 1]) if cut else 0)]), steps)


def test_likeness_follows_edits():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("etaoin shrdlu"), 6000))
    other = "".join(rng.choice(list("etaoin shrdlu"), 6000))
    few, many = list(text), list(text)
    for i in rng.integers(0, 6000, 3):
        few.insert(int(i), "x")
    for i in rng.integers(0, 6000, 100):
        many[int(i)] = "#"
    like = lambda a, b: (ee.samples(a, ee.walk(a)) == ee.samples(b, ee.walk(b))).mean()
    assert like(text, "".join(few)) > 0.8 > like(text, "".join(many)) > like(text, other) + 0.1


def docs_of():
    rng = np.random.default_rng(1)
    words = ["alpha", "béta", "gamma", "delta", "\n", "12"]
    rows = [(int(i) * 3, " ".join(rng.choice(words, int(rng.integers(0, 120))))) for i in rng.permutation(200)]
    many = [(2000, f"one id {k % 40}") for k in range(400)] + [(None, f"none {k % 9}") for k in range(90)]
    return rows + many + [(1000, None), (1001, ""), (1002, "ab"), (1003, "x" * 200_000), (7, "dup"), (7, "dup"), (None, "no id")]


def test_query(spark, tmp_path):
    rows = docs_of()
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, id string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op7_edit_embedding(spark, str(tmp_path)).collect()), key=str)
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).digest()))
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        fp, fe, fn = (ee.samples(x, ee.walk(x)) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.tobytes().hex(), fe.tobytes().hex(), float((fp == fe).mean()), float((fp == fn).mean())))
    assert got == sorted(want, key=str)


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(20):
        text = "".join(rng.choice(list("etaoin shrdlu"), 3000))
        rows += [(10 * k, text), (10 * k + 1, text[:1500] + "!" + text[1500:]), (10 * k + 2, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2048, 10):
        got = {r.doc_id: r.component_id for r in ee.near_duplicates(df, block=block).collect()}
        assert sum(got[i] == i // 10 * 10 for i in got) >= 57
    assert ee.near_duplicates(df.limit(0)).count() == 0


def slow_near(rows, least=0.8):
    """The smallest id (nulls last) of each row's component, over all pairs of fingerprints."""
    fps = [ee.samples(t or "", ee.walk(t or "")) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a == fps[j]).mean() >= least:
                root[find(i)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return [(i, fp.tobytes().hex(), ids.get(find(k))) for k, ((i, _), fp) in enumerate(zip(rows, fps))]


def test_rows_without_an_id_link_and_ids_may_be_strings(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(12):
        text = "".join(rng.choice(list("etaoin shrdlu"), 2000))
        rows += [(None if k % 3 == 0 else f"{k:02d}", text), (None, text[:1000] + "?" + text[1000:]), (f"{k:02d}z" if k % 2 else None, text[:1990]), (f"{k % 4:02d}", text + "!")]
    rows += [(None, None), (None, ""), ("zz", "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id string, text string, fingerprint string, first_id int")
    for block in (2048, 3):
        assert sorted(map(tuple, ee.near_duplicates(df, block=block).collect()), key=str) == sorted(slow_near(rows), key=str)


def test_given_documents_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.edit_duplicates(spark, sf).collect())) == sorted(slow_near(rows))


def test_empty(spark):
    assert ee.against_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
