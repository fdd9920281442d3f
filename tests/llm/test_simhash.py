import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from countspark.llm import shingles, simhash


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs):
    root = {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in pairs:
        for j, b in pairs:
            if i < j and (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in pairs}


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aAbB \t\né\x0b ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = np.array([x ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for x in base[:150] for a, b in rng.integers(0, 64, (4, 2))])
    fps = np.unique(np.concatenate([base, near]))
    order = sorted(range(len(fps)), key=lambda i: int(fps[i]))
    fps = fps[order]
    q, row = simhash.GrayIndex(fps).within(fps, 4)
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    assert set(zip(q.tolist(), row.tolist())) == want


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        words = list(rng.choice(vocab, 150))
        texts.append(" ".join(words))
        for _ in range(3):
            words[int(rng.integers(150))] = "changed"
            texts.append(" ".join(words))
    texts += [None, "", " \n", "one", "One", "a b c", "x" * 50000, texts[0], texts[0]]
    rows = [(1000 - i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [(i, slow_fingerprint(t)) for i, t, _ in rows]
    roots = slow_components(fps)
    assert got == {i: (f"{fp:016x}", roots[i]) for i, fp in fps}
    kept = simhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(roots.values()))


def test_blocks_lose_no_link(spark):
    rng = np.random.default_rng(3)
    fps = {0}
    while len(fps) < 300:
        x = 0
        for b in rng.integers(0, 64, int(rng.integers(1, 6))):
            x ^= 1 << int(b)
        fps.add(x)
    signed = {x: int(np.uint64(x).view(np.int64)) for x in fps}
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), 4, block=20)
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    want = slow_components(list(enumerate(sorted(fps))))
    groups = {}
    for i, x in enumerate(sorted(fps)):
        groups.setdefault(want[i], set()).add(got.get(signed[x], signed[x]))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_tables_lose_no_pair_and_grow():
    rng = np.random.default_rng(5)
    for n, least in ((10, 5), (10**8, 15), (10**12, 35), (10**15, 35)):
        masks = simhash.tables(n, 4)
        assert len(masks) == least
        for _ in range(500):
            x = sum(1 << int(b) for b in set(rng.integers(0, 64, 4)))
            assert any(not x & m for m in masks)


def test_nulls_link_and_ids_may_be_strings(spark, monkeypatch):
    codes = {"a": 0, "b": 0b111, "c": 0b111 ^ 0b1111 << 20, "d": 0xFFFF << 30}  # a-b 3 apart, b-c 4, a-c 7
    df = spark.createDataFrame([("1", "a"), (None, "b"), ("3", "c"), ("9", "d")], "doc_id string, text string")
    of = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select(F.col("doc_id").alias("id"), of[F.col("text")].cast("long").alias("fp")))
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {("1", "1"), (None, "1"), ("3", "1"), ("9", "9")}


def test_empty_nulls_and_repeats(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "zz"), (2, None)], schema)
    got = sorted(simhash.near_duplicates(df).collect(), key=str)
    assert len(got) == 5
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_one(df).collect())
    assert kept == [(False, 1), (False, 2), (True, 0)]


def test_keep_one_decides_by_row_and_group(spark):
    """Rows of one id in several groups: each group leaves one row, and no text is lost."""
    texts = {k: " ".join(f"{k}{i * 7 % 31}" for i in range(200)) for k in "ABC"}
    schema = "doc_id long, text string, n int"
    rows = [(7, "A", 1), (7, "B", 2), (1, "B", 3), (8, "C", 4), (None, "C", 5), (9, "A", 6)]
    kept = lambda rows, **how: sorted((r.n for r in simhash.keep_one(spark.createDataFrame([(i, texts.get(t, t), n) for i, t, n in rows], schema), **how).collect()))
    for how in ({}, {"find": shingles.near_duplicates}):
        assert kept(rows, **how) == [1, 3, 4]
        assert kept([(7, "A", 1), (7, "B", 2)], **how) == [1, 2]
        assert kept([(None, "A", 1), (None, "A", 2), (None, "B", 3)], **how) in ([1, 3], [2, 3])
        assert kept([(5, None, 1), (5, "", 2), (6, "", 3)], **how) in ([1], [2])
        assert kept([(3, "C", 9)] * 4 + [(4, "C", 1)], **how) == [9]
