import numpy as np
import pytest

import corpus_pipeline
from countspark.llm import shingles

SF = "/root/testdata/sf0.001"


def slow_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(rows):
    """The smallest id that links of all pairs lead to."""
    root, sets = {i: i for i, _ in rows}, [(i, slow_shingles(t)) for i, t in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or len(a & b) / len(a | b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[int(at)] = f"new{rng.integers(1 << 40)}"
    return " ".join(words)


def test_pipeline_drops_near_copies_at_08(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 5000, 250)]
        rows += [" ".join(base), edited(rng, base, 3), edited(rng, base, 5), edited(rng, base, 12)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.without_copies(spark, docs, SF).collect()}
    assert got == set(slow_components(rows).values())


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()}
    assert got == slow_components(rows)


def exact_components(rows):
    """The smallest id that links lead to, over all pairs whose sets can be alike: those that share one of their first shingles in one order, whatever it is."""
    root, sets, places = {i: i for i, _ in rows}, [(i, slow_shingles(t)) for i, t in rows], {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for k, (i, a) in enumerate(sets):
        seen = set()
        for s in [()] if not a else sorted(a, key=hash)[: len(a) // 5 + 1]:
            for j in places.setdefault(s, []):
                if j not in seen:
                    seen.add(j)
                    b = sets[j][1]
                    if a == b or len(a) * 5 >= len(b) * 4 and len(b) * 5 >= len(a) * 4 and 5 * len(a & b) >= 4 * len(a | b):
                        links += a != b
                        x, y = sorted((find(i), find(sets[j][0])))
                        root[y] = x
            places[s].append(k)
    return {i: find(i) for i, _ in rows}, links


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 5), ("sf0.1", 48)])
def test_recall_on_the_given_tables(spark, sf, least):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want, links = exact_components([(r.doc_id, r.text) for r in docs.collect()])
    assert links >= least
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == want


def test_recall_just_above_the_bound_and_exact(spark):
    rng, rows = np.random.default_rng(12), []
    while len(rows) < 800:
        base = [f"w{x}" for x in rng.integers(0, 9000, int(rng.integers(60, 400)))]
        pair = [" ".join(base), edited(rng, base, max(1, round(len(base) * rng.uniform(0.015, 0.03))))]
        a, b = map(slow_shingles, pair)
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            rows += pair
    rows += [None, "", "one two", "one  TWO", "a b c d e f", "a b c d e f", "long " * 60_000, *rows[:6]]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, same string, band int").repartition(5)
    want, links = exact_components(rows)
    assert links >= 400
    for exact in (False, True):
        assert {r.doc_id: r.component_id for r in shingles.near_duplicates(df, exact=exact).collect()} == want
        assert shingles.near_duplicates(df.limit(0), exact=exact).count() == 0


def test_exact_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, _ = exact_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs, stars=0, exact=True).collect()} == want


def test_chains_and_large_groups(spark):
    rng = np.random.default_rng(6)
    words, rows = [f"w{x}" for x in range(300)], []
    for i in range(60):  # each only like the few before and after it
        words[i * 5] = f"changed{i}"
        rows.append(" ".join(words))
    base = [f"v{x}" for x in range(200)]
    rows += [edited(rng, base, int(rng.integers(0, 6))) for _ in range(120)]
    rows += [None, "", " \n", "one", "One", "a b c d", "a b c d e", "x " * 500, "x x x x x x"]
    rows = [(1000 - i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = slow_components(rows)
    for stars in (0, 2):
        assert {r.doc_id: r.component_id for r in shingles.near_duplicates(df, stars=stars).collect()} == want


def test_rows_without_an_id_and_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (None, "zz"), (2, None)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in shingles.near_duplicates(df).collect()]
    assert sorted(got, key=str) == [(1, 1), (1, 1), (2, 2), (None, 1), (None, None)]


def test_rows_without_an_id_link_and_ids_may_be_strings_or_repeat(spark):
    words = [f"w{x}" for x in range(200)]
    texts = [" ".join(words), " ".join([*words[:190], *"abcdefghij"]), " ".join([*words[24:190], *"abcdefghij"])]
    ends = [slow_shingles(t) for t in texts]
    assert len(ends[0] & ends[2]) < 0.8 * len(ends[0] | ends[2])
    rows = [("1", texts[0]), (None, texts[1]), ("3", texts[2]), ("9", "other"), ("9", texts[0])]
    got = sorted(map(tuple, shingles.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()), key=str)
    assert got == sorted([("1", "1"), (None, "1"), ("3", "1"), ("9", "9"), ("9", "1")], key=str)


def test_blocks_lose_no_pair(spark):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in range(120)]
    texts = [edited(rng, base, int(rng.integers(0, 4))) for _ in range(150)]
    rows = [(i, bytes([i]), t) for i, t in enumerate(texts)]
    texts_df = spark.createDataFrame(rows, "id long, same binary, text string")
    first = shingles._signed(texts_df)
    members = first.selectExpr("same", "n", "bands", "fp", "sketch", "same as component", "posexplode(bands) as (band, key)").select(shingles._names(shingles._MEMBER))
    hopeful = shingles._hopeful(members, block=20)
    edges = shingles._alike(hopeful, texts_df.select("same", "text"), block=20)
    got = {r.node: r.component for r in shingles.components(edges).collect()}
    want = slow_components(list(enumerate(texts)))
    assert len(set(want.values())) < 150
    assert {i: got.get(bytes([i]), bytes([i])) for i in want} == {i: bytes([r]) for i, r in want.items()}


def test_simhash_links_without_any_band(spark, monkeypatch):
    """Operator 8's index is a step of its own: near copies are found where no min-hash band agrees, and SimHashes alone link nothing."""
    rng = np.random.default_rng(14)
    rows = []
    for _ in range(20):
        base = [f"w{x}" for x in rng.integers(0, 9000, 400)]
        rows += [" ".join(base), edited(rng, base, 1)]
    fps = [shingles.majority(shingles.shingles(t.encode())) for t in rows]
    near = [(fps[i] ^ fps[i + 1]).bit_count() <= 4 for i in range(0, len(rows), 2)]
    assert sum(near) >= 5
    signed = shingles._signed
    monkeypatch.setattr(shingles, "_signed", lambda docs, exact=False: signed(docs, exact).selectExpr("id", "same", "n", "transform(bands, x -> xxhash64(x, same)) as bands", "fp", "sketch"))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(df).collect()}
    assert got == {i: i - (i % 2 and near[i // 2]) for i in range(len(rows))}
