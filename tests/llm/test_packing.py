import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from countspark.llm import packing, queries

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


TEXTS = ["The Thing's here; don't 123 42!", "É ß ñ ü <|endoftext|> x", "ΑΣ ΣΑΣ. İıſ", "²½Ⅷ́é é", "日本語 text", "_a_b__", "\x1c\x85\xa0¿¡«»º", "x" * 5000, "a<|b"]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abE's 'te1!_é\n", max_size=60)))
def test_ids_as_tokenizers(theirs, text):
    got = np.frombuffer(packing._tokenizer(PATH).ids(text), "<u4").tolist()
    assert got == theirs.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts(theirs):
    for text in TEXTS:
        assert np.frombuffer(packing._tokenizer(PATH).ids(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TEXTS), st.text(max_size=30), st.text(alphabet="abE's 'te1!_é\n\t\r\x0b", max_size=30)), max_size=12), st.integers(1, 80), st.integers(1, 40))
def test_ids_of_many_texts(theirs, texts, chars, ids):
    """Whatever texts are looked up together."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "CHARS", chars)
        m.setattr(packing, "IDS", ids)
        got = [x for a in packing._tokenizer(PATH).of(texts, b"\7\0\0\0") for x in a.to_pylist()]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*theirs.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def test_a_word_is_split_once(monkeypatch):
    split, seen = packing.word_bpe_pieces, []
    monkeypatch.setattr(packing, "word_bpe_pieces", lambda t, *more, **how: seen.append(len(t)) or split(t, *more, **how))
    assert sum(len(a) for a in packing._WordIds(PATH).of(["alpha beta, gamma 12\n"] * 1000)) == 1000
    assert sum(seen) < 100


def bins_of(counts, capacity):
    segments, n = packing.plan(counts, capacity)
    content, seen = defaultdict(list), defaultdict(list)
    for length, first, count, at, each, offset in segments:
        for r in range(count):
            content[at + r // each].append((offset + r % each * length, length))
            seen[length].append(first + r)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(v)) for k, v in counts.items()}
    assert set(content) == set(range(n))
    for items in content.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return n, segments


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 40), max_size=24))
def test_plan_is_a_packing(counts):
    n, _ = bins_of(counts, 24)
    lower = -(-sum(k * v for k, v in counts.items()) // 24)
    above_half = sum(v for k, v in counts.items() if 2 * k > 24)
    assert max(lower, above_half) <= n <= max(lower * 11 / 9 + 4, above_half + lower)


def test_plan_stays_small():
    rng = np.random.default_rng(0)
    counts = {n: int(c) for n, c in zip(range(1, 4097), rng.integers(1, 10**9, 4096))}
    segments, _ = packing.plan(counts, 4096)
    assert len(segments) < 150_000


def test_query(spark, tmp_path, theirs):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma's", "12"], int(rng.integers(1, 3000))))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "word " * 9000), (203, "same"), (203, "same"), (None, "none")] + [(300 + i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, length string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_packing(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((str(i), k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
