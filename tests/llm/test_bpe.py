import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from countspark.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(text):
    pieces, packed = bpe._encoder(PATH, P.PATTERN)
    return np.frombuffer(b"".join(map(packed.__getitem__, pieces(text))), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abehinorst  '\n0\x1c\xa0", max_size=80), st.text(alphabet="a -=", max_size=200)))
def test_as_tiktoken(theirs, text):
    assert ours(text) == theirs.encode_ordinary(text)


def test_all_tokens_and_odd_texts(theirs):
    texts = [t.decode("utf8", "ignore") for t in list(theirs._mergeable_ranks)[::7]]
    texts += ["x" * 3000, " " * 999 + "x", "=-" * 700, "日本語テキスト" * 50, "\U0001f600" * 99, "<|endoftext|>", "don't've 's", "²½Ⅷ́é İıΣς"]
    for t in texts:
        assert ours(t) == theirs.encode_ordinary(t)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abethinor", max_size=60), st.text(alphabet="abethinor", max_size=10), st.integers(0, 60), st.integers(0, 8))
def test_appends_and_edits(text, new, at, n):
    vocabulary = bpe.load(PATH)
    table = bpe.PieceTable(vocabulary)
    for c in text:
        table.append(c.encode())
    assert table.ids() == vocabulary.encode(text.encode()) if text else table.ids() == []
    at = min(at, len(text))
    table.edit(at, min(len(text), at + n), new.encode())
    changed = text[:at] + new + text[at + n :]
    assert table.text == changed.encode()
    assert table.ids() == (vocabulary.encode(table.text) if changed else [])


def test_edits_stay_local():
    vocabulary = bpe.load(PATH)
    text = b"abethinorther" * 400
    table = bpe.PieceTable(vocabulary, text)
    before = table.computed
    table.edit(100, 101, b"zz")
    assert table.computed - before < 400
    assert table.ids() == vocabulary.encode(text[:100] + b"zz" + text[101:])


def test_query(spark, tmp_path, theirs):
    rows = [(1, "The thing, isn't it?\n\n 12345"), (2, None), (3, ""), (4, "é " * 9000), (4, "é " * 9000), (None, "z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, str(tmp_path)).collect())
    want = []
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_very_long_texts(spark, tmp_path, theirs):
    texts = ["word and more " * 40_000, "x" * 200_000, " " * 100_000, "é日本 " * 30_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in queries.op1_bpe(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        assert got[i][1] == hashlib.sha256(t.encode()).hexdigest()
        if i != 1:  # one match of 200,000 equal letters is quadratic in the other library
            assert got[i][0] == len(theirs.encode_ordinary(t))


def test_empty_table_and_clashing_columns(spark, tmp_path):
    from countspark.llm import queries

    rows = [(1, "a b", "clash", 7), (1, "a b", "clash", 7), (2, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    for name, given in (("some", df), ("none", df.limit(0))):
        given.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = [(r.doc_id, r.n_tokens) for r in queries.op1_bpe(spark, f"{tmp_path}/{name}").collect()]
        assert sorted(got) == ([(1, 2), (1, 2), (2, 0)] if name == "some" else [])
