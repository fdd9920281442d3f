import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from countspark.llm import pii, queries

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def slow_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and slow_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((list(PATTERNS).index(kind), m.start(), m.end()))
    return out


PART = st.sampled_from(["a.b@c.de", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (269) 555-3296", "+", ".", " ", "-", "x", "9", "0", "é", "@a.b", "%", "(", "00001.2.3.4", "\n"])


@settings(max_examples=1000, deadline=None)
@given(st.lists(PART, max_size=12).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == slow_spans(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "a" * 300_000 + "@", "9" * 200_000, "1." * 100_000, "+" * 100_000, "+1" + " " * 200_000, "a@" * 50_000, "0" * 100_000 + ".1.2.3", "1.2." + "0" * 100_000 + "7.9"):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def enumerated(nodes, field):
    """The labels' probabilities, by summing over all labellings."""
    own = nodes.shape.astype(float) @ field.shape
    total = np.zeros(own.shape)
    for ys in itertools.product(range(pii.LABELS), repeat=len(own)):
        p = sum(own[i, y] for i, y in enumerate(ys))
        p += sum(field.chain[ys[a], ys[b]] for a, b in nodes.chain) + sum(field.skip[ys[a], ys[b]] for a, b in nodes.skip)
        for i, y in enumerate(ys):
            total[i, y] += np.exp(p)
    return total / total.sum(1, keepdims=True)


# No loops, so messages are exact: chains, stars of likes, and both.
TREES = [
    "x 12 34.5.6.7 99 y",
    "+1 (269) 555-3296 x 17 x 2695553296 x 12695553296",
    "+12695553296 x 12695553296 or 1-269-555-3296 or 1.269.555.3296",
    "a.b@c.de x A.B@C.DE x a.b@c x 4111111111111111 x 4111-1111-1111-1111",
]


@pytest.mark.parametrize("text", TREES)
def test_messages_and_added_spans_against_enumeration(field, text):
    nodes = pii.nodes_of([text])
    want = enumerated(nodes, field)
    assert np.allclose(field.beliefs(nodes), want, atol=2e-3)
    base, every = pii.find([text], field)[0]
    free = [i for i in range(len(want)) if not any(s < nodes.end[i] and nodes.start[i] < e for _, s, e in base)]
    sure = {c for i in free if want[i, :-1].max() >= pii.BELIEF for c in range(nodes.start[i], nodes.end[i])}
    added = {c for x in every if x not in base for c in range(x[1], x[2])}
    assert sure <= added and not [c for c in added - sure if text[c] != " "]


def test_loops_come_close(field):
    text = "+12695553296 17 x 12695553296 17 x 1-269-555-3296 17"
    nodes = pii.nodes_of([text])
    assert len(nodes.chain) and len(nodes.skip) > len(nodes.chain)
    got, want = field.beliefs(nodes), enumerated(nodes, field)
    assert (got.argmax(1) == want.argmax(1)).all()


def test_a_text_does_not_depend_on_its_batch():
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(pii.LABELS,) * 2), rng.normal(size=(pii.LABELS,) * 2))
    texts = [" ".join(rng.choice(["12", "345678", "3.4.5.6", "a@b.c", "+1", "345-678", "word"], 30)) for _ in range(60)]
    whole = field.beliefs(pii.nodes_of(texts))
    apart = np.concatenate([field.beliefs(pii.nodes_of([t])) for t in texts])
    assert np.array_equal(whole, apart)


def test_many_spans_in_one_text(field):
    text = " ".join(f"{i % 251}.{i % 83}.7.{i % 97}" for i in range(100_000))
    start = time.time()
    base, every = pii.find([text], field)[0]
    assert len(base) == 100_000 and set(base) <= set(every)
    assert time.time() - start < 120


def test_fit_is_bounded_by_texts(spark):
    rows = [(1, "call +1 (269) 555-3296 now")] * 500 + [(1, f"call {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert np.isfinite(pii.fit(df, sample=20).shape).all()


def test_skip_edges_carry_labels(field):
    text = "The number +1 (269) 555-3296 was called. " + "word " * 300 + "Again: (269) 555-3296 or 2695553296 it was, not 17 or 2024."
    base, every = pii.find([text], field)[0]
    assert base == slow_spans(text)
    added = [text[s:e] for k, s, e in every if (k, s, e) not in base]
    assert "(269) 555-3296" in added
    assert not {"17", "2024"} & set(added)


def test_clean_documents_stay(spark, field):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = pii.spans(docs, field).toPandas()
    extra = found[(found.base.map(len) == 0) & (found.spans.map(len) > 0)]
    assert len(extra) <= 0.002 * len(found)


def test_query_and_redaction(spark, tmp_path, field):
    rows = [(1, "mail a.b@c.de now", 17), (2, None, 0), (3, "", 0), (4, "x" * 200_000 + " 1.2.3.4", 200_008), (4, "é +1 (269) 555-3296", 19), (None, "4111 1111 1111 1111", 19)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    df.withColumn("spans", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_phone): r for r in queries.op10_pii(spark, str(tmp_path)).collect()}
    assert len(got) == 6
    assert (got[1, 0].n_email, got[4, 0].n_ip, got[4, 1].n_phone, got[None, 0].n_card) == (1, 1, 1, 1)
    assert got[1, 0].spans.startswith("email:5:13") and got[2, 0].spans == ""
    import hashlib

    assert got[4, 1].base_sha256 == hashlib.sha256(b"phone:2:19").hexdigest()
    red = {(r.doc_id, r.n_chars): r.text for r in pii.redact(df, field).collect()}
    assert red[1, 16] == "mail <EMAIL> now" and red[2, 0] is None and red[3, 0] == ""
    assert pii.redact(df.limit(0), pii.fit(df.limit(0))).count() == 0
    assert pii.redacted("abcdef", [(0, 1, 3), (1, 2, 4)]) == "a<EMAIL>ef"
