import hashlib
import re
from collections import Counter

from countspark.llm import fim, queries
from tests.oracle import connect, rows as rows_of

SF = "/root/testdata/sf0.01"


def plain(row_id, text):
    """The contract's words, one row at a time."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if row_id is None else row_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return row_id, len(tokens), "plain", None, None, text
    lo, hi = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return row_id, len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_against_sql(spark):
    want = connect(SF).sql(queries.OP12_SQL).df()  # pandas has other kinds for numbers with nulls
    assert rows_of(queries.op12_fim(spark, SF).toPandas()) == rows_of(want)


def test_odd_rows_against_plain(spark, tmp_path):
    texts = [None, "", "a", "ab", " ", "\n\r\n", "a b", "é", "日本 語x", "😀a😀", "<P>", "x<S>y", "a<M", "<", "<P", "KK", "AZaz[`@{", "\x00a\x00", "word " * 60_000, "z" * 300_000]
    rows = [(i, t, "clash", 1) for i in range(0, 400, 7) for t in texts[: 18 if i else None]] + [(None, t, "", 2) for t in texts[:6]] + [(3, "same rows", "", 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    got = fim.restore(fim.transform(docs))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    found = got.collect()
    assert Counter(tuple(r[:6]) for r in found) == Counter(plain(i, t) for i, t, *_ in rows)
    assert Counter(r.restored for r in found) == Counter(t or "" for _, t, *_ in rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((*plain(i, t)[:5], sha(plain(i, t)[5]), sha(t or "")) for i, t, *_ in rows)
    assert Counter(map(tuple, queries.op12_fim(spark, str(tmp_path)).collect())) == want


def test_forms_restore_near_marks():
    for text in ("<", "<P", "P>", "a<", "<<<S", "S><M", "<M <P <S >"):
        for i in range(60):
            _, form, _, _, output = fim.rearranged(text, i)
            assert fim.restored(output, form) == text


def test_empty_table_and_string_ids(spark):
    assert fim.restore(fim.transform(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    got = fim.transform(spark.createDataFrame([("x1", "one two")], "k string, t string"), "k", "t").collect()[0]
    assert tuple(got) == plain("x1", "one two")
    assert fim.restore(spark.createDataFrame([(None, "psm"), ("a", None)], "output string, form string")).filter("restored is null").count() == 2
