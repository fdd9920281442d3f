import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from countspark.llm import pii, queries, toxicity
from tests.llm.test_shingles import slow_components

SF = "/root/testdata/sf0.001"


def test_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    hits = toxicity._Hits(model.index)
    rows = {i: t for i, t in rows.items() if model.over(np.array([toxicity._score(model, hits, t)]))[0, 0] < model.cut}
    roots = slow_components(list(rows.items()))
    rows = {i: t for i, t in rows.items() if roots[i] == i}
    field = pii.fit(docs.filter(docs.doc_id.isin(list(rows))))
    rows = {i: pii.redacted(t, pii.find([t], field)[0][1]) for i, t in rows.items()}
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = queries.queries()["pipeline"](spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_keep_the_columns(spark):
    rows = [(1, "an idiot", "en", "s", 8), (1, "an idiot", "en", "s", 8), (None, None, None, None, None), (2, "", "x", "y", 0), (3, "mail a.b@c.de", "en", "s", 13), (4, "long " * 200_000, "en", "s", 10**6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            given = stage(spark, given, SF)
            assert given.columns == docs.columns
        assert corpus_pipeline.packed(spark, given, SF).columns[0] == "doc_id"


def test_extra_columns_with_clashing_names(spark):
    rows = [(k, f"text number {k} of all", "en", "s", 5, k, "x", b"y", 1.0) for k in range(6)] + [(6, "text number 5 of all", "en", "s", 5, 6, "x", b"y", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, component_id string, same binary, length double")
    given = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, given, SF)
        assert given.columns == docs.columns
    assert sorted(r.doc_id for r in given.collect()) == list(range(6))
    assert corpus_pipeline.packed(spark, given, SF).count() == 6


def test_rows_of_one_id_in_several_groups(spark):
    """No document of its own is lost, and no copy stays, whatever the ids are."""
    texts = {k: " ".join(f"{k}{i}" for i in range(80)) for k in "abc"}
    rows = [(7, "a"), (7, "b"), (1, "b"), (8, "c"), (None, "c"), (9, "a")]
    docs = spark.createDataFrame([(i, texts[t], "en", "s", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.n_chars for r in corpus_pipeline.without_copies(spark, docs, SF).collect()) == [0, 2, 3]
