import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from countspark.llm import importance, queries


def features(text):
    said = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(said), [zlib.crc32(x.encode()) % 10000 for x in said + [f"{a} {b}" for a, b in zip(said, said[1:])]]


def plain(docs, target):
    """The contract's words over lists of (id, text) and of texts."""
    corpus, wanted = Counter(), Counter()
    for _, t in docs:
        corpus.update(features(t)[1])
    for t in target:
        wanted.update(features(t)[1])
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((corpus[b] + 1) * (t + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        n, found = features(text)
        w = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    enough = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = enough[: 25 * len(enough) // 100]
    return Counter((*r[:4], k) for k, r in enumerate(drawn, 1)) + Counter((*r[:4], None) for r in enough[len(drawn) :]) + Counter((*r[:4], None) for r in rows if r[4] < 20)


def test_given_tables_against_plain(spark):
    sf = "/root/testdata/sf0.01"
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    got = queries.op13_importance(spark, sf)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert Counter(map(tuple, got.collect())) == want


def test_odd_rows_against_plain(spark):
    long = "Alpha beta, GAMMA 42 é日本 x-y_z "
    texts = [None, "", " \n", "one", "One ONE", "É é İ ß", "\x7fa\x80b", long * 4, long * 4, long * 20_000, "w " * 19, "w " * 20, *(f"{long} {k} " * 3 for k in range(40))]
    rows = [(i % 50, t, "clash", i) for i, t in enumerate(texts)] + [(60, long * 4, "", 0)] * 4 + [(None, long * 5, "", 0), (None, None, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, buckets string, rank int")
    target = spark.createDataFrame([(0, long), (1, None), (1, "beta gamma")], "item_id long, text string")
    got = importance.resample(docs, target)
    assert Counter(map(tuple, got.collect())) == plain([r[:2] for r in rows], [long, None, "beta gamma"])


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs, target).count() == 0
    some = [(i, "a b c d e f g h i j k l m n o p q r s t u") for i in range(8)]
    got = importance.resample(spark.createDataFrame(some, "doc_id long, text string"), target).collect()
    assert Counter(map(tuple, got)) == plain(some, [])


def test_ranks_over_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id % 3 as long) as score")
    got = importance.ranked(rows, [F.col("score").desc(), F.col("id").asc()], "rank").collect()
    want = sorted(((r.id, r.score) for r in got), key=lambda x: (-x[1], x[0]))
    assert [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 5001))
