"""Importance resampling: documents drawn by how much more likely their hashed word runs are in a target set than in the corpus.

Every document becomes one array of buckets, made by higher-order functions from its words: no row is exploded to be scored. The
corpus and the target give one count a bucket, by partial sums, and only these totals shuffle. Their log ratios are a literal
array of as many numbers as buckets, over which each document's array is summed by element_at. Drawing adds Gumbel noise from a
hash of the id and takes the highest scores, ranked by ranges, so that no task sees more than a slice of the ids and scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countspark.llm.common import materialise

BUCKETS = 10_000
LEAST_WORDS = 20  # of a document that may be drawn
PERCENT = 25  # of these that are drawn
SEED = "7"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The runs of digits, ASCII letters in lower case and characters beyond ASCII; none in a null text."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def buckets(said: Column) -> Column:
    """The bucket of each word and of each pair of neighbours, joined by a space."""
    pairs = F.zip_with(said, F.slice(said, 2, F.greatest(F.size(said), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    once = F.when(F.size(said) > 1, F.slice(pairs, 1, F.size(said) - 1)).otherwise(F.array().cast("array<string>"))
    return F.transform(F.concat(said, once), lambda x: (F.crc32(x.cast("binary")) % BUCKETS).cast("short"))


def totals(hashed: DataFrame) -> dict[int, int]:
    """How often each bucket occurs: at most BUCKETS numbers, on the driver."""
    return {r["bucket"]: r["count"] for r in hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect()}


def gains(corpus: dict[int, int], target: dict[int, int]) -> list[int]:
    """For each bucket, the thousandfold log ratio of its smoothed shares in the target and the corpus, rounded down."""
    s_all, t_all = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(BUCKETS)]


def weight(hashed: Column, gain: list[int]) -> Column:
    """The mean gain of a document's buckets, rounded down; 0 without any."""
    table = F.expr(f"cast(split('{','.join(map(str, gain))}', ',') as array<bigint>)")  # folded into one literal
    n = F.size(hashed).cast("long")
    total = F.aggregate(hashed, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b.cast("int") + 1))
    return F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def noise(row_id: Column, seed: str = SEED) -> Column:
    """A thousandfold draw from the Gumbel distribution, rounded down, from the id alone; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], to: str) -> DataFrame:
    """The rows with their place, from 1, in an order over all of them: sorted ranges, each numbered from where the ranges before it end."""
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}  # one number a partition
    before, so_far = {}, 0
    for part in sorted(sizes):
        before[part], so_far = so_far, so_far + sizes[part]
    numbered = dealt.withColumn(to, F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long"))
    if before:
        numbered = numbered.withColumn(to, F.col(to) + F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])[F.col("_part").cast("long")])
    return numbered.drop("_part")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED
) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of docs: rank 1, 2, ... for those drawn, in the order of the draw, null for all others.

    Of the documents with so many words at least, the given percentage with the highest scores is drawn; ties go to smaller ids, and
    null ids come last; rows that share an id share its noise and are drawn each for itself. Null and empty texts have no feature and
    weight 0. Very long texts are one array each. An empty target or table is smoothed like any other. Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("said"))
    hashed = materialise(rows.select("id", F.size("said").alias("n_words"), buckets(F.col("said")).alias("buckets")))
    wanted = target.select(buckets(words(F.col(target_col))).alias("buckets"))
    gain = gains(totals(hashed), totals(wanted))
    scored = hashed.select("id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight(F.col("buckets"), gain).alias("weight"))
    scored = materialise(scored.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    enough = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    placed = ranked(enough, [F.col("score").desc(), F.col("id").asc_nulls_last()], "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
