"""Batch ingest with a ledger, appends that continue ids, ordered loads, a user's scorer, tables of metrics."""

import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from countspark.functions.scorers import score_batches
from countspark.operators import report
from countspark.sources import datagen, records, scratch
from countspark.streaming import counts as streams
from countspark.streaming import ingest

SCHEMA = "id long, v string"


@pytest.fixture
def folder(spark, tmp_path):
    for k in range(5):
        spark.range(k * 10, k * 10 + 10).selectExpr("id", "concat('v', id) as v").coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    return tmp_path


def taken(spark, at, at_once=1, **how):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = ingest.files(spark, f"{at}/in/*", schema, "parquet", at_once)
    ingest.ingest(stream, f"{at}/rows", f"{at}/ledger", f"{at}/checkpoint", **how)
    return ingest.complete(spark, f"{at}/rows", f"{at}/ledger", schema)


def test_a_stopped_batch_is_done_again(spark, folder):
    def stop(batch):
        if batch == 2:
            raise RuntimeError("stopped between a batch's rows and its ledger")

    with pytest.raises(Exception, match="stopped between"):
        taken(spark, folder, before_done=stop)
    states = {(r.batch, r.state) for r in ingest.progress(spark, f"{folder}/ledger").collect()}
    assert states == {(0, "done"), (1, "done"), (2, "started")}
    schema = spark.createDataFrame([], SCHEMA).schema
    assert ingest.complete(spark, f"{folder}/rows", f"{folder}/ledger", schema).count() == 20  # the third batch's rows are there, but not whole
    rows = taken(spark, folder)
    assert sorted(r.id for r in rows.collect()) == list(range(50))
    done = ingest.progress(spark, f"{folder}/ledger").collect()
    assert {r.state for r in done} == {"done"} and len({r.file for r in done}) == 5 and sorted(r.batch for r in done) == list(range(5)) and {r.n for r in done} == {10}
    spark.range(100, 103).selectExpr("id", "'x' as v").coalesce(1).write.parquet(f"{folder}/in/f9")
    assert taken(spark, folder, prepare=lambda df: df.filter("id > 100")).count() == 52  # only the new file, and of it what prepare() leaves
    assert taken(spark, folder).count() == 52


def test_one_run_at_a_time(spark, folder):
    assert scratch.exclusive(spark, f"{folder}/ledger/_lock", "other")
    with pytest.raises(RuntimeError, match="another run"):
        taken(spark, folder)
    ingest.break_lock(spark, f"{folder}/ledger")
    assert taken(spark, folder, at_once=3).count() == 50


def test_ids_are_claimed_once(spark, tmp_path):
    path, got = f"{tmp_path}/store", []
    starts = threading.Barrier(6)

    def claim(n):
        starts.wait()
        first = records.claim_ids(spark, path, n, 0)
        got.append((first, first + n - 1))

    threads = [threading.Thread(target=claim, args=(n,)) for n in (1, 2, 3, 4, 5, 6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    ids = sorted(i for a, b in got for i in range(a, b + 1))
    assert ids == list(range(1, 22))
    scratch.exclusive(spark, f"{path}/_ids/{7:012d}", "")  # begun and never finished
    with pytest.raises(RuntimeError, match="never finished"):
        records.claim_ids(spark, path, 1, 0, patience=0.3)


def test_appends_continue_and_survive_other_partitions(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = datagen.fraud(spark, 90).repartition(7)
    spans = [records.append(rows, path, "report_id"), records.append(rows.limit(0), path, "report_id"), records.append(rows.coalesce(2), path, "report_id")]
    assert spans == [(1, 90), (91, 90), (91, 180)]
    stored = spark.read.parquet(path)
    assert sorted(int(r.report_id) for r in stored.collect()) == list(range(1, 181))
    assert stored.columns == rows.columns
    bare = spark.range(5).select(F.col("id").alias("x"))
    assert records.append(bare, f"{tmp_path}/bare", "rid") == (1, 5) and spark.read.parquet(f"{tmp_path}/bare").columns == ["rid", "x"]


def test_loads(spark):
    df = spark.createDataFrame([("10", "60", 1), ("9", "40", 2), ("x", "50", 3), ("2", "0", 4), (None, "1", 5)], "report_id string, risk_level string, n int").repartition(3)
    got = records.in_order(df, "report_id", whole=["risk_level"]).orderBy("place").collect()
    assert [r.n for r in got] == [4, 2, 1, 5, 3] and [r.place for r in got] == [1, 2, 3, 4, 5]
    assert [r.is_high_risk for r in got] == [0, 0, 1, 0, 1]
    with pytest.raises(ValueError, match="is_fraud"):
        records.load_labelled(df)
    assert records.load_labelled(df.withColumn("is_fraud", F.lit(1))).columns == ["risk_level", "n", "is_fraud"]


def test_users_scorer(spark):
    df = spark.range(0, 25_000).selectExpr("id", "cast(id % 7 as double) as a", "'s' as b", "array(id) as c", "0.0 as risk").repartition(3)
    got = score_batches(df, lambda t: t.a * 2 + (t.b == "s"), ["a", "b"])
    assert got.columns == ["id", "a", "b", "c", "risk"] and got.filter("risk <> a * 2 + 1").count() == 0 and got.count() == 25_000
    with pytest.raises(Exception, match="gave 1 numbers"):
        score_batches(df, lambda t: pd.Series([1.0]), ["a"]).collect()
    assert score_batches(df.limit(0), lambda t: t.a, ["a"], to="z").count() == 0


def test_tables_of_metrics(spark):
    rows = spark.createDataFrame([("b", 0.5, 0.9), ("a", 0.7, 0.9), ("c", 0.1, 0.2)], "model string, f1 double, acc double")
    got = {r.metric: r for r in report.side_by_side(rows, ["f1", "acc"], first="b").collect()}
    assert (got["f1"].b, got["f1"].a, got["f1"].c, got["f1"].best) == (0.5, 0.7, 0.1, "a") and got["f1"].delta == pytest.approx(0.4)
    assert got["acc"].best == "a,b" and got["acc"].delta == pytest.approx(0.7)
    one = report.side_by_side(rows.filter("model = 'a'"), ["f1"]).first()
    assert (one.a, one.delta, one.best) == (0.7, 0.0, "a")
    df = spark.createDataFrame([(1, "x", "p"), (0, "y", "p"), (1, "x", "q")], "y int, f string, g string")
    got = report.training_summary({"train": df, "none": df.limit(0)}, ["f", "g"]).collect()
    assert tuple(got[0]) == ("train", 3, 2, pytest.approx(2 / 3), 2, 4) and got[1].share_pos is None


def test_streams_settle_into_files(spark, tmp_path):
    spark.range(50).selectExpr("id % 4 as k").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").groupBy("k").agg(F.count("*").alias("n"))
    for _ in range(2):  # again with the same checkpoint
        got = {r.k: r.n for r in streams.settle(stream, f"{tmp_path}/out", f"{tmp_path}/cp").collect()}
        assert got == {0: 13, 1: 13, 2: 12, 3: 12}


def test_generated_records_repeat_in_sql(spark):
    import duckdb

    df = datagen.fraud(spark, 3000, seed=7, noisy=True).drop("reported_iban")
    want = duckdb.sql(datagen.fraud_sql("SELECT range AS id FROM range(1, 3001)", seed=7, noisy=True)).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    share = spark.range(20_000).filter(datagen.picked(["id"], 0.05, "x")).count() / 20_000
    assert share == pytest.approx(0.05, abs=0.006)
