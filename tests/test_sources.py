import pytest
from pyspark.sql import functions as F

from countspark.functions import clinical
from countspark.operators import report
from countspark.plans import filters
from countspark.sources import datagen, records, scan
from countspark.streaming import counts as streams


@pytest.fixture(scope="module")
def df(spark):
    rows = [("a,b", 1, 0.5), ("x:y", 2, 1.5), ("Plain", 3, None), (None, 4, 2.5)]
    return spark.createDataFrame(rows, "name string, n int, v double")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('name:"a,b"', [1]), ('name:"x:y"', [2]), ("name:plain", []), ("name:Plain", [3]), ("n:2~3", [2, 3]), ("n:>=2,n:<4", [2, 3]), (["n:>1", "v:<=1.5"], [2]),
        ("n:!=2", [1, 3, 4]), ('name:hamming("plain",1)', [3]), ('name:ngram("Plaint",0.7)', [3]), (None, [1, 2, 3, 4]), ("v:0.5", [1]), ("n:1.5~2.5", [2]),
    ],
)
def test_filters(df, text, want):
    assert sorted(r.n for r in scan.query(df, text).collect()) == want


@pytest.mark.parametrize("text", ["name", "name:", ":x", "nothing:1", "n:abc", 'name:"open', "n:1,,n:2"])
def test_malformed(df, text):
    with pytest.raises(filters.FilterError):
        scan.query(df, text)


def test_aggregates(df):
    assert scan.scalar(scan.aggregate(df, "v:avg(0~2)")) == 1.0
    assert scan.scalar(scan.aggregate(df, "v:max()", "n:<3")) == 1.5
    assert scan.scalar(scan.aggregate(df, "v:sum(8~9)")) == 0.0 and scan.aggregate(df, "v:sum(8~9)").first()[0] is None
    assert scan.scalar(scan.aggregate(df, "n:count(2~4)")) == 3
    with pytest.raises(filters.FilterError):
        scan.aggregate(df, "v:median(1~2)")


def test_pushdown(spark):
    line = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    plan = scan.query(line, "l_quantity:10~20", columns=["l_orderkey"])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_generators(spark):
    df = datagen.fraud(spark, 20000)
    assert df.schema.names == ["report_id", "reporting_bank_id", "reporting_jurisdiction", "reported_iban", "account_jurisdiction", "risk_level", "fraud_type", "year", "month", "day", "is_active"]
    assert sorted(df.collect()) == sorted(datagen.fraud(spark, 20000, partitions=3).collect())
    assert df.agg(F.avg((F.col("risk_level") >= 50).cast("double"))).first()[0] == pytest.approx(0.6534, abs=0.015)
    assert all(r.n_missing == 0 and r.n_out_of_bounds == 0 for r in records.violations(df, records.FRAUD, records.FRAUD_BOUNDS).collect())
    high = list(datagen.HIGH_TYPES)
    assert df.filter((F.col("risk_level") >= 50) != F.col("fraud_type").isin(high)).count() == 0
    noisy = datagen.fraud(spark, 500, noisy=True)
    assert noisy.filter((F.col("risk_level") >= 50) == F.col("fraud_type").isin(high)).count() == 0
    bc = datagen.screening(spark, 20000)
    assert bc.agg(F.avg("cancer_5yr")).first()[0] == pytest.approx(0.033, abs=0.01)
    assert all(r.n_missing == 0 and r.n_out_of_bounds == 0 for r in records.violations(bc, records.SCREENING, records.SCREENING_BOUNDS).collect())
    assert bc.filter(clinical.age_group(F.col("age")) != F.col("age_group")).count() == 0


def test_records_round_trip(spark, tmp_path):
    df = datagen.fraud(spark, 50)
    records.write_batches(df, f"{tmp_path}/lines", "https://example.org/fraud")
    assert sorted(records.read_lines(spark, f"{tmp_path}/lines", records.FRAUD).select(*df.columns).collect()) == sorted(df.collect())
    (tmp_path / "batch.json").write_text('[{"data": {"report_id": "1", "year": 2020}, "schema": "s"}, {"report_id": "2", "year": 2021}]')
    assert [(r.report_id, r.year) for r in records.read_batches(spark, f"{tmp_path}/batch.json", records.FRAUD).collect()] == [("1", 2020), ("2", 2021)]
    for _ in range(2):
        records.append(datagen.fraud(spark, 30), f"{tmp_path}/store", "report_id")
    ids = sorted(int(r.report_id) for r in spark.read.parquet(f"{tmp_path}/store").collect())
    assert ids == list(range(1, 61))


def test_species(spark):
    got = records.species_table(spark.createDataFrame([(1.0, 2.0, "b"), (3.0, 4.0, "a")], "`sepal-length` double, petal_width double, species string")).collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0, 1), (3.0, 4.0, 0)]
    with pytest.raises(ValueError):
        records.species_table(spark.range(1))


def test_streams(spark, tmp_path):
    df = datagen.fraud(spark, 100)
    records.write_batches(df, f"{tmp_path}/in", "s")
    stream = streams.json_batches(spark, f"{tmp_path}/in", records.FRAUD).groupBy("fraud_type").agg(F.count("*").alias("n"))
    got = {r.fraud_type: r.n for r in streams.drain(stream, "t_types", f"{tmp_path}/cp").collect()}
    assert got == {r.fraud_type: r["count"] for r in df.groupBy("fraud_type").count().collect()}


def test_reports(spark):
    a = spark.createDataFrame([(i, i % 2, i / 10, int(i > 5)) for i in range(10)], "k int, y int, risk double, pred int")
    assert report.comparison({"one": a, "two": a}).count() == 2
    assert report.validation(a, a, ["k"]).first().agreement == 1.0
    assert [r.decision for r in report.decisions(a, ["k"], n=2, order=["k"]).collect()] == ["DENY", "DENY", "APPROVE", "APPROVE"]
    assert "<td>0.5000</td>" in report.html(a)
    t = report.Timings()
    with t.step("fit"):
        pass
    assert t.summary(spark).first().n == 1
    assert report.scaling(spark, 10.0, 100, [200]).first().seconds == pytest.approx(17.35)
    assert report.cost(spark, [3600], 1.0, 2.0).first().dollars == pytest.approx(2.0)
