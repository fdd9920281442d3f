"""The fraud application on given tables: every order as a fraud record, and the eight models of the library over these, each with its SQL.

A record's fields follow from its order's: the level from the price, the type from the level, but for orders whose digest picks them for
noise, whose type is one of the other class. So no model is perfect, and all have something to learn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countspark.operators import counts
from countspark.operators.models import histogram, linear, naive_bayes, trees
from countspark.plans import model_sql
from countspark.plans import queries as q
from countspark.plans.spec import DatasetSpec
from countspark.sources import datagen

#: The features of the fraud models in order, and their parents.
FRAUD = DatasetSpec(
    domains={
        "fraud_type": [*datagen.HIGH_TYPES, *datagen.LOW_TYPES],
        "account_jurisdiction": [c.lower() for c in datagen.JURISDICTIONS],
        "is_active": ["true", "false"],
        "month": [str(m) for m in range(1, 13)],
        "reporting_bank_id": [f"bank{k:03d}" for k in range(1, 51)],
        "year": [str(y) for y in datagen.YEARS],
    },
    numeric=("month_n", "day_n", "year_n"),
    parents={"account_jurisdiction": ("fraud_type",), "is_active": ("fraud_type",), "month": ("year",), "reporting_bank_id": ("account_jurisdiction",)},
)
NOISE = 0.08  # of the records whose type is of the other class
KEY = ["o_orderkey"]


def prepare(records: DataFrame, threshold: int = 50) -> DataFrame:
    """Fraud records with the label y, risk_level from the threshold on, and the numbers of the Gaussian model."""
    return records.withColumns({"y": (F.col("risk_level") >= threshold).cast("int"), **{f"{c}_n": F.col(c).cast("int") for c in ("month", "day", "year")}})


def one_of(values: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a fraud record; columns that no query asks for are pruned from the scans."""
    c = F.col
    level = F.pmod(F.floor("o_totalprice").cast("long"), F.lit(101)).cast("int")
    high = (c("risk_level") >= 50) != datagen.picked(["o_orderkey"], NOISE, "type")
    joined = q.read(spark, sf_dir, "orders").join(q.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
    return joined.withColumn("risk_level", level).select(
        "o_orderkey",
        F.format_string("BANK%03d", F.pmod("o_custkey", F.lit(50)).cast("int") + 1).alias("reporting_bank_id"),
        one_of(list(datagen.JURISDICTIONS), c("c_nationkey")).alias("account_jurisdiction"),
        "risk_level",
        F.when(high, one_of(list(datagen.HIGH_TYPES), c("o_custkey"))).otherwise(one_of(list(datagen.LOW_TYPES), c("o_orderkey"))).alias("fraud_type"),
        (F.year("o_orderdate") + 23).alias("year"),
        F.month("o_orderdate").alias("month"),
        F.dayofmonth("o_orderdate").alias("day"),
        F.when(c("o_orderstatus") == "F", "false").otherwise("true").alias("is_active"),
    )


def splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    view = prepare(records(spark, sf_dir))
    held_out = F.pmod("o_orderkey", F.lit(5)) == 0
    return view.filter(~held_out), view.filter(held_out)


# ---- SQL

_one_of = lambda values, at: f"list_extract([{', '.join(f'{v!r}' for v in values)}], CAST({at} % {len(values)} AS INTEGER) + 1)"
RECORDS_SQL = f"""SELECT o_orderkey, 'bank' || lpad(CAST(o_custkey % 50 + 1 AS VARCHAR), 3, '0') AS reporting_bank_id, lower({_one_of(list(datagen.JURISDICTIONS), "c_nationkey")}) AS account_jurisdiction, y,
CASE WHEN (y = 1) <> {datagen.picked_sql(["o_orderkey"], NOISE, "type")} THEN {_one_of(list(datagen.HIGH_TYPES), "o_custkey")} ELSE {_one_of(list(datagen.LOW_TYPES), "o_orderkey")} END AS fraud_type,
CAST(year(o_orderdate) + 23 AS VARCHAR) AS "year", CAST(month(o_orderdate) AS VARCHAR) AS "month", CASE WHEN o_orderstatus = 'F' THEN 'false' ELSE 'true' END AS is_active,
year(o_orderdate) + 23 AS year_n, month(o_orderdate) AS month_n, day(o_orderdate) AS day_n
FROM (SELECT *, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 >= 50 AS INTEGER) AS y FROM orders) JOIN customer ON o_custkey = c_custkey"""
_NAMES = ", ".join(f'"{f}"' for f in FRAUD.features)
BASE = f"""rec AS MATERIALIZED ({RECORDS_SQL}), train AS (SELECT * FROM rec WHERE o_orderkey % 5 <> 0), test AS (SELECT * FROM rec WHERE o_orderkey % 5 = 0),
dom AS (SELECT * FROM (VALUES {", ".join(f"('{f}', '{v}', {i})" for f, v, i in FRAUD.candidates())}) AS t(feature, value, col_idx)),
tall AS (UNPIVOT (SELECT y, {_NAMES} FROM train) ON {_NAMES} INTO NAME feature VALUE value),
seen AS (SELECT feature, value, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM tall GROUP BY feature, value),
marg AS (SELECT d.feature, d.value, d.col_idx, coalesce(s.p, 0) AS n_pos, coalesce(s.n, 0) AS n_neg FROM dom d LEFT JOIN seen s ON d.feature = s.feature AND d.value = s.value),
tot AS (SELECT count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM train), size AS (SELECT feature, count(*) AS k FROM dom GROUP BY feature)"""
_ENDS = lambda source, at: f"SELECT o_orderkey, {q._R('1 / (1 + exp(b - a))')} AS risk, CAST({at} AS INTEGER) AS pred FROM {source}"


def _logs(side: str, c: str) -> str:
    return " + ".join(f"ln(coalesce((l{i}.n_{side} + 1.0::DOUBLE) / (t.{c} + s{i}.k), 0.1))" for i in range(len(FRAUD.features)))


_JOINS = " ".join(f"LEFT JOIN marg l{i} ON l{i}.feature = '{f}' AND l{i}.value = x.\"{f}\" JOIN size s{i} ON s{i}.feature = '{f}'" for i, f in enumerate(FRAUD.features))
NB_SQL = f"""WITH {BASE}, nb AS (SELECT x.o_orderkey, ln(t.p / (t.p + t.n)::DOUBLE + 1e-10) + {_logs("pos", "p")} AS a, ln(t.n / (t.p + t.n)::DOUBLE + 1e-10) + {_logs("neg", "n")} AS b
FROM test x CROSS JOIN tot t {_JOINS}) {_ENDS("nb", "a > b")}"""


def _state(f: str, row: str = "") -> str:
    return " || '|' || ".join(f"'{p}=' || {row}\"{p}\"" for p in FRAUD.parents.get(f, ())) or "''"


_CELLS = lambda source, keep: " UNION ALL ".join(f"SELECT '{f}' AS feature, {_state(f)} AS parent_state, \"{f}\" AS value, {keep} FROM {source}" for f in FRAUD.features)
_EVERY = " UNION ALL ".join(
    f"SELECT d.feature, p.feature || '=' || p.value AS parent_state, d.value FROM dom d JOIN dom p ON p.feature = '{FRAUD.parents[f][0]}' WHERE d.feature = '{f}'"
    if FRAUD.parents.get(f) else f"SELECT d.feature, '' AS parent_state, d.value FROM dom d WHERE d.feature = '{f}'"
    for f in FRAUD.features
)
BN_SQL = f"""WITH {BASE}, found AS (SELECT feature, parent_state, value, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM ({_CELLS("train", "y")}) GROUP BY 1, 2, 3),
cells AS (SELECT e.*, coalesce(f.p, 0) AS p, coalesce(f.n, 0) AS n FROM ({_EVERY}) e LEFT JOIN found f ON f.feature = e.feature AND f.parent_state = e.parent_state AND f.value = e.value),
pr AS (SELECT feature, parent_state, value, ln((p + 1.0::DOUBLE) / (sum(p) OVER w + count(*) OVER w)) AS la, ln((n + 1.0::DOUBLE) / (sum(n) OVER w + count(*) OVER w)) AS lb FROM cells WINDOW w AS (PARTITION BY feature, parent_state)),
bl AS (SELECT x.o_orderkey, ln(max(t.p) / max(t.p + t.n)::DOUBLE + 1e-12) + sum(la) AS a, ln(max(t.n) / max(t.p + t.n)::DOUBLE + 1e-12) + sum(lb) AS b
  FROM ({_CELLS("test", "o_orderkey")}) x JOIN pr ON pr.feature = x.feature AND pr.parent_state = x.parent_state AND pr.value = x.value CROSS JOIN tot t GROUP BY 1) {_ENDS("bl", "1 / (1 + exp(b - a)) >= 0.5")}"""


def gaussian_sql(base: str, sums: str, numeric: tuple[str, ...], key: str, classes: str) -> str:
    """Scores of the Gaussian model from sums (feature, cls, n, total, total_sq); classes gives its class totals p and n."""
    log = lambda c: " + ".join(f"(SELECT -0.5 * (ln(2 * pi() * var) + (x.{f} - mean) * (x.{f} - mean) / var) FROM gp WHERE feature = '{f}' AND cls = {c})" for f in numeric)
    return f"""WITH {base}, gs AS ({sums}), gv AS (SELECT feature, cls, n, total / n AS mean, greatest(total_sq / n - (total / n) * (total / n), 0) AS var FROM gs),
gall AS (SELECT feature, greatest(sum(total_sq) / sum(n) - (sum(total) / sum(n)) * (sum(total) / sum(n)), 0) AS var FROM gs GROUP BY feature),
eps AS (SELECT greatest(1e-9 * greatest((SELECT max(var) FROM gall), (SELECT max(var) FROM gv)), 1e-12) AS e),
gp AS MATERIALIZED (SELECT feature, cls, mean, greatest(var + e, 1e-12) AS var FROM gv CROSS JOIN eps), gt AS ({classes}),
gl AS (SELECT x.{key}, ln(t.p / (t.p + t.n)::DOUBLE + 1e-12) + {log(1)} AS a, ln(t.n / (t.p + t.n)::DOUBLE + 1e-12) + {log(0)} AS b FROM test x CROSS JOIN gt t)
SELECT {key}, {q._R('1 / (1 + exp(b - a))')} AS risk, CAST(1 / (1 + exp(b - a)) >= 0.5 AS INTEGER) AS pred FROM gl"""


_SUMS = " UNION ALL ".join(f"SELECT '{f}' AS feature, y AS cls, count(*)::DOUBLE AS n, sum({f})::DOUBLE AS total, sum({f} * {f})::DOUBLE AS total_sq FROM train GROUP BY y" for f in FRAUD.numeric)
HIST_SQL = f"""WITH {BASE}, prior AS (SELECT p / (p + n)::DOUBLE AS r FROM tot), hb AS (SELECT feature, value, n_pos + n_neg AS support, (n_pos + 1) / (n_pos + n_neg + 2)::DOUBLE AS bucket_risk FROM marg),
hw AS (SELECT hb.feature, 1 + sum(support / s.n::DOUBLE * abs(bucket_risk - (SELECT r FROM prior))) AS weight FROM hb JOIN (SELECT feature, sum(support) AS n FROM hb GROUP BY 1) s ON s.feature = hb.feature GROUP BY hb.feature),
hx AS (UNPIVOT (SELECT o_orderkey, {_NAMES} FROM test) ON {_NAMES} INTO NAME feature VALUE value),
hs AS (SELECT o_orderkey, sum(weight * coalesce(bucket_risk, (SELECT r FROM prior))) / sum(weight) AS risk FROM hx JOIN hw ON hw.feature = hx.feature LEFT JOIN hb ON hb.feature = hx.feature AND hb.value = hx.value GROUP BY 1)
SELECT o_orderkey, {q._R('risk')} AS risk, CAST(risk >= (SELECT r FROM prior) AS INTEGER) AS pred FROM hs"""


# ---- queries


def _scores(df: DataFrame) -> DataFrame:
    return q.rounded(df.select(*KEY, "risk", "pred"))


@q.query(NB_SQL)
def fraud_nb_scores(spark, sf_dir):
    train, test = splits(spark, sf_dir)
    p, n = counts.base_rates(train).first()
    return _scores(naive_bayes.NaiveBayes.fit(counts.marginals(train, FRAUD), FRAUD, p, n).transform(test))


@q.query(BN_SQL)
def fraud_bn_scores(spark, sf_dir):
    return _from_cube(spark, sf_dir, lambda cube, p, n: naive_bayes.BayesNet.fit(counts.cpt_of_cube(cube, FRAUD), FRAUD, p, n))


@q.query(gaussian_sql(BASE, _SUMS, FRAUD.numeric, "o_orderkey", "SELECT * FROM tot"))
def fraud_gnb_scores(spark, sf_dir):
    train, test = splits(spark, sf_dir)
    return _scores(naive_bayes.GaussianNaiveBayes.fit(counts.gaussian_stats(train, FRAUD.numeric)).transform(test))


@q.query(HIST_SQL)
def fraud_hist_scores(spark, sf_dir):
    train, test = splits(spark, sf_dir)
    p, n = counts.base_rates(train).first()
    return _scores(histogram.HistogramClassifier.fit(counts.marginals(train, FRAUD), FRAUD, p, n).transform(test))


def _from_cube(spark: SparkSession, sf_dir: str, fit) -> DataFrame:
    train, test = splits(spark, sf_dir)
    with q.held(counts.cube(train, FRAUD)) as cube:
        model = fit(cube, *q.totals(cube))
    return _scores(model.transform(test))


@q.query(model_sql.forest(BASE, FRAUD, KEY, [FRAUD.features]))
def fraud_tree_scores(spark, sf_dir):
    return _from_cube(spark, sf_dir, lambda cube, p, n: trees.decision_tree(cube, FRAUD, p, n))


@q.query(model_sql.forest(BASE, FRAUD, KEY, trees.feature_subsets(FRAUD.features, 7, 4, 42)))
def fraud_forest_scores(spark, sf_dir):
    return _from_cube(spark, sf_dir, lambda cube, p, n: trees.random_forest(cube, FRAUD, p, n))


@q.query(model_sql.adaboost(BASE, FRAUD, KEY))
def fraud_boost_scores(spark, sf_dir):
    return _from_cube(spark, sf_dir, lambda cube, p, n: trees.adaboost(cube, FRAUD))


@q.query(model_sql.linear(BASE, FRAUD, KEY, linear.dummies(FRAUD)))
def fraud_lr_scores(spark, sf_dir):
    return _from_cube(spark, sf_dir, lambda cube, p, n: linear.Logistic.fit(cube, FRAUD, p, n))
