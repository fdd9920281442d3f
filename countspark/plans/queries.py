"""The registered queries over the star schema, each beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countspark.functions import clinical, strings
from countspark.functions.math import DOUBLING, apply_platt, power_law, recalibrate
from countspark.operators import analysis, baselines, counts, metrics, neighbours, quantiles, report, suppress
from countspark.operators.models import histogram, linear, naive_bayes, trees
from countspark.plans import model_sql
from countspark.plans.spec import RISK, DatasetSpec, in_test, risk_view, test_of, train_of
from countspark.sources import datagen, records, scan
from countspark.sources.scratch import shared_folder, written
from countspark.streaming import counts as streams

Query = Callable[[SparkSession, str], DataFrame]
FEATURES = RISK.features

_TABLES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _TABLES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles as both engines agree on them; adding zero drops a negative zero's sign."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table that several jobs read; what is lost with an executor is computed again."""
    kept = df.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def train_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.cube(train_of(risk_view(spark, sf_dir)), RISK)


def totals(cube: DataFrame) -> tuple[int, int]:
    r = cube.agg(F.sum("n_pos"), F.sum("n_neg")).first()
    return r[0] or 0, r[1] or 0


def from_cube(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame, int, int], DataFrame]) -> DataFrame:
    """make(cube, positives, others) while the cube is held; for results as small as the domains, which come to the driver."""
    with held(train_cube(spark, sf_dir)) as cube:
        found = make(cube, *totals(cube))
        rows = found.collect()
    return spark.createDataFrame(rows, found.schema)


KEYS = ["l_orderkey", "l_linenumber"]


def scores(df: DataFrame) -> DataFrame:
    return rounded(df.select(*KEYS, "risk", "pred"))


# ---- SQL building blocks: the view, its split, and counts in DuckDB's dialect

_R = lambda x, d=6: f"round({x}, {d}) + 0.0"
_DOMAIN = ", ".join(f"('{f}', '{v}', {i})" for f, v, i in RISK.candidates())
_NAMES = ", ".join(FEATURES)

RISK_SQL = f"""
risk AS (
  SELECT l_orderkey, l_linenumber, CAST(least(100, floor(l_quantity) + CASE l_returnflag WHEN 'R' THEN 40 WHEN 'A' THEN 20 ELSE 0 END) AS INTEGER) AS risk_level,
         lower(l_returnflag) AS flag, lower(l_linestatus) AS status, CAST(month(l_shipdate) AS VARCHAR) AS "month", CAST(year(l_shipdate) AS VARCHAR) AS "year",
         lower(o_orderpriority) AS priority, lower(c_mktsegment) AS segment, lower(r_name) AS region,
         CAST(month(l_shipdate) AS INTEGER) AS month_n, CAST(day(l_shipdate) AS INTEGER) AS day_n, CAST(year(l_shipdate) AS INTEGER) AS year_n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), labelled AS (SELECT *, CAST(risk_level >= 50 AS INTEGER) AS y FROM risk),
train AS (SELECT * FROM labelled WHERE l_orderkey % 5 <> 0), test AS (SELECT * FROM labelled WHERE l_orderkey % 5 = 0),
dom AS (SELECT * FROM (VALUES {_DOMAIN}) AS t(feature, value, col_idx)),
tall AS (UNPIVOT (SELECT y, {", ".join(f'"{f}"' for f in FEATURES)} FROM train) ON {", ".join(f'"{f}"' for f in FEATURES)} INTO NAME feature VALUE value),
seen AS (SELECT feature, value, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM tall GROUP BY feature, value),
marg AS (SELECT d.feature, d.value, d.col_idx, coalesce(s.n_pos, 0) AS n_pos, coalesce(s.n_neg, 0) AS n_neg FROM dom d LEFT JOIN seen s ON d.feature = s.feature AND d.value = s.value),
tot AS (SELECT count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM train),
size AS (SELECT feature, count(*) AS k FROM dom GROUP BY feature),
lik AS (SELECT m.feature, m.value, (m.n_pos + 1.0::DOUBLE) / (t.p + s.k) AS lik_pos, (m.n_neg + 1.0::DOUBLE) / (t.n + s.k) AS lik_neg FROM marg m JOIN size s ON m.feature = s.feature CROSS JOIN tot t)"""

NB_SQL = (
    RISK_SQL
    + ", nb_logs AS (SELECT x.l_orderkey, x.l_linenumber, x.y, ln(t.p / (t.p + t.n)::DOUBLE + 1e-10) + "
    + " + ".join(f"ln(coalesce(l{i}.lik_pos, 0.1))" for i in range(len(FEATURES)))
    + " AS log_pos, ln(t.n / (t.p + t.n)::DOUBLE + 1e-10) + "
    + " + ".join(f"ln(coalesce(l{i}.lik_neg, 0.1))" for i in range(len(FEATURES)))
    + " AS log_neg FROM test x CROSS JOIN tot t "
    + " ".join(f"LEFT JOIN lik l{i} ON l{i}.feature = '{f}' AND l{i}.value = x.\"{f}\"" for i, f in enumerate(FEATURES))
    + "), nb AS (SELECT *, 1 / (1 + exp(log_neg - log_pos)) AS risk, CAST(log_pos > log_neg AS INTEGER) AS pred FROM nb_logs)"
)


def confusion_sql(source: str, pred: str, extra: str = "") -> str:
    return f"""SELECT tp, fp, fn, tn, {_R("tp / greatest(tp + fn, 1)::DOUBLE")} AS sens, {_R("tn / greatest(tn + fp, 1)::DOUBLE")} AS spec, {_R("tp / greatest(tp + fp, 1)::DOUBLE")} AS ppv,
      {_R("2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE")} AS f1, {_R("(tp + fp) / (tp + fp + fn + tn)::DOUBLE")} AS flagged, {_R("(tp + tn) / (tp + fp + fn + tn)::DOUBLE")} AS acc{extra}
    FROM (SELECT count(*) FILTER (WHERE {pred} AND y = 1) AS tp, count(*) FILTER (WHERE {pred} AND y = 0) AS fp,
                 count(*) FILTER (WHERE NOT {pred} AND y = 1) AS fn, count(*) FILTER (WHERE NOT {pred} AND y = 0) AS tn FROM {source})"""


# ---- scans and filters


def _filter(name: str, table: str, filters: str, where: str, columns: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan.query(read(spark, sf_dir, table), filters, columns=columns)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")(run)


_LINE = ["l_orderkey", "l_linenumber", "l_quantity"]
_filter("filter_equality", "lineitem", "l_returnflag:R,l_linenumber:3", "l_returnflag = 'R' AND l_linenumber = 3", _LINE)
_filter("filter_range", "lineitem", "l_quantity:10~20", "l_quantity BETWEEN 10 AND 20", _LINE)
_filter("filter_compare", "lineitem", "l_quantity:>=30,l_discount:<0.05", "l_quantity >= 30 AND l_discount < 0.05", _LINE)
_filter("filter_negation", "orders", "o_orderstatus:!=F,o_totalprice:>1000", "o_orderstatus <> 'F' AND o_totalprice > 1000", ["o_orderkey", "o_custkey"])
_filter("hamming_match", "part", 'p_brand:hamming("Brand#11",1)', "length(p_brand) = 8 AND hamming(CASE WHEN length(p_brand) = 8 THEN p_brand ELSE 'xxxxxxxx' END, 'Brand#11') <= 1", ["p_partkey", "p_brand"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 50 OFFSET 20")
def limit_offset(spark, sf_dir):
    return scan.query(read(spark, sf_dir, "orders"), "o_orderpriority:1-URGENT", limit=50, offset=20, order=["o_orderkey"], columns=["o_orderkey", "o_custkey"])


@query("SELECT count(*) AS value FROM lineitem WHERE l_quantity BETWEEN 25 AND 50 AND l_returnflag = 'A'")
def agg_count(spark, sf_dir):
    return scan.aggregate(read(spark, sf_dir, "lineitem"), "l_quantity:count(25~50)", "l_returnflag:A")


@query(f"SELECT {_R('avg(l_extendedprice)', 4)} AS value FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 50000 AND l_returnflag = 'N'")
def agg_avg(spark, sf_dir):
    return rounded(scan.aggregate(read(spark, sf_dir, "lineitem"), "l_extendedprice:avg(0~50000)", "l_returnflag:N"), 4)


@query("SELECT sum(l_quantity) AS value FROM lineitem WHERE l_linestatus = 'O'")
def agg_sum(spark, sf_dir):
    return scan.aggregate(read(spark, sf_dir, "lineitem"), "l_quantity:sum()", "l_linestatus:O")


@query("SELECT min(l_discount) + 0.0 AS value_min, max(l_discount) + 0.0 AS value_max FROM lineitem WHERE l_discount BETWEEN 0 AND 1")
def agg_minmax(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    low, high = (scan.aggregate(df, f"l_discount:{fn}(0~1)").select((F.col("value") + 0.0).alias(f"value_{fn}")) for fn in ("min", "max"))
    return low.join(F.broadcast(high))  # one row each


@query("SELECT count(*) FILTER (WHERE l_quantity >= 30) AS value FROM lineitem WHERE l_returnflag = 'R'")
def count_only(spark, sf_dir):
    return scan.count_only(read(spark, sf_dir, "lineitem"), ["l_quantity:>=30", "l_returnflag:R"])


@query("SELECT least(count(*) FILTER (WHERE l_quantity >= 30), count(*) FILTER (WHERE l_returnflag = 'R')) AS value FROM lineitem")
def count_upper_bound(spark, sf_dir):
    return scan.count_upper_bound(read(spark, sf_dir, "lineitem"), ["l_quantity:>=30", "l_returnflag:R"])


# ---- counts


@query(f"WITH {RISK_SQL} SELECT p AS n_pos, n AS n_neg FROM tot")
def base_rates(spark, sf_dir):
    return counts.base_rates(train_of(risk_view(spark, sf_dir)))


@query(f"WITH {RISK_SQL} SELECT feature, value, CAST(col_idx AS INTEGER) AS col_idx, n_pos, n_neg FROM marg")
def marginal_counts(spark, sf_dir):
    return counts.marginals(train_of(risk_view(spark, sf_dir)), RISK)


@query(f"WITH {RISK_SQL} SELECT feature, 1 AS cls, value, n_pos AS cnt FROM marg UNION ALL SELECT feature, 0, value, n_neg FROM marg")
def marginal_counts_tidy(spark, sf_dir):
    return counts.tidy(counts.marginals_of_cube(train_cube(spark, sf_dir), RISK))


@query(f"""WITH {RISK_SQL} SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY try_cast(value AS BIGINT) IS NULL, try_cast(value AS BIGINT), value) - 1 AS INTEGER) AS position, value
FROM (SELECT DISTINCT feature, value FROM (UNPIVOT (SELECT {", ".join(f'"{f}"' for f in FEATURES)} FROM labelled) ON {", ".join(f'"{f}"' for f in FEATURES)} INTO NAME feature VALUE value))""")
def feature_domains(spark, sf_dir):
    return counts.domains(risk_view(spark, sf_dir), FEATURES)


_GNB = " UNION ALL ".join(f"SELECT '{c}' AS feature, y AS cls, count(*) AS n, sum({c})::DOUBLE AS total, sum({c}::DOUBLE * {c}) AS total_sq FROM train GROUP BY y" for c in RISK.numeric)


@query(f"WITH {RISK_SQL} {_GNB}")
def gaussian_stats(spark, sf_dir):
    return counts.gaussian_stats(train_of(risk_view(spark, sf_dir)), RISK.numeric)


def _state_sql(f: str, alias: str = "") -> str:
    ps = RISK.parents.get(f, ())
    return " || '|' || ".join(f"'{p}=' || {alias}\"{p}\"" for p in ps) or "''"


_CPT = "cpt_seen AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {_state_sql(f)} AS parent_state, \"{f}\" AS value, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM train GROUP BY 2, 3" for f in FEATURES
) + "), cpt_all AS (" + " UNION ALL ".join(
    f"SELECT d.feature, {'p.feature || chr(61) || p.value' if RISK.parents.get(f) else chr(39) * 2} AS parent_state, d.value FROM dom d "
    + (f"JOIN dom p ON p.feature = '{RISK.parents[f][0]}' " if RISK.parents.get(f) else "")
    + f"WHERE d.feature = '{f}'"
    for f in FEATURES
) + "), cpt AS (SELECT a.*, coalesce(s.n_pos, 0) AS n_pos, coalesce(s.n_neg, 0) AS n_neg FROM cpt_all a LEFT JOIN cpt_seen s ON a.feature = s.feature AND a.parent_state = s.parent_state AND a.value = s.value)"


@query(f"WITH {RISK_SQL}, {_CPT} SELECT feature, parent_state, value, n_pos, n_neg FROM cpt")
def cpt_counts(spark, sf_dir):
    return counts.cpt(train_of(risk_view(spark, sf_dir)), RISK)


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS fa, \"{a}\" AS va, '{b}' AS fb, \"{b}\" AS vb, count(*) AS cnt, count(*) FILTER (WHERE y = 1) AS n_pos FROM train GROUP BY 2, 4" for a, b in combinations(FEATURES, 2))


@query(f"WITH {RISK_SQL} {_PAIRS}")
def pairwise_counts(spark, sf_dir):
    return counts.pairwise(train_cube(spark, sf_dir), RISK)


@query("SELECT l_returnflag, count(*) AS cnt FROM lineitem GROUP BY 1")
def value_counts(spark, sf_dir):
    return counts.value_counts(read(spark, sf_dir, "lineitem"), "l_returnflag")


@query("SELECT p, " + _R("CASE p WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.75 THEN quantile_cont(value, 0.75) WHEN 0.95 THEN quantile_cont(value, 0.95) ELSE quantile_cont(value, 0.99) END") + " AS value FROM events CROSS JOIN (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) AS t(p) GROUP BY p")
def score_percentiles(spark, sf_dir):
    return rounded(quantiles.percentiles(read(spark, sf_dir, "events"), "value"))


@query(f"SELECT event_type, count(*) AS cnt, {_R('min(value)')} AS lowest, {_R('max(value)')} AS highest, {_R('avg(value)')} AS mean, {_R('sum(value)', 3)} AS total FROM events GROUP BY 1")
def profiling_summary(spark, sf_dir):
    v = F.col("value")
    by = read(spark, sf_dir, "events").groupBy("event_type")
    found = by.agg(F.count("*").alias("cnt"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.avg(v).alias("mean"), F.round(F.sum(v), 3).alias("total"))
    return rounded(found)


# ---- suppression

_CELLS = "SELECT p_brand, n_name, o_orderpriority, count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"


def _cells(spark, sf_dir):
    t = lambda n: read(spark, sf_dir, n)
    return (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    )


@query(f"SELECT p_brand, n_name, o_orderpriority, CASE WHEN cnt BETWEEN 1 AND 10 THEN 5 ELSE cnt END AS cnt, CAST(cnt BETWEEN 1 AND 10 AS INTEGER) AS n_suppressed FROM ({_CELLS})")
def suppress_midpoint(spark, sf_dir):
    cells = _cells(spark, sf_dir).groupBy("p_brand", "n_name", "o_orderpriority").agg(F.count("*").alias("cnt"))
    return suppress.suppress(cells, ["cnt"])


@query(f"""WITH {RISK_SQL}, pairs AS ({_PAIRS}) SELECT q.fa, q.va, q.fb, q.vb,
{_R("CASE WHEN q.cnt BETWEEN 1 AND 499 THEN (a.n_pos + a.n_neg) * (b.n_pos + b.n_neg) / (t.p + t.n)::DOUBLE ELSE q.cnt::DOUBLE END")} AS cnt
FROM pairs q JOIN marg a ON q.fa = a.feature AND q.va = a.value JOIN marg b ON q.fb = b.feature AND q.vb = b.value CROSS JOIN tot t""")
def suppress_independence(spark, sf_dir):
    estimates = lambda c, p, n: suppress.independence_estimates(counts.pairwise(c, RISK), counts.marginals_of_cube(c, RISK), p + n, k=500)
    return rounded(from_cube(spark, sf_dir, estimates))


@query(f"SELECT min(cnt) AS min_class, count(*) AS n_classes, min(cnt) >= 5 AS release_k5, min(cnt) >= 10 AS release_k10, min(cnt) >= 20 AS release_k20 FROM ({_CELLS})")
def k_anonymity_min(spark, sf_dir):
    return suppress.anonymity(_cells(spark, sf_dir), ["p_brand", "n_name", "o_orderpriority"])


# ---- naive Bayes


@query(f"WITH {RISK_SQL} SELECT feature, value, {_R('lik_pos', 9)} AS lik_pos, {_R('lik_neg', 9)} AS lik_neg FROM lik")
def nb_params(spark, sf_dir):
    return rounded(from_cube(spark, sf_dir, lambda c, p, n: naive_bayes.likelihoods(counts.marginals_of_cube(c, RISK), RISK, p, n)), 9)


def fitted_nb(spark, sf_dir) -> naive_bayes.NaiveBayes:
    with held(train_cube(spark, sf_dir)) as cube:
        return naive_bayes.NaiveBayes.fit(counts.marginals_of_cube(cube, RISK), RISK, *totals(cube))


def nb_scored(spark, sf_dir) -> DataFrame:
    return fitted_nb(spark, sf_dir).transform(test_of(risk_view(spark, sf_dir)))


def nb_counted(spark, sf_dir) -> DataFrame:
    """(risk, pred, y, n): the rows of nb_scored(), of which n are alike. Lines that agree in all features have one score, so both parts of the lines are
    counted by features in one pass: some counts fit the model, which scores the others."""
    cells = written(counts.cube(in_test(risk_view(spark, sf_dir)), RISK, by=("in_test",)))  # as many rows as the domains allow
    train = cells.filter("not in_test")
    model = naive_bayes.NaiveBayes.fit(counts.marginals_of_cube(train, RISK), RISK, *totals(train))
    return model.transform(counts.by_label(cells.filter("in_test"))).select("risk", "pred", "y", "n")


@query(f"WITH {NB_SQL} SELECT l_orderkey, l_linenumber, {_R('risk')} AS risk, pred FROM nb")
def nb_scores(spark, sf_dir):
    return scores(nb_scored(spark, sf_dir))


@query(f"WITH {NB_SQL} " + confusion_sql("nb", "pred = 1"))
def nb_confusion(spark, sf_dir):
    return rounded(metrics.confusion(nb_counted(spark, sf_dir), F.col("pred"), weight="n"))


@query(f"WITH {RISK_SQL}, spread AS (SELECT feature, max(lik_pos) - min(lik_pos) AS s FROM lik GROUP BY feature) SELECT feature, {_R('s / (SELECT max(s) FROM spread)')} AS importance FROM spread")
def nb_importance(spark, sf_dir):
    return rounded(spark.createDataFrame(fitted_nb(spark, sf_dir).importance(), "feature string, importance double"))


# ---- Gaussian naive Bayes

_GNB_SQL = RISK_SQL + f""", gs AS ({_GNB}), gv AS (SELECT feature, cls, n, total / n AS mean, greatest(total_sq / n - (total / n) * (total / n), 0) AS var FROM gs),
gall AS (SELECT feature, greatest(sum(total_sq) / sum(n) - (sum(total) / sum(n)) * (sum(total) / sum(n)), 0) AS var FROM gs GROUP BY feature),
eps AS (SELECT greatest(1e-9 * greatest((SELECT max(var) FROM gall), (SELECT max(var) FROM gv)), 1e-12) AS e),
gp AS (SELECT feature, cls, mean, greatest(var + e, 1e-12) AS var FROM gv CROSS JOIN eps)"""
_GLOG = lambda c: " + ".join(
    f"(SELECT -0.5 * (ln(2 * pi() * var) + (x.{f} - mean) * (x.{f} - mean) / var) FROM gp WHERE feature = '{f}' AND cls = {c})" for f in RISK.numeric
)


@query(f"WITH {_GNB_SQL} SELECT feature, cls, {_R('mean')} AS mean, {_R('var', 5)} AS variance FROM gp")
def gnb_params(spark, sf_dir):
    model = naive_bayes.GaussianNaiveBayes.fit(counts.gaussian_stats(train_of(risk_view(spark, sf_dir)), RISK.numeric))
    rows = [(f, c, round(m, 6) + 0.0, round(v, 5) + 0.0) for f, by in model.stats.items() for c, (m, v) in by.items()]
    return spark.createDataFrame(rows, "feature string, cls int, mean double, variance double")


@query(f"""WITH {_GNB_SQL}, gl AS (SELECT x.l_orderkey, x.l_linenumber, ln(t.p / (t.p + t.n)::DOUBLE + 1e-12) + {_GLOG(1)} AS log_pos, ln(t.n / (t.p + t.n)::DOUBLE + 1e-12) + {_GLOG(0)} AS log_neg FROM test x CROSS JOIN tot t)
SELECT l_orderkey, l_linenumber, {_R('1 / (1 + exp(log_neg - log_pos))')} AS risk, CAST(1 / (1 + exp(log_neg - log_pos)) >= 0.5 AS INTEGER) AS pred FROM gl""")
def gnb_scores(spark, sf_dir):
    view = risk_view(spark, sf_dir)
    return scores(naive_bayes.GaussianNaiveBayes.fit(counts.gaussian_stats(train_of(view), RISK.numeric)).transform(test_of(view)))


# ---- Bayesian network

_BN_SQL = RISK_SQL + f""", {_CPT}, bn AS (SELECT feature, parent_state, value,
  (n_pos + 1.0::DOUBLE) / (sum(n_pos) OVER w + count(*) OVER w) AS prob_pos, (n_neg + 1.0::DOUBLE) / (sum(n_neg) OVER w + count(*) OVER w) AS prob_neg
  FROM cpt WINDOW w AS (PARTITION BY feature, parent_state))"""


@query(f"WITH {_BN_SQL} SELECT feature, parent_state, value, {_R('prob_pos', 9)} AS prob_pos, {_R('prob_neg', 9)} AS prob_neg FROM bn")
def bn_cpt(spark, sf_dir):
    model = fitted_bn(spark, sf_dir)
    rows = [(f, *k.split("\x00"), round(a, 9), round(b, 9)) for f, t in model.tables.items() for k, (a, b) in t.items()]
    return spark.createDataFrame(rows, "feature string, parent_state string, value string, prob_pos double, prob_neg double")


def fitted_bn(spark, sf_dir) -> naive_bayes.BayesNet:
    with held(train_cube(spark, sf_dir)) as cube:  # one join for the tables and the class totals
        return naive_bayes.BayesNet.fit(counts.cpt_of_cube(cube, RISK), RISK, *totals(cube))


@query(
    f"WITH {_BN_SQL}, bl AS (SELECT x.l_orderkey, x.l_linenumber, ln(t.p / (t.p + t.n)::DOUBLE + 1e-12) + "
    + " + ".join(f"ln(b{i}.prob_pos)" for i in range(len(FEATURES)))
    + " AS log_pos, ln(t.n / (t.p + t.n)::DOUBLE + 1e-12) + "
    + " + ".join(f"ln(b{i}.prob_neg)" for i in range(len(FEATURES)))
    + " AS log_neg FROM test x CROSS JOIN tot t "
    + " ".join(f"JOIN bn b{i} ON b{i}.feature = '{f}' AND b{i}.value = x.\"{f}\" AND b{i}.parent_state = {_state_sql(f, 'x.')}" for i, f in enumerate(FEATURES))
    + f") SELECT l_orderkey, l_linenumber, {_R('1 / (1 + exp(log_neg - log_pos))')} AS risk, CAST(1 / (1 + exp(log_neg - log_pos)) >= 0.5 AS INTEGER) AS pred FROM bl"
)
def bn_scores(spark, sf_dir):
    return scores(fitted_bn(spark, sf_dir).transform(test_of(risk_view(spark, sf_dir))))


# ---- histogram classifier

_HIST_SQL = RISK_SQL + """, prior AS (SELECT p / (p + n)::DOUBLE AS r FROM tot), hb AS (SELECT feature, value, n_pos + n_neg AS support, (n_pos + 1) / (n_pos + n_neg + 2)::DOUBLE AS bucket_risk FROM marg),
hw AS (SELECT feature, 1 + sum(support / (SELECT sum(support) FROM hb h WHERE h.feature = hb.feature)::DOUBLE * abs(bucket_risk - (SELECT r FROM prior))) AS weight FROM hb GROUP BY feature)"""


def train_marginals(spark, sf_dir) -> DataFrame:
    return counts.marginals_of_cube(train_cube(spark, sf_dir), RISK)


@query(f"WITH {_HIST_SQL} SELECT feature, value, support, {_R('bucket_risk', 9)} AS bucket_risk FROM hb")
def hist_buckets(spark, sf_dir):
    return rounded(histogram.buckets(train_marginals(spark, sf_dir)), 9)


@query(f"WITH {_HIST_SQL} SELECT feature, {_R('weight')} AS weight FROM hw")
def hist_weights(spark, sf_dir):
    return rounded(from_cube(spark, sf_dir, lambda c, p, n: histogram.weights(histogram.buckets(counts.marginals_of_cube(c, RISK)), p / (p + n))))


@query(
    f"WITH {_HIST_SQL}, hs AS (SELECT x.l_orderkey, x.l_linenumber, ("
    + " + ".join(f"w{i}.weight * h{i}.bucket_risk" for i in range(len(FEATURES)))
    + ") / ("
    + " + ".join(f"w{i}.weight" for i in range(len(FEATURES)))
    + ") AS risk FROM test x "
    + " ".join(f"JOIN hb h{i} ON h{i}.feature = '{f}' AND h{i}.value = x.\"{f}\" JOIN hw w{i} ON w{i}.feature = '{f}'" for i, f in enumerate(FEATURES))
    + f") SELECT l_orderkey, l_linenumber, {_R('risk')} AS risk, CAST(risk >= (SELECT r FROM prior) AS INTEGER) AS pred FROM hs"
)
def hist_scores(spark, sf_dir):
    with held(train_cube(spark, sf_dir)) as cube:
        model = histogram.HistogramClassifier.fit(counts.marginals_of_cube(cube, RISK), RISK, *totals(cube))
    return scores(model.transform(test_of(risk_view(spark, sf_dir))))


# ---- trees


def gini_sql(a: str, b: str) -> str:
    n = f"nullif({a} + {b}, 0)::DOUBLE"
    return f"(1 - ({a} / {n}) * ({a} / {n}) - ({b} / {n}) * ({b} / {n}))"


def gain_sql(lp: str, ln: str, p: str, n: str) -> str:
    all_, left = f"({p} + {n})::DOUBLE", f"({lp} + {ln})"
    return f"({gini_sql(p, n)} - {left} / {all_} * {gini_sql(lp, ln)} - ({all_} - {left}) / {all_} * {gini_sql(f'({p} - {lp})', f'({n} - {ln})')})"


@query(f"WITH {RISK_SQL} SELECT feature, value, CAST(col_idx AS INTEGER) AS col_idx, n_pos AS left_pos, n_neg AS left_neg, {_R(gain_sql('n_pos', 'n_neg', 't.p', 't.n'), 9)} AS gain FROM marg CROSS JOIN tot t WHERE n_pos + n_neg > 0 AND n_pos + n_neg < t.p + t.n")
def tree_root_gains(spark, sf_dir):
    def gains(cube: DataFrame, p: int, n: int) -> DataFrame:
        total = spark.createDataFrame([(0, p, n)], "node long, node_pos long, node_neg long")
        candidates = RISK.domain_table(spark).withColumn("node", F.lit(0).cast("long"))
        return trees.split_gains(counts.level_histogram(cube, RISK), total, candidates)

    return rounded(from_cube(spark, sf_dir, gains).select("feature", "value", "col_idx", "left_pos", "left_neg", "gain"), 9)


_ROOT = f"root AS (SELECT feature, value FROM marg CROSS JOIN tot t WHERE n_pos + n_neg > 0 AND n_pos + n_neg < t.p + t.n ORDER BY round({gain_sql('n_pos', 'n_neg', 't.p', 't.n')}, 12) DESC, col_idx LIMIT 1)"
_SIDES = (
    f", {_ROOT}, rowsat AS (SELECT x.*, CASE r.feature "
    + " ".join(f"WHEN '{f}' THEN \"{f}\"" for f in FEATURES)
    + f" END = r.value AS onleft FROM train x CROSS JOIN root r), sided AS (UNPIVOT (SELECT onleft, y, {', '.join(f'"{f}"' for f in FEATURES)} FROM rowsat) ON {', '.join(f'"{f}"' for f in FEATURES)} INTO NAME feature VALUE value),"
    " sh AS (SELECT CASE WHEN onleft THEN 2 ELSE 3 END AS node, feature, value, count(*) FILTER (WHERE y = 1) AS lp, count(*) FILTER (WHERE y = 0) AS ln FROM sided GROUP BY 1, 2, 3),"
    " st AS (SELECT CASE WHEN onleft THEN 2 ELSE 3 END AS node, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM rowsat GROUP BY 1),"
    f" sg AS (SELECT sh.node, sh.feature, sh.value, d.col_idx, lp, ln, {gain_sql('lp', 'ln', 'st.p', 'st.n')} AS gain FROM sh JOIN st ON sh.node = st.node JOIN dom d ON d.feature = sh.feature AND d.value = sh.value WHERE lp + ln < st.p + st.n)"
)


@query(f"WITH {RISK_SQL}{_SIDES} SELECT CAST(node AS BIGINT) AS node, feature, value, lp AS left_pos, ln AS left_neg, {_R('gain', 9)} AS gain FROM sg WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, col_idx) = 1")
def tree_level1_splits(spark, sf_dir):
    with held(train_cube(spark, sf_dir)) as cube:
        tree = trees.decision_tree(cube, RISK, *totals(cube), max_depth=2).trees[0]
    rows = [(i, t.feature, t.value, tree.nodes[2 * i].n_pos, tree.nodes[2 * i].n_neg, round(t.gain, 9)) for i, t in tree.nodes.items() if i in (2, 3) and t.feature]
    return spark.createDataFrame(rows, "node long, feature string, value string, left_pos long, left_neg long, gain double")


def _fit_and_score(spark, sf_dir, fit) -> DataFrame:
    with held(train_cube(spark, sf_dir)) as cube:
        model = fit(cube)
    return model.transform(test_of(risk_view(spark, sf_dir)))


@query(model_sql.forest(RISK_SQL, RISK, KEYS, [FEATURES], k_min=suppress.MIN_CELL))
def tree_scores(spark, sf_dir):
    return scores(_fit_and_score(spark, sf_dir, lambda c: trees.decision_tree(c, RISK, *totals(c), k_min=suppress.MIN_CELL)))


@query(model_sql.forest(RISK_SQL, RISK, KEYS, trees.feature_subsets(FEATURES, 7, 4, 42)))
def forest_scores(spark, sf_dir):
    return scores(_fit_and_score(spark, sf_dir, lambda c: trees.random_forest(c, RISK, *totals(c))))


@query(f"""WITH {RISK_SQL}, b AS (SELECT feature, value, col_idx, n_pos, n_neg, t.p, t.n, n_pos >= n_neg AS says, t.p - n_pos >= t.n - n_neg AS other FROM marg CROSS JOIN tot t WHERE n_pos + n_neg > 0 AND n_pos + n_neg < t.p + t.n),
e AS (SELECT *, (CASE WHEN says THEN n_neg ELSE n_pos END + CASE WHEN other THEN n - n_neg ELSE p - n_pos END) / (p + n)::DOUBLE AS error FROM b WHERE says <> other)
SELECT feature, value, CAST(says AS INTEGER) AS left_pred, {_R('0.5 * ln((1 - error) / error)')} AS alpha, {_R('error')} AS error FROM e ORDER BY round(error, 12), col_idx LIMIT 1""")
def boost_round1(spark, sf_dir):
    with held(train_cube(spark, sf_dir)) as cube:
        model = trees.adaboost(cube, RISK, n_estimators=1)
    return rounded(spark.createDataFrame([(s.feature, s.value, s.left_pred, s.alpha, s.error) for s in model.stumps], "feature string, value string, left_pred int, alpha double, error double"))


@query(model_sql.adaboost(RISK_SQL, RISK, KEYS))
def boost_scores(spark, sf_dir):
    return scores(_fit_and_score(spark, sf_dir, lambda c: trees.adaboost(c, RISK)))


@query(model_sql.boosted_regression(RISK_SQL, RISK, KEYS))
def boosted_regression_scores(spark, sf_dir):
    return scores(_fit_and_score(spark, sf_dir, lambda c: analysis.boosted_stumps(c, RISK)))


# ---- linear models

_SUMS = " UNION ALL ".join(
    ["SELECT NULL::VARCHAR AS fa, NULL::VARCHAR AS va, NULL::VARCHAR AS fb, NULL::VARCHAR AS vb, count(*) AS w, count(*) FILTER (WHERE y = 1) AS wy FROM train"]
    + [f"SELECT '{f}', \"{f}\", NULL, NULL, count(*), count(*) FILTER (WHERE y = 1) FROM train GROUP BY \"{f}\"" for f in FEATURES]
    + [f"SELECT '{a}', \"{a}\", '{b}', \"{b}\", count(*), count(*) FILTER (WHERE y = 1) FROM train GROUP BY \"{a}\", \"{b}\"" for a, b in combinations(FEATURES, 2)]
)


@query(f"WITH {RISK_SQL}, s AS ({_SUMS}) SELECT fa, va, fb, vb, w FROM s")
def lr_xtx(spark, sf_dir):
    return linear.sums(train_cube(spark, sf_dir), RISK, {"w": F.col("n_pos") + F.col("n_neg")})


@query(f"WITH {RISK_SQL}, s AS ({_SUMS}) SELECT fa, va, wy FROM s WHERE fb IS NULL")
def lr_xty(spark, sf_dir):
    return linear.sums(train_cube(spark, sf_dir), RISK, {"wy": F.col("n_pos")}).filter("fb is null").select("fa", "va", "wy")


@query(model_sql.linear(RISK_SQL, RISK, KEYS, linear.dummies(RISK), newton=8))
def lr_scores(spark, sf_dir):
    return scores(_fit_and_score(spark, sf_dir, lambda c: linear.Logistic.fit(c, RISK, *totals(c)).refine(c)))


@query(model_sql.linear(RISK_SQL, RISK, KEYS, linear.dummies(RISK), balanced=True, use_sigmoid=False))
def ols_scores(spark, sf_dir):
    with held(train_cube(spark, sf_dir)) as cube:
        model = linear.Logistic.fit(cube, RISK, *totals(cube), balanced=True)
    return scores(model.transform(test_of(risk_view(spark, sf_dir)), use_sigmoid=False))


# ---- metrics over naive Bayes scores, rounded so that both engines see the same ties

_CURVE = "nbr AS (SELECT round(risk, 9) AS s, y FROM nb), pts AS (SELECT s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM nbr GROUP BY s), cv AS (SELECT s, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM pts WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), al AS (SELECT sum(p)::DOUBLE AS np, sum(n)::DOUBLE AS nn FROM pts)"


def nb_curve(spark, sf_dir) -> DataFrame:
    return metrics.curve(nb_counted(spark, sf_dir), F.round("risk", 9), weight="n")


@query(f"WITH {NB_SQL} " + confusion_sql("nb", "risk >= 0.3"))
def confusion_metrics(spark, sf_dir):
    return rounded(metrics.evaluate_with(nb_counted(spark, sf_dir), F.col("risk"), threshold=0.3, weight="n"))


@query(f"WITH {NB_SQL}, {_CURVE} SELECT {_R('sum(n * (tp - p / 2.0::DOUBLE)) / (max(np) * max(nn))')} AS roc_auc FROM cv CROSS JOIN al")
def roc_auc(spark, sf_dir):
    return rounded(metrics.ranking(nb_curve(spark, sf_dir)).select("roc_auc"))


@query(f"WITH {NB_SQL}, {_CURVE} SELECT {_R('sum(p * tp / (tp + fp)::DOUBLE) / max(np)')} AS pr_auc FROM cv CROSS JOIN al")
def pr_auc(spark, sf_dir):
    return rounded(metrics.ranking(nb_curve(spark, sf_dir)).select("pr_auc"))


@query(f"WITH {NB_SQL}, {_CURVE} SELECT {_R('max(2 * tp / (tp + fp + np))')} AS f1_best FROM cv CROSS JOIN al")
def f1_best(spark, sf_dir):
    return rounded(metrics.ranking(nb_curve(spark, sf_dir)).select("f1_best"))


_PRIOR = "(SELECT avg(y) FROM nb)"
_MOVED = f"(s / (1 - s) * (0.015 / {_PRIOR}) * ((1 - {_PRIOR}) / (1 - 0.015)))"
_FULL = f""", moved AS (SELECT CASE WHEN s <= 0 THEN 0 WHEN s >= 1 THEN 1 ELSE {_MOVED} / (1 + {_MOVED}) END AS s, y FROM nbr), mpts AS (SELECT s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM moved GROUP BY s),
mcv AS (SELECT s, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM mpts WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
ranks AS (SELECT {_R('sum(n * (tp - p / 2.0::DOUBLE)) / (max(np) * max(nn))')} AS roc_auc, {_R('sum(p * tp / (tp + fp)::DOUBLE) / max(np)')} AS pr_auc, {_R('max(2 * tp / (tp + fp + np))')} AS f1_best FROM cv CROSS JOIN al),
mranks AS (SELECT {_R('max(2 * tp / (tp + fp + np))')} AS f1_shifted FROM mcv CROSS JOIN al)"""


@query(f"WITH {NB_SQL}, {_CURVE}{_FULL} SELECT c.*, r.*, m.*, {_R(_PRIOR)} AS cohort_prior, 0.015::DOUBLE AS population_prior, 0.5::DOUBLE AS threshold FROM ({confusion_sql('nbr', 's >= 0.5')}) c CROSS JOIN ranks r CROSS JOIN mranks m")
def full_metrics(spark, sf_dir):
    return rounded(metrics.metrics(nb_counted(spark, sf_dir).select("y", "n", F.round("risk", 9).alias("risk")), weight="n"))


_SHIFT = "(risk / (1 - risk) * (0.015 / 0.4) * ((1 - 0.4) / (1 - 0.015)))"


@query(f"WITH {NB_SQL} SELECT l_orderkey, l_linenumber, {_R(f'CASE WHEN risk <= 0 THEN 0 WHEN risk >= 1 THEN 1 ELSE {_SHIFT} / (1 + {_SHIFT}) END')} AS shifted FROM nb")
def prior_shift(spark, sf_dir):
    return rounded(nb_scored(spark, sf_dir).select(*KEYS, recalibrate(F.col("risk"), 0.4, 0.015).alias("shifted")))


@query(f"WITH {NB_SQL} SELECT l_orderkey, l_linenumber, {_R('1 / (1 + exp(-(3.5 * risk - 1.25)))')} AS calibrated FROM nb")
def platt_apply(spark, sf_dir):
    return rounded(nb_scored(spark, sf_dir).select(*KEYS, apply_platt(F.col("risk"), 3.5, -1.25).alias("calibrated")))


@query(model_sql.platt(f"{NB_SQL}, {_CURVE}", "pts"))
def platt_fit(spark, sf_dir):
    return rounded(spark.createDataFrame([linear.fit_platt(nb_counted(spark, sf_dir).select("y", "n", F.round("risk", 9).alias("risk")), weight="n")], "a double, b double"), 4)


@query(f"WITH {NB_SQL} SELECT {_R('avg(CAST(pred = CAST(risk >= 0.4 AS INTEGER) AS DOUBLE))')} AS agreement FROM nb")
def model_agreement(spark, sf_dir):
    scored = nb_counted(spark, sf_dir).withColumn("other", (F.col("risk") >= 0.4).cast("int"))
    return rounded(counts.agreement(scored, "pred", "other", weight="n"))


@query(f"""WITH {RISK_SQL}, d AS (SELECT 'train' AS split, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_pos FROM train UNION ALL SELECT 'test', count(*), count(*) FILTER (WHERE y = 1) FROM test),
s AS (SELECT *, n_pos / n::DOUBLE AS share_pos, abs(n_pos / n::DOUBLE - (SELECT n_pos / n::DOUBLE FROM d WHERE split = 'train')) * 100 AS drift_pp FROM d)
SELECT split, n, n_pos, {_R('share_pos')} AS share_pos, {_R('drift_pp')} AS drift_pp, drift_pp < 2 AS stable FROM s""")
def class_distribution(spark, sf_dir):
    view = risk_view(spark, sf_dir)
    return rounded(metrics.class_distribution({"train": train_of(view), "test": test_of(view)}))


# ---- clinical formulas over attributes derived from customers


_PATIENT = """SELECT c_custkey, CAST(40 + c_custkey % 35 AS INTEGER) AS age, CAST(8 + c_custkey % 10 AS INTEGER) AS menarche_age, CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 15 + c_custkey % 31 END AS INTEGER) AS first_birth,
CAST(c_custkey % 4 AS INTEGER) AS relatives, CAST(c_custkey % 6 AS INTEGER) AS biopsies, CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS atypical,
CAST(1 + c_custkey % 4 AS INTEGER) AS density, CASE WHEN c_custkey % 5 < 2 THEN 'yes' ELSE 'no' END AS family, CASE c_custkey % 5 WHEN 0 THEN 'white' WHEN 1 THEN 'black' WHEN 2 THEN 'hispanic' WHEN 3 THEN 'asian_pi' ELSE 'other' END AS race FROM customer"""


def patients(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    m = lambda n: F.pmod(k, F.lit(n))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", (40 + m(35)).cast("int").alias("age"), (8 + m(10)).cast("int").alias("menarche_age"), F.when(m(7) == 0, 0).otherwise(15 + m(31)).cast("int").alias("first_birth"),
        m(4).cast("int").alias("relatives"), m(6).cast("int").alias("biopsies"), F.when(m(3) == 0, "yes").when(m(3) == 1, "no").otherwise("unknown").alias("atypical"),
        (1 + m(4)).cast("int").alias("density"), F.when(m(5) < 2, "yes").otherwise("no").alias("family"),
        F.when(m(5) == 0, "white").when(m(5) == 1, "black").when(m(5) == 2, "hispanic").when(m(5) == 3, "asian_pi").otherwise("other").alias("race"),
    )


_AGE = "CASE WHEN age < 50 THEN {} WHEN age < 60 THEN {} WHEN age < 70 THEN {} ELSE {} END"
_BIRTH = "CASE " + " ".join(
    f"{f'WHEN first_birth < {b} THEN' if b else 'ELSE'} CASE WHEN relatives = 0 THEN {r[0]} WHEN relatives = 1 THEN {r[1]} ELSE {r[2]} END" for b, r in clinical.RR_BIRTH_RELATIVES
) + " END"
_BCRAT = f"""least(1.0, 1 - pow(1 - {_AGE.format(*clinical.BCRAT_BASELINE.values())}::DOUBLE, (CASE WHEN menarche_age < 12 THEN 1.207 WHEN menarche_age <= 13 THEN 1.098 ELSE 1.0 END)::DOUBLE
* (CASE WHEN biopsies = 0 THEN 1.0 WHEN age < 50 THEN CASE WHEN biopsies = 1 THEN 1.683 ELSE 2.75 END ELSE CASE WHEN biopsies = 1 THEN 1.237 ELSE 1.539 END END)::DOUBLE
* ({_BIRTH})::DOUBLE * (CASE atypical WHEN 'yes' THEN 1.82 WHEN 'no' THEN 0.93 ELSE 1.0 END)::DOUBLE))"""
_BCSC = f"""least(1.0, 1 - pow(1 - {_AGE.format(*clinical.BCSC_BASELINE.values())}::DOUBLE, (CASE density WHEN 1 THEN 0.55 WHEN 2 THEN 0.8 WHEN 3 THEN 1.35 ELSE 2.1 END)::DOUBLE
* (CASE family WHEN 'yes' THEN 1.8 ELSE 1.0 END)::DOUBLE * (CASE WHEN biopsies > 0 THEN 1.5 ELSE 1.0 END)::DOUBLE
* (CASE race WHEN 'white' THEN 1.0 WHEN 'black' THEN 0.95 WHEN 'hispanic' THEN 0.75 WHEN 'asian_pi' THEN 0.65 ELSE 0.85 END)::DOUBLE))"""


def _risks(df: DataFrame) -> DataFrame:
    c = F.col
    bcrat = clinical.bcrat_risk(c("age"), clinical.menarche_category(c("menarche_age")), c("first_birth"), c("relatives"), c("biopsies"), c("atypical"))
    bcsc = clinical.bcsc_risk(c("age"), c("density"), c("family"), F.when(c("biopsies") > 0, "yes").otherwise("no"), c("race"))
    return df.withColumns({"bcrat": bcrat, "bcsc": bcsc})


@query(f"SELECT c_custkey, {_R(_BCRAT, 8)} AS risk FROM ({_PATIENT})")
def bcrat_risk(spark, sf_dir):
    return rounded(_risks(patients(spark, sf_dir)).select("c_custkey", F.col("bcrat").alias("risk")), 8)


@query(f"SELECT c_custkey, {_R(_BCSC, 8)} AS risk FROM ({_PATIENT})")
def bcsc_risk(spark, sf_dir):
    return rounded(_risks(patients(spark, sf_dir)).select("c_custkey", F.col("bcsc").alias("risk")), 8)


@query(f"""SELECT t::DOUBLE AS threshold, {_R("avg(CAST(a >= t AS DOUBLE))")} AS bcrat_flagged, {_R("avg(CAST(b >= t AS DOUBLE))")} AS bcsc_flagged, {_R("avg(CAST((a >= t) = (b >= t) AS DOUBLE))")} AS agreement
FROM (SELECT {_BCRAT} AS a, {_BCSC} AS b FROM ({_PATIENT})) CROSS JOIN (VALUES (0.0167::DOUBLE), (0.03::DOUBLE)) AS v(t) GROUP BY t""")
def risk_model_comparison(spark, sf_dir):
    at = _risks(patients(spark, sf_dir)).withColumn("threshold", F.explode(F.array(F.lit(0.0167), F.lit(0.03))))
    a, b = (F.col(c) >= F.col("threshold") for c in ("bcrat", "bcsc"))
    share = lambda c, n: F.avg(c.cast("double")).alias(n)
    return rounded(at.groupBy("threshold").agg(share(a, "bcrat_flagged"), share(b, "bcsc_flagged"), share(a == b, "agreement")))


@query("""SELECT CASE WHEN age < 50 THEN '40_49' WHEN age < 60 THEN '50_59' WHEN age < 70 THEN '60_69' ELSE '70_74' END AS age_group,
CASE WHEN first_birth = 0 THEN 'nulliparous' WHEN first_birth < 20 THEN 'under_20' WHEN first_birth < 25 THEN '20_24' WHEN first_birth < 30 THEN '25_29' ELSE '30_plus' END AS first_birth_bin,
CASE WHEN biopsies >= 3 THEN '3_plus' ELSE CAST(biopsies AS VARCHAR) END AS biopsy_bin, count(*) AS cnt FROM (""" + _PATIENT + ") GROUP BY 1, 2, 3")
def clinical_bins(spark, sf_dir):
    c = F.col
    return patients(spark, sf_dir).groupBy(clinical.age_group(c("age")).alias("age_group"), clinical.first_birth_bin(c("first_birth")).alias("first_birth_bin"), clinical.biopsy_bin(c("biopsies")).alias("biopsy_bin")).agg(F.count("*").alias("cnt"))


# ---- similarity, tests, rules, outliers


@query(f"""WITH g AS (SELECT DISTINCT p_name, unnest(list_transform(range(1, greatest(length(p_name) - 2, 1) + 1), lambda i: substr(p_name, CAST(i AS INTEGER), 3))) AS gram FROM part),
r AS (SELECT DISTINCT gram FROM g WHERE p_name = 'red widget'), r0 AS (SELECT unnest(['red', 'ed ', 'd w', ' wi', 'wid', 'idg', 'dge', 'get']) AS gram)
SELECT p_name, {_R("count(r0.gram) / (count(*) + 8 - count(r0.gram))::DOUBLE")} AS similarity FROM g LEFT JOIN r0 ON g.gram = r0.gram GROUP BY p_name""")
def ngram_similarity(spark, sf_dir):
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    return rounded(names.select("p_name", strings.ngram_similarity(F.col("p_name"), F.lit("red widget")).alias("similarity")))


@query("SELECT c_custkey, sha256('key:' || lower(c_mktsegment)) AS token FROM customer")
def token_match(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", strings.token_hash("key", F.col("c_mktsegment")).alias("token"))


@query(f"""WITH {RISK_SQL}, o AS (SELECT * FROM marg WHERE n_pos + n_neg > 0), c AS (SELECT feature, n_pos, n_neg, (n_pos + n_neg) * (SELECT p FROM tot) / (SELECT p + n FROM tot)::DOUBLE AS ep, (n_pos + n_neg) * (SELECT n FROM tot) / (SELECT p + n FROM tot)::DOUBLE AS en FROM o)
SELECT feature, {_R("sum((n_pos - ep) * (n_pos - ep) / ep + (n_neg - en) * (n_neg - en) / en)", 4)} AS chi2, count(*) - 1 AS dof FROM c GROUP BY feature""")
def chi_square(spark, sf_dir):
    return rounded(analysis.chi_square(train_marginals(spark, sf_dir)), 4)


@query(model_sql.fisher(RISK_SQL))
def fisher_tests(spark, sf_dir):
    return rounded(analysis.fisher_tests(train_marginals(spark, sf_dir)))


@query(f"""WITH {RISK_SQL}, pairs AS ({_PAIRS}) SELECT * FROM (SELECT q.fa, q.va, q.fb, q.vb, {_R("q.cnt / (t.p + t.n)::DOUBLE")} AS support, {_R("q.cnt / (a.n_pos + a.n_neg)::DOUBLE")} AS confidence,
{_R("q.cnt * (t.p + t.n)::DOUBLE / ((a.n_pos + a.n_neg) * (b.n_pos + b.n_neg)::DOUBLE)")} AS lift, q.cnt / (t.p + t.n)::DOUBLE AS s0, q.cnt / (a.n_pos + a.n_neg)::DOUBLE AS c0
FROM pairs q JOIN marg a ON q.fa = a.feature AND q.va = a.value JOIN marg b ON q.fb = b.feature AND q.vb = b.value CROSS JOIN tot t) WHERE s0 >= 0.01 AND c0 >= 0.1""".replace("SELECT * FROM (SELECT q.fa", "SELECT fa, va, fb, vb, support, confidence, lift FROM (SELECT q.fa"))
def assoc_rules(spark, sf_dir):
    return rounded(from_cube(spark, sf_dir, lambda c, p, n: analysis.association_rules(counts.pairwise(c, RISK), counts.marginals_of_cube(c, RISK), p + n)))


@query(f"""SELECT event_id, event_type, {_R("(value - m) / nullif(d, 0)")} AS z, coalesce(abs((value - m) / nullif(d, 0)) > 3, false) AS outlier
FROM events JOIN (SELECT event_type AS et, avg(value) AS m, stddev_pop(value) AS d FROM events GROUP BY 1) ON event_type = et""")
def anomaly_zscore(spark, sf_dir):
    return rounded(analysis.z_scores(read(spark, sf_dir, "events"), "value", ["event_type"]).select("event_id", "event_type", "z", "outlier"))


@query(model_sql.discriminant(RISK_SQL, KEYS, RISK.numeric))
def discriminant_scores(spark, sf_dir):
    view = risk_view(spark, sf_dir)
    return scores(analysis.Discriminant.fit(train_of(view), list(RISK.numeric)).transform(test_of(view)))


@query(model_sql.principal_components("lineitem", ["l_quantity", "l_discount", "l_tax"]))
def principal_components(spark, sf_dir):
    values, parts = analysis.principal_components(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], 3)
    return rounded(spark.createDataFrame([(i, float(v), *map(float, p)) for i, (v, p) in enumerate(zip(values, parts))], "component int, variance double, w0 double, w1 double, w2 double"), 4)


_MODES = [{f: vs[i % len(vs)] for f, vs in RISK.domains.items()} for i in range(3)]


@query(model_sql.k_modes(RISK_SQL, RISK, _MODES))
def k_modes_clusters(spark, sf_dir):
    def sizes(cube: DataFrame, p: int, n: int) -> DataFrame:
        _, cluster = analysis.k_modes(cube, RISK, _MODES)
        return cube.groupBy(cluster.alias("cluster")).agg(F.sum(F.col("n_pos") + F.col("n_neg")).alias("cnt"))

    return from_cube(spark, sf_dir, sizes)


# ---- generators, noise and scaling


NOISE, _NOISE_KEYS = 0.05, [*KEYS, "risk_level", "priority"]
_NOISY = datagen.picked_sql(_NOISE_KEYS, NOISE, "noise")


@query(f"WITH {RISK_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN {_NOISY} THEN CASE WHEN y = 1 THEN 'n' ELSE 'r' END ELSE flag END AS flag, y, {_NOISY} AS noisy FROM labelled")
def noisy_label_flip(spark, sf_dir):
    """All lines; one in twenty, by a digest of its fields, bears the flag that is typical of the other class."""
    noisy = datagen.picked(_NOISE_KEYS, NOISE, "noise")
    return risk_view(spark, sf_dir).select(*KEYS, F.when(noisy, F.when(F.col("y") == 1, "n").otherwise("r")).otherwise(F.col("flag")).alias("flag"), "y", noisy.alias("noisy"))


_SIZED = ["lineitem", "orders", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count, {_R('71.0 * pow(count(*) / 370000.0::DOUBLE, 0.794935661)', 3)} AS seconds FROM {t}" for t in _SIZED))
def scaling_law(spark, sf_dir):
    """How long a fit of 71 seconds over 370,000 rows takes by the doubling law on tables of these sizes."""
    sizes = [read(spark, sf_dir, t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table"), "row_count") for t in _SIZED]
    rows = sizes[0].union(sizes[1]).union(sizes[2])
    return rounded(rows.withColumn("seconds", power_law(71.0, 370_000, F.col("row_count"), DOUBLING)), 3)


def _drawn(spark, sf_dir, noisy: bool = False) -> DataFrame:
    return datagen.fraud_of(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), noisy=noisy)


_DRAWN = "SELECT o_orderkey AS id FROM orders"


@query(f"SELECT fraud_type, CAST(risk_level >= 50 AS INTEGER) AS y, account_jurisdiction, count(*) AS cnt, sum(risk_level)::BIGINT AS levels FROM ({datagen.fraud_sql(_DRAWN)}) GROUP BY 1, 2, 3")
def generate_fraud(spark, sf_dir):
    """A record for each order, summed by type, class and jurisdiction."""
    df = _drawn(spark, sf_dir)
    return df.groupBy("fraud_type", (F.col("risk_level") >= 50).cast("int").alias("y"), "account_jurisdiction").agg(F.count("*").alias("cnt"), F.sum("risk_level").alias("levels"))


@query(f"SELECT fraud_type, CAST(risk_level >= 50 AS INTEGER) AS y, count(*) AS cnt FROM ({datagen.fraud_sql(_DRAWN, noisy=True)}) GROUP BY 1, 2")
def generate_fraud_noisy(spark, sf_dir):
    df = _drawn(spark, sf_dir, noisy=True)
    return df.groupBy("fraud_type", (F.col("risk_level") >= 50).cast("int").alias("y")).agg(F.count("*").alias("cnt"))


_SHARES = lambda table: {k: v[0] for k, v in table.items()}


@query(f"""SELECT {datagen.choice_sql(datagen.draw_sql(42, "age"), _SHARES(datagen.AGES))} AS age_group, {datagen.choice_sql(datagen.draw_sql(42, "race"), datagen.RACES)} AS race_ethnicity,
{datagen.choice_sql(datagen.draw_sql(42, "density"), datagen.DENSITY)} AS breast_density, count(*) AS cnt FROM (SELECT c_custkey AS id FROM customer) GROUP BY 1, 2, 3""")
def generate_screening(spark, sf_dir):
    """A record for each customer, summed by three of its drawn fields."""
    df = datagen.screening_of(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))
    return df.groupBy("age_group", "race_ethnicity", "breast_density").agg(F.count("*").alias("cnt"))


@query(" UNION ALL ".join(f"SELECT '{f.name}' AS field, count(*) FILTER (WHERE \"{f.name}\" IS NULL) AS n_missing, "
    + (f"count(*) FILTER (WHERE NOT (\"{f.name}\" BETWEEN {records.FRAUD_BOUNDS[f.name][0]} AND {records.FRAUD_BOUNDS[f.name][1]}))" if f.name in records.FRAUD_BOUNDS else "0::BIGINT") + " AS n_out_of_bounds FROM drawn" for f in records.FRAUD).join([f"WITH drawn AS (SELECT *, 'IBAN' AS reported_iban FROM ({datagen.fraud_sql(_DRAWN)})) ", ""]))
def validate_records(spark, sf_dir):
    return records.violations(_drawn(spark, sf_dir), records.FRAUD, records.FRAUD_BOUNDS)


_LINE_BOUNDS = {"l_quantity": (1, 40), "l_discount": (0, 0.05), "l_tax": (0, 1)}


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, " + (f"count(*) FILTER (WHERE NOT ({c} BETWEEN {_LINE_BOUNDS[c][0]} AND {_LINE_BOUNDS[c][1]}))" if c in _LINE_BOUNDS else "0::BIGINT") + " AS n_out_of_bounds FROM lineitem"
    for c in ("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
))
def validate_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return records.violations(lines, lines.schema, _LINE_BOUNDS)


@query("SELECT o_orderpriority, count(*) AS n, " + _R("avg(CAST(o_orderstatus = 'F' AS DOUBLE))") + " AS share_pos FROM orders GROUP BY 1")
def batch_distribution(spark, sf_dir):
    df = read(spark, sf_dir, "orders").withColumn("done", F.col("o_orderstatus") == "F")
    return rounded(records.batch_distribution(df, "o_orderpriority", "done"))


@query("SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 >= 50 AS INTEGER) AS is_high_risk FROM orders")
def derived_label(spark, sf_dir):
    df = read(spark, sf_dir, "orders").withColumn("risk_level", F.pmod(F.floor("o_totalprice").cast("long"), F.lit(101)))
    return records.derive_label(df).select("o_orderkey", "is_high_risk")


# ---- streams


def _events(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT event_type AS value, 'event_type' AS feature, count(*) FILTER (WHERE value >= 10) AS n_pos, count(*) FILTER (WHERE value < 10) AS n_neg FROM events GROUP BY 1")
def stream_marginals(spark, sf_dir):
    spec = DatasetSpec({"event_type": ["click", "error", "purchase", "signup", "view"]})
    stream = _events(spark, sf_dir).withColumn("y", (F.col("value") >= 10).cast("int"))
    return _drained(spark, streams.marginal_stream(stream, spec))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    timed = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    found = _drained(spark, streams.windowed_counts(timed, "ts", ["event_type"]))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _drained(spark, counted: DataFrame) -> DataFrame:
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    return streams.settle(counted, f"{at}/table", f"{at}/checkpoint")


# ---- baselines and reports


def _baseline(kind: str) -> Query:
    def run(spark, sf_dir):
        view = risk_view(spark, sf_dir).select(*KEYS, "y", *FEATURES)
        model = baselines.fit(kind, train_of(view), RISK)
        return rounded(baselines.transform(model, test_of(view), RISK).select(*KEYS, *([] if kind == "svm" else ["risk"]), "pred"))

    run.__name__ = f"baseline_{kind}"
    return run


for _kind in ("tree", "logistic", "svm"):
    query()(_baseline(_kind))


@query(f"WITH {NB_SQL} SELECT CAST(y AS INTEGER) AS actual, pred AS predicted, count(*) AS n FROM nb GROUP BY 1, 2")
def confusion_cells(spark, sf_dir):
    return report.confusion_cells(nb_counted(spark, sf_dir), weight="n")


@query(f"WITH {NB_SQL}, sd AS (SELECT l_orderkey, l_linenumber, {_R('risk')} AS risk FROM nb), dc AS (SELECT *, CASE WHEN risk >= 0.5 THEN 'DENY' ELSE 'APPROVE' END AS decision FROM sd) SELECT * FROM dc QUALIFY row_number() OVER (PARTITION BY decision ORDER BY l_orderkey, l_linenumber, risk) <= 5")
def decisions(spark, sf_dir):
    return report.decisions(rounded(nb_scored(spark, sf_dir).select(*KEYS, "risk")), KEYS, order=[*KEYS, "risk"])


_VALIDATED = f"""WITH {_HIST_SQL}, hv AS (SELECT x.l_orderkey, x.l_linenumber, x.y, ({" + ".join(f"w{i}.weight * h{i}.bucket_risk" for i in range(len(FEATURES)))}) / ({" + ".join(f"w{i}.weight" for i in range(len(FEATURES)))}) AS risk
FROM test x {" ".join(f"JOIN hb h{i} ON h{i}.feature = '{f}' AND h{i}.value = x.{chr(34)}{f}{chr(34)} JOIN hw w{i} ON w{i}.feature = '{f}'" for i, f in enumerate(FEATURES))}),
one AS (SELECT *, CAST(risk >= (SELECT r FROM prior) AS INTEGER) AS pred, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY y, risk) AS nth FROM hv),
other AS (SELECT *, CAST(risk >= 0.5 AS INTEGER) AS pred, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY y, risk) AS nth FROM hv)
SELECT count(*) AS n, {_R("avg((a.pred = b.pred)::INTEGER)")} AS agreement, {_R("avg((a.pred = a.y)::INTEGER)")} AS accuracy_a, {_R("avg((b.pred = a.y)::INTEGER)")} AS accuracy_b
FROM one a JOIN other b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.nth = b.nth"""


@query(_VALIDATED)
def model_validation(spark, sf_dir):
    """Two cuts of one model on every held-out row; rows that share their keys pair by the order of label and risk."""
    with held(train_cube(spark, sf_dir)) as cube:
        model = histogram.HistogramClassifier.fit(counts.marginals_of_cube(cube, RISK), RISK, *totals(cube))
    scored = model.transform(test_of(risk_view(spark, sf_dir))).select(*KEYS, "y", "risk", "pred")
    return rounded(report.validation(scored, scored.withColumn("pred", (F.col("risk") >= 0.5).cast("int")), KEYS, order=["y", "risk"]))


@query("""WITH names AS (SELECT DISTINCT p_name AS s FROM part WHERE p_name IS NOT NULL), pairs AS (SELECT a.s AS a, b.s AS b, levenshtein(a.s, b.s) AS distance FROM names a JOIN names b ON a.s <> b.s)
SELECT a, b, CAST(distance AS INTEGER) AS distance, CAST(row_number() OVER (PARTITION BY a ORDER BY distance, b) AS INTEGER) AS nth FROM pairs WHERE distance <= 6 QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, b) <= 5""")
def string_neighbours(spark, sf_dir):
    """For each part name, its five nearest other names, at most six edits apart."""
    part = read(spark, sf_dir, "part")
    return neighbours.nearest(part, part, "p_name", k=5, most=6)


@query("""WITH urls AS (SELECT DISTINCT regexp_replace(url, '[?#].*', '') AS s FROM pages WHERE url IS NOT NULL), pairs AS (SELECT a.s AS a, b.s AS b, levenshtein(a.s, b.s) AS distance FROM urls a JOIN urls b ON a.s <> b.s)
SELECT a, b, CAST(distance AS INTEGER) AS distance, CAST(row_number() OVER (PARTITION BY a ORDER BY distance, b) AS INTEGER) AS nth FROM pairs WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, b) <= 3""")
def url_neighbours(spark, sf_dir):
    """For each page address, its three nearest other ones, at most three edits apart."""
    urls = read(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?#].*", "").alias("s"))
    return neighbours.nearest(urls, urls, "s", k=3, most=3)


def queries() -> dict[str, Query]:
    from countspark.plans import fraud, screening, tables  # noqa: F401  (these register their queries)

    return dict(_TABLES)


def oracle_sql() -> dict[str, str]:
    from countspark.plans import fraud, screening, tables  # noqa: F401

    return dict(_SQL)
