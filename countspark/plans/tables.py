"""Registered queries over sources, reports and single operators: batch ingest, appends, ordered loads, samples, tables of metrics, entropies, regions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from countspark.functions.math import entropy
from countspark.functions.scorers import score_batches
from countspark.operators import counts, metrics, report
from countspark.operators.models import naive_bayes, trees
from countspark.plans import fraud, screening
from countspark.plans import queries as q
from countspark.plans.spec import RISK, test_of, train_of
from countspark.sources import records, scan
from countspark.sources.scratch import shared_folder
from countspark.streaming import ingest


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# ---- sources

_DAY = "CAST(CAST(ts AS DATE) AS VARCHAR)"


@q.query(f"SELECT {_DAY} AS day, event_type, count(*) AS n, {q._R('sum(value)', 4)} AS total, 1::BIGINT AS n_batches FROM events GROUP BY 1, 2")
def ingest_batches(spark, sf_dir):
    """Events as files of a day each, taken in by micro-batches with a ledger: every day's rows are there once, from one batch."""
    at = _folder(spark)
    events = q.read(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string")).select("day", "event_id", "event_type", "value")
    events.repartition("day").write.partitionBy("day").parquet(f"{at}/in")
    schema = events.select("event_id", "event_type", "value", "day").schema
    ingest.ingest(ingest.files(spark, f"{at}/in", schema, "parquet", at_once=10), f"{at}/rows", f"{at}/ledger", f"{at}/checkpoint")
    whole = ingest.complete(spark, f"{at}/rows", f"{at}/ledger", schema)
    batches = F.count_distinct("batch").alias("n_batches")
    by_day = whole.groupBy("day").agg(batches)
    found = whole.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).join(by_day, "day")
    return q.rounded(found.select("day", "event_type", "n", "total", "n_batches"), 4)


@q.query("SELECT o_orderstatus, count(*) AS n, count(*) AS n_ids FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 UNION ALL SELECT 'all', count(*), count(*) FROM orders WHERE o_orderstatus IN ('F', 'O')")
def appended_orders(spark, sf_dir):
    """Two appends to one table: ids go on where the first one ended, and none is given twice."""
    at = _folder(spark)
    orders = q.read(spark, sf_dir, "orders").select(F.lit("").alias("id"), "o_orderkey", "o_orderstatus")
    for status in ("F", "O"):
        records.append(orders.filter(F.col("o_orderstatus") == status), at, "id")
    stored = spark.read.parquet(at)
    size = lambda df: df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))
    return size(stored.groupBy("o_orderstatus")).unionByName(size(stored).select(F.lit("all").alias("o_orderstatus"), "n", "n_ids"))


@q.query("SELECT o_orderkey, CAST(floor(o_totalprice) AS INTEGER) % 101 AS risk_level, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 >= 50 AS INTEGER) AS is_high_risk, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def ordered_records(spark, sf_dir):
    """Every order as a labelled record with its place by id."""
    level = F.pmod(F.floor("o_totalprice").cast("long"), F.lit(101)).cast("string")
    orders = q.read(spark, sf_dir, "orders").select("o_orderkey", level.alias("risk_level"))
    return records.in_order(orders, "o_orderkey", whole=["risk_level"]).select("o_orderkey", "risk_level", "is_high_risk", "place")


@q.query("SELECT o_custkey, o_totalprice, CAST(o_orderstatus = 'F' AS INTEGER) AS is_fraud FROM orders")
def loaded_records(spark, sf_dir):
    orders = q.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), "o_custkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("is_fraud"))
    return records.load_labelled(orders)


_SAMPLED = "SELECT '{0}' AS sample, o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = '{0}' ORDER BY md5(concat('42:', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT {1})"


@q.query(f"{_SAMPLED.format('F', 40)} UNION ALL {_SAMPLED.format('O', 60)}")
def two_samples(spark, sf_dir):
    """Seeded samples of two classes, one after the other."""
    orders = q.read(spark, sf_dir, "orders")
    some = lambda s, n: scan.sample(orders.filter(F.col("o_orderstatus") == s), n, ["o_orderkey"]).select(F.lit(s).alias("sample"), "o_orderkey")
    return some("F", 40).unionByName(some("O", 60))


# ---- a user's scorer, Gaussian features, entropy, regions

_RISK_OF = "round(1 / (1 + exp(-(0.11 * l_quantity - 2.2 + 9.0 * l_discount))), 9)"


@q.query(q.confusion_sql(f"(SELECT {_RISK_OF} AS risk, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)", "risk >= 0.6"))
def user_scorer_metrics(spark, sf_dir):
    """The confusion of a user's Python function, which gets batches of two columns of all lines."""
    import numpy as np

    lines = q.read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    scored = score_batches(lines, lambda t: (1 / (1 + np.exp(-(0.11 * t.l_quantity - 2.2 + 9.0 * t.l_discount)))).round(9), ["l_quantity", "l_discount"])
    return q.rounded(metrics.evaluate_with(scored, F.col("risk"), threshold=0.6))


_LINES = "lines AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem), train AS (SELECT * FROM lines WHERE l_orderkey % 5 <> 0), test AS (SELECT * FROM lines WHERE l_orderkey % 5 = 0)"
_MEASURES = ("l_discount", "l_extendedprice", "l_quantity")
_LINE_SUMS = " UNION ALL ".join(f"SELECT '{f}' AS feature, y AS cls, count(*)::DOUBLE AS n, sum({f})::DOUBLE AS total, sum({f} * {f})::DOUBLE AS total_sq FROM train GROUP BY y" for f in _MEASURES)


@q.query(fraud.gaussian_sql(_LINES, _LINE_SUMS, _MEASURES, "l_orderkey, l_linenumber", "SELECT count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM train"))
def gnb_continuous_scores(spark, sf_dir):
    """The Gaussian model over measurements as they are, without bins."""
    lines = q.read(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    model = naive_bayes.GaussianNaiveBayes.fit(counts.gaussian_stats(train_of(lines), list(_MEASURES)))
    return q.scores(model.transform(test_of(lines)))


def _entropy_sql(p: str, n: str) -> str:
    share = lambda c: f"(({c}) / ({p} + {n})::DOUBLE)"
    return f"CASE WHEN {p} > 0 AND {n} > 0 THEN -({share(p)} * log2({share(p)}) + {share(n)} * log2({share(n)})) ELSE 0 END"


@q.query(f"WITH {q.RISK_SQL} SELECT feature, value, {q._R(_entropy_sql('n_pos', 'n_neg'), 9)} AS bits FROM marg")
def value_entropy(spark, sf_dir):
    """How uncertain the class is among the rows of each value, in bits."""
    return q.rounded(q.from_cube(spark, sf_dir, lambda c, p, n: counts.marginals_of_cube(c, RISK).select("feature", "value", entropy(F.col("n_pos"), F.col("n_neg")).alias("bits"))), 9)


_PART = "({0} + {1}) / (t.p + t.n)::DOUBLE"
_ENTROPY_GAIN = f"{_entropy_sql('t.p', 't.n')} - ({_PART.format('n_pos', 'n_neg')} * {_entropy_sql('n_pos', 'n_neg')} + {_PART.format('(t.p - n_pos)', '(t.n - n_neg)')} * {_entropy_sql('(t.p - n_pos)', '(t.n - n_neg)')})"


@q.query(f"WITH {q.RISK_SQL} SELECT feature, value, CAST(col_idx AS INTEGER) AS col_idx, {q._R(_ENTROPY_GAIN, 9)} AS gain FROM marg CROSS JOIN tot t WHERE n_pos + n_neg > 0 AND n_pos + n_neg < t.p + t.n")
def tree_root_gains_entropy(spark, sf_dir):
    """What each split of all rows gains by the entropy criterion."""

    def gains(cube, p, n):
        total = spark.createDataFrame([(0, p, n)], "node long, node_pos long, node_neg long")
        candidates = RISK.domain_table(spark).withColumn("node", F.lit(0).cast("long"))
        return trees.split_gains(counts.level_histogram(cube, RISK), total, candidates, criterion="entropy")

    return q.rounded(q.from_cube(spark, sf_dir, gains).select("feature", "value", "col_idx", "gain"), 9)


_ENTROPY_ROOT = f"(SELECT feature, value FROM marg CROSS JOIN tot t WHERE n_pos + n_neg > 0 AND n_pos + n_neg < t.p + t.n ORDER BY round({_ENTROPY_GAIN}, 12) DESC, col_idx LIMIT 1)"


@q.query(f"WITH {q.RISK_SQL}, side AS (SELECT x.l_orderkey, x.l_linenumber, x.y, 'train' AS fold, {{0}} AS onleft FROM train x CROSS JOIN {_ENTROPY_ROOT} r UNION ALL SELECT x.l_orderkey, x.l_linenumber, x.y, 'test', {{0}} FROM test x CROSS JOIN {_ENTROPY_ROOT} r), leaf AS (SELECT onleft, avg(y) AS risk FROM side WHERE fold = 'train' GROUP BY 1) SELECT l_orderkey, l_linenumber, {q._R('risk')} AS risk, CAST(risk >= 0.5 AS INTEGER) AS pred FROM side JOIN leaf USING (onleft) WHERE fold = 'test'".replace("{0}", "CASE r.feature " + " ".join(f"WHEN '{f}' THEN x.\"{f}\"" for f in RISK.features) + " END = r.value"))
def entropy_stump_scores(spark, sf_dir):
    """A tree of one split by the entropy criterion."""
    return q.scores(q._fit_and_score(spark, sf_dir, lambda c: trees.decision_tree(c, RISK, *q.totals(c), max_depth=1, criterion="entropy")))


_STUMPS = [trees.Stump("flag", "r", 1, 0.8, 0.2, 0, 0, 0, 0), trees.Stump("status", "f", 0, 0.3, 0.4, 0, 0, 0, 0)]
_SIGNS = "(CASE WHEN flag = 'r' THEN 0.8 ELSE -0.8 END)::DOUBLE + (CASE WHEN status = 'f' THEN -0.3 ELSE 0.3 END)::DOUBLE"


@q.query(f"WITH {q.RISK_SQL}, reg AS (SELECT concat_ws(',', CASE WHEN flag = 'r' THEN '1' ELSE '0' END, CASE WHEN status = 'f' THEN '0' ELSE '1' END) AS region, exp(CASE WHEN y = 1 THEN -1 ELSE 1 END * ({_SIGNS})) AS w FROM train) SELECT region, {q._R('sum(w)', 4)} AS weight FROM reg GROUP BY 1 QUALIFY row_number() OVER (ORDER BY round(sum(w), 12) DESC, region DESC) <= 2")
def heaviest_regions(spark, sf_dir):
    """Of the regions that two stumps part the rows into, the two that boosting would weigh most."""
    model = trees.AdaBoost(_STUMPS)

    def found(cube, p, n):
        kept = cube.filter(trees.heaviest_regions(cube, _STUMPS, model.score(), 2))
        region = F.concat_ws(",", *[F.when(s.sign() > 0, "1").otherwise("0") for s in _STUMPS])
        return kept.groupBy(region.alias("region")).agg(F.sum(F.col("n_pos") * F.exp(-model.score()) + F.col("n_neg") * F.exp(model.score())).alias("weight"))

    return q.rounded(q.from_cube(spark, sf_dir, found), 4)


# ---- tables

_MEASURED = ["sens", "spec", "ppv", "f1", "flagged", "acc"]
_MODELS = ["linear", "naive_bayes", "tree"]
_LONG = f"(UNPIVOT ({screening._COMPARED}) ON {', '.join(_MEASURED)} INTO NAME metric VALUE value)"
_WIDE = ", ".join(f"max(value) FILTER (WHERE model = '{m}') AS {m}" for m in _MODELS)


@q.query(f"""SELECT k, metric, linear, naive_bayes, tree, {q._R("greatest(abs(naive_bayes - linear), abs(tree - linear))")} AS delta,
array_to_string(list_filter([CASE WHEN linear = greatest(linear, naive_bayes, tree) THEN 'linear' END, CASE WHEN naive_bayes = greatest(linear, naive_bayes, tree) THEN 'naive_bayes' END, CASE WHEN tree = greatest(linear, naive_bayes, tree) THEN 'tree' END], lambda x: x IS NOT NULL), ',') AS best
FROM (SELECT k, metric, {_WIDE} FROM {_LONG} GROUP BY 1, 2)""")
def screening_side_by_side(spark, sf_dir):
    """The referrals of three models as a table of metrics, with and without suppression."""
    return q.rounded(report.side_by_side(screening.screening_comparison(spark, sf_dir), _MEASURED, by=["k"]))


_IMPORTANCE = lambda k: f"(WITH {screening._sql(k)}, spread AS (SELECT feature, max(lik_pos) - min(lik_pos) AS s FROM lik GROUP BY 1) SELECT feature, s / (SELECT max(s) FROM spread) AS i FROM spread)"


@q.query(f"SELECT a.feature, {q._R('a.i')} AS a, {q._R('b.i')} AS b, abs(a.i - b.i) < 0.15 AS \"match\" FROM {_IMPORTANCE(0)} a JOIN {_IMPORTANCE(screening.K)} b ON a.feature = b.feature")
def screening_importance_match(spark, sf_dir):
    """Whether features matter alike with and without suppression."""
    train = screening.fitted(screening.patients(spark, sf_dir))
    found = [spark.createDataFrame(screening.screening_nb(train, k).importance(), "feature string, importance double") for k in (0, screening.K)]
    return q.rounded(report.importance_match(*found))


@q.query(" UNION ALL ".join(f"SELECT * FROM (WITH {screening._sql(0)} SELECT '{s}' AS split, count(*) AS n, sum(y)::BIGINT AS n_pos, {q._R('avg(y)')} AS share_pos, {len(screening.SCREENING.features)} AS n_features, {' + '.join(f'count(DISTINCT {f})' for f in screening.SCREENING.features)} AS n_values FROM {s})" for s in ("train", "test")))
def screening_training_summary(spark, sf_dir):
    view = screening.patients(spark, sf_dir)
    return q.rounded(report.training_summary({"train": screening.fitted(view), "test": screening.held_out(view)}, screening.SCREENING.features))
