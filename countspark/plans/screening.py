"""The screening application: what its models see of a table, and the queries that run them under suppression.

Models are fitted from counts that are suppressed first; class totals never are. The queries read patients derived from customers, so that each has its SQL.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countspark.functions import clinical
from countspark.functions.math import recalibrate
from countspark.operators import counts, metrics, suppress
from countspark.operators.models import histogram, linear, naive_bayes, trees
from countspark.plans import fraud, model_sql
from countspark.plans import queries as q
from countspark.plans.spec import DatasetSpec
from countspark.sources import scan

#: The features of the screening models in order, their domains, parents and reference categories.
SCREENING = DatasetSpec(
    domains={
        "age_group": ["40_49", "50_59", "60_69", "70_74"],
        "race": ["white", "black", "hispanic", "asian_pi", "other"],
        "relatives": ["0", "1", "2", "3", "4", "5"],
        "biopsies": ["0", "1", "2", "3_plus"],
        "atypical": ["yes", "no", "unknown"],
        "menarche": ["under_12", "12_13", "14_plus"],
        "density": ["1", "2", "3", "4"],
        "afb": ["nulliparous", "under_20", "20_24", "25_29", "30_plus"],
    },
    numeric=("age", "age_at_menarche", "age_at_first_birth", "num_first_degree_relatives", "num_prior_biopsies", "breast_density"),
    parents={"atypical": ("biopsies",), "density": ("age_group",), "afb": ("age_group",)},
)
REFERENCE = {"age_group": "40_49", "race": "white", "relatives": "0", "biopsies": "0", "atypical": "no", "menarche": "14_plus", "density": "1", "afb": "nulliparous"}
POPULATION_RATE, REFER_AT, K = 0.016, 0.0167, suppress.MIN_CELL


def prepare_screening(records: DataFrame) -> DataFrame:
    """Screening records with the features that SCREENING names, the label as y, and all their own columns."""
    c = F.col
    text = lambda name: F.lower(c(name).cast("string"))
    return records.withColumns(
        {
            "race": text("race_ethnicity"), "relatives": text("num_first_degree_relatives"), "biopsies": clinical.biopsy_bin(c("num_prior_biopsies")), "atypical": text("atypical_hyperplasia"),
            "menarche": text("menarche_category"), "density": text("breast_density"), "afb": clinical.first_birth_bin(c("age_at_first_birth")), "y": c("cancer_5yr").cast("int"),
        }
    )


def numeric_value_counts(df: DataFrame, numeric: list[str] | tuple[str, ...], label: str = "y") -> DataFrame:
    """(feature, value, n_pos, n_neg): the counts of each value of numeric columns; one that is null or no number is an error."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.raise_error(F.lit(f"{c} must be a number in every row")).cast("double")).alias(c)
    tall = df.select(label, *[number(c) for c in numeric]).unpivot([label], list(numeric), "feature", "value")
    return tall.groupBy("feature", "value").agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))


def sums_of_counts(value_counts: DataFrame) -> DataFrame:
    """(feature, cls, n, total, total_sq) from counts of values, which may have been suppressed."""
    tall = value_counts.select("feature", "value", F.explode(F.array(F.struct(F.lit(1).alias("cls"), F.col("n_pos").alias("cnt")), F.struct(F.lit(0).alias("cls"), F.col("n_neg").alias("cnt")))).alias("x")).select("feature", "value", "x.*")
    return tall.groupBy("feature", "cls").agg(F.sum("cnt").alias("n"), F.sum(F.col("value") * F.col("cnt")).alias("total"), F.sum(F.col("value") * F.col("value") * F.col("cnt")).alias("total_sq"))


def zero_filled_pairs(pairs: DataFrame, spec: DatasetSpec) -> DataFrame:
    """pairwise() with a row for every pair of values of the domains, the unseen ones zero; as many rows as the domains make."""
    cells = [(a, v, b, w) for a, b in combinations(spec.features, 2) for v in spec.domains[a] for w in spec.domains[b]]
    every = pairs.sparkSession.createDataFrame(cells, "fa string, va string, fb string, vb string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(pairs, ["fa", "va", "fb", "vb"], "left").select("fa", "va", "fb", "vb", zero("cnt"), zero("n_pos"))


# ---- patients derived from customers, and their SQL

_FEATURES_SQL = f"""SELECT c_custkey, {q._AGE.format("'40_49'", "'50_59'", "'60_69'", "'70_74'")} AS age_group, race, CAST(relatives AS VARCHAR) AS relatives,
CASE WHEN biopsies >= 3 THEN '3_plus' ELSE CAST(biopsies AS VARCHAR) END AS biopsies, atypical,
CASE WHEN menarche_age < 12 THEN 'under_12' WHEN menarche_age <= 13 THEN '12_13' ELSE '14_plus' END AS menarche, CAST(density AS VARCHAR) AS density,
CASE WHEN first_birth = 0 THEN 'nulliparous' WHEN first_birth < 20 THEN 'under_20' WHEN first_birth < 25 THEN '20_24' WHEN first_birth < 30 THEN '25_29' ELSE '30_plus' END AS afb,
age, menarche_age AS age_at_menarche, first_birth AS age_at_first_birth, relatives AS num_first_degree_relatives, biopsies AS num_prior_biopsies, density AS breast_density,
CAST((c_custkey * 37) % 100 < 4 * density + 8 * relatives AS INTEGER) AS y FROM ({q._PATIENT})"""


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = q.patients(spark, sf_dir).withColumnsRenamed({"menarche_age": "age_at_menarche", "first_birth": "age_at_first_birth", "relatives": "num_first_degree_relatives", "biopsies": "num_prior_biopsies", "density": "breast_density", "race": "race_ethnicity", "atypical": "atypical_hyperplasia"})
    c = F.col
    label = (F.pmod(c("c_custkey") * 37, F.lit(100)) < 4 * c("breast_density") + 8 * c("num_first_degree_relatives")).cast("int")
    return prepare_screening(named.withColumns({"age_group": clinical.age_group(c("age")), "menarche_category": clinical.menarche_category(c("age_at_menarche")), "cancer_5yr": label}))


def fitted(df: DataFrame) -> DataFrame:
    return df.filter(F.pmod("c_custkey", F.lit(5)) != 0)


def held_out(df: DataFrame) -> DataFrame:
    return df.filter(F.pmod("c_custkey", F.lit(5)) == 0)


_TALL = ", ".join(SCREENING.features)
_K = lambda c, k: f"CASE WHEN {c} BETWEEN 1 AND {k - 1} THEN {suppress.midpoint(k)} ELSE {c} END" if k > 1 else c


def _sql(k: int) -> str:
    return f"""pat AS ({_FEATURES_SQL}), train AS (SELECT * FROM pat WHERE c_custkey % 5 <> 0), test AS (SELECT * FROM pat WHERE c_custkey % 5 = 0),
dom AS (SELECT * FROM (VALUES {", ".join(f"('{f}', '{v}', {i})" for f, v, i in SCREENING.candidates())}) AS t(feature, value, col_idx)),
tall AS (UNPIVOT (SELECT y, {_TALL} FROM train) ON {_TALL} INTO NAME feature VALUE value),
seen AS (SELECT feature, value, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM tall GROUP BY feature, value),
plain AS (SELECT d.feature, d.value, d.col_idx, coalesce(s.p, 0) AS p, coalesce(s.n, 0) AS n FROM dom d LEFT JOIN seen s ON d.feature = s.feature AND d.value = s.value),
marg AS (SELECT feature, value, col_idx, {_K("p", k)} AS n_pos, {_K("n", k)} AS n_neg FROM plain),
tot AS (SELECT count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM train), size AS (SELECT feature, count(*) AS k FROM dom GROUP BY feature),
lik AS (SELECT m.feature, m.value, (m.n_pos + 1.0::DOUBLE) / (t.p + s.k) AS lik_pos, (m.n_neg + 1.0::DOUBLE) / (t.n + s.k) AS lik_neg FROM marg m JOIN size s ON m.feature = s.feature CROSS JOIN tot t)"""


def _nb_sql(k: int, name: str = "nb") -> str:
    joins = " ".join(f"LEFT JOIN lik l{i} ON l{i}.feature = '{f}' AND l{i}.value = x.{f}" for i, f in enumerate(SCREENING.features))
    logs = lambda side, prior: f"ln({prior}::DOUBLE + 1e-10) + " + " + ".join(f"ln(coalesce(l{i}.lik_{side}, 0.1))" for i in range(len(SCREENING.features)))
    return f"WITH {_sql(k)}, logs AS (SELECT x.c_custkey, x.y, {logs('pos', POPULATION_RATE)} AS a, {logs('neg', 1 - POPULATION_RATE)} AS b FROM test x {joins}), {name} AS (SELECT *, 1 / (1 + exp(b - a)) AS risk, CAST(a > b AS INTEGER) AS pred FROM logs)"


def screening_counts(df: DataFrame, k: int) -> tuple[DataFrame, int, int]:
    """The suppressed marginals of a training table, and its class totals, which are not."""
    p, n = counts.base_rates(df).first()
    return suppress.suppress(counts.marginals(df, SCREENING), ["n_pos", "n_neg"], k), p, n


def screening_nb(df: DataFrame, k: int, prior: float | None = POPULATION_RATE) -> naive_bayes.NaiveBayes:
    marginals, p, n = screening_counts(df, k)
    return naive_bayes.NaiveBayes.fit(marginals, SCREENING, p, n, prior)


# ---- queries

for _k in (0, K):

    @q.query(f"WITH {_sql(_k)} SELECT feature, value, CAST(col_idx AS INTEGER) AS col_idx, n_pos, n_neg FROM marg", f"screening_marginals_k{_k}")
    def _marginals(spark, sf_dir, k=_k):
        return screening_counts(fitted(patients(spark, sf_dir)), k)[0].drop("n_suppressed")

    @q.query(f"WITH {_sql(_k)} SELECT feature, value, {q._R('lik_pos', 9)} AS lik_pos, {q._R('lik_neg', 9)} AS lik_neg FROM lik", f"screening_nb_params_k{_k}")
    def _params(spark, sf_dir, k=_k):
        return q.rounded(naive_bayes.likelihoods(*_with_spec(screening_counts(fitted(patients(spark, sf_dir)), k))), 9)

    @q.query(f"{_nb_sql(_k)} SELECT c_custkey, {q._R('risk')} AS risk, pred FROM nb", f"screening_nb_scores_k{_k}")
    def _scores(spark, sf_dir, k=_k):
        view = patients(spark, sf_dir)
        return q.rounded(screening_nb(fitted(view), k).transform(held_out(view)).select("c_custkey", "risk", "pred"))

    @q.query(f"{_nb_sql(_k)} " + q.confusion_sql("nb", f"risk >= {REFER_AT}"), f"screening_referrals_k{_k}")
    def _referrals(spark, sf_dir, k=_k):
        view = patients(spark, sf_dir)
        return q.rounded(metrics.evaluate_with(screening_nb(fitted(view), k).transform(held_out(view)), F.col("risk"), threshold=REFER_AT))


def _with_spec(found: tuple[DataFrame, int, int]) -> tuple:
    return found[0], SCREENING, found[1], found[2]


_NUMBERS = ", ".join(SCREENING.numeric)
_VALUES_SQL = f"""numbers AS (UNPIVOT (SELECT y, {_NUMBERS} FROM train) ON {_NUMBERS} INTO NAME feature VALUE value),
found AS (SELECT feature, value::DOUBLE AS value, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM numbers GROUP BY 1, 2),
vals AS (SELECT feature, value, {_K('p', K)} AS n_pos, {_K('n', K)} AS n_neg FROM found)"""


@q.query(f"WITH {_sql(K)}, {_VALUES_SQL} SELECT * FROM vals")
def screening_value_counts_k11(spark, sf_dir):
    return suppress.suppress(numeric_value_counts(fitted(patients(spark, sf_dir)), SCREENING.numeric), ["n_pos", "n_neg"]).drop("n_suppressed")


@q.query(f"""WITH {_sql(K)}, {_VALUES_SQL} SELECT feature, cls, CAST(sum(c) AS BIGINT) AS n, sum(value * c) AS total, sum(value * value * c) AS total_sq
FROM (SELECT feature, value, 1 AS cls, n_pos AS c FROM vals UNION ALL SELECT feature, value, 0, n_neg FROM vals) GROUP BY 1, 2""")
def screening_gaussian_k11(spark, sf_dir):
    return sums_of_counts(screening_value_counts_k11(spark, sf_dir))


_SUMS_K = """SELECT feature, cls, sum(c)::DOUBLE AS n, sum(value * c)::DOUBLE AS total, sum(value * value * c)::DOUBLE AS total_sq
FROM (SELECT feature, value, 1 AS cls, n_pos AS c FROM vals UNION ALL SELECT feature, value, 0, n_neg FROM vals) GROUP BY 1, 2"""


@q.query(fraud.gaussian_sql(f"{_sql(K)}, {_VALUES_SQL}", _SUMS_K, SCREENING.numeric, "c_custkey", "SELECT (SELECT max(n) FROM gs WHERE cls = 1) AS p, (SELECT max(n) FROM gs WHERE cls = 0) AS n"))
def screening_gnb_scores_k11(spark, sf_dir):
    """The Gaussian model from sums over suppressed counts of values; its class totals are the largest that any feature's counts add up to."""
    model = naive_bayes.GaussianNaiveBayes.fit(screening_gaussian_k11(spark, sf_dir))
    return q.rounded(model.transform(held_out(patients(spark, sf_dir))).select("c_custkey", "risk", "pred"))


def _state_sql(f: str) -> str:
    return " || '|' || ".join(f"'{p}=' || {p}" for p in SCREENING.parents.get(f, ())) or "''"


_BN_CELLS = " UNION ALL ".join(f"SELECT '{f}' AS feature, {_state_sql(f)} AS parent_state, {f} AS value, y FROM train" for f in SCREENING.features)


@q.query(f"""WITH {_sql(K)}, found AS (SELECT feature, parent_state, value, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM ({_BN_CELLS}) GROUP BY 1, 2, 3)
SELECT feature, parent_state, value, {_K('p', K)} AS n_pos, {_K('n', K)} AS n_neg FROM found""")
def screening_cpt_k11(spark, sf_dir):
    cells = suppress.suppress(counts.cpt(fitted(patients(spark, sf_dir)), SCREENING), ["n_pos", "n_neg"]).drop("n_suppressed")
    return cells.filter("n_pos + n_neg > 0")  # the report; fits keep the empty cells


_PAIR_CELLS = " UNION ALL ".join(f"SELECT '{a}' AS fa, {a} AS va, '{b}' AS fb, {b} AS vb FROM train" for a, b in combinations(SCREENING.features, 2))


@q.query(f"""WITH {_sql(0)}, found AS (SELECT fa, va, fb, vb, count(*) AS cnt FROM ({_PAIR_CELLS}) GROUP BY 1, 2, 3, 4)
SELECT a.feature AS fa, a.value AS va, b.feature AS fb, b.value AS vb,
{q._R(f"CASE WHEN cnt BETWEEN 1 AND {K - 1} THEN (a.p + a.n) * (b.p + b.n) / (t.p + t.n)::DOUBLE ELSE coalesce(cnt, 0)::DOUBLE END")} AS cnt
FROM plain a JOIN plain b ON list_position({SCREENING.features!r}, a.feature) < list_position({SCREENING.features!r}, b.feature)
LEFT JOIN found f ON f.fa = a.feature AND f.va = a.value AND f.fb = b.feature AND f.vb = b.value CROSS JOIN tot t""")
def screening_pairs_k11(spark, sf_dir):
    cube = counts.cube(fitted(patients(spark, sf_dir)), SCREENING)
    with q.held(cube) as kept:
        p, n = q.totals(kept)
        found = suppress.independence_estimates(zero_filled_pairs(counts.pairwise(kept, SCREENING), SCREENING), counts.marginals_of_cube(kept, SCREENING), p + n)
    return q.rounded(found)  # what was held is computed again where it is gone


def _from_screening(spark: SparkSession, sf_dir: str, fit) -> DataFrame:
    view = patients(spark, sf_dir)
    with q.held(counts.cube(fitted(view), SCREENING)) as cube:
        model = fit(cube, *q.totals(cube))
    return q.rounded(model.transform(held_out(view)).select("c_custkey", "risk", "pred"))


@q.query(model_sql.forest(_sql(0), SCREENING, ["c_custkey"], [SCREENING.features], k_min=K))
def screening_tree_scores_k11(spark, sf_dir):
    return _from_screening(spark, sf_dir, lambda cube, p, n: trees.decision_tree(cube, SCREENING, p, n, k_min=K))


@q.query(model_sql.forest(_sql(0), SCREENING, ["c_custkey"], trees.feature_subsets(SCREENING.features, 7, 4, 42), k_min=K))
def screening_forest_scores_k11(spark, sf_dir):
    return _from_screening(spark, sf_dir, lambda cube, p, n: trees.random_forest(cube, SCREENING, p, n, k_min=K))


@q.query(model_sql.linear(_sql(0), SCREENING, ["c_custkey"], linear.dummies(SCREENING, REFERENCE)))
def screening_lr_scores(spark, sf_dir):
    return _from_screening(spark, sf_dir, lambda cube, p, n: linear.Logistic.fit(cube, SCREENING, p, n, reference=REFERENCE))


def _linear_sql(k: int) -> str:
    return model_sql.linear(_sql(0), SCREENING, ["c_custkey"], linear.dummies(SCREENING, REFERENCE), k=k, middle=suppress.midpoint(K))


@q.query(_linear_sql(K))
def screening_lr_scores_k11(spark, sf_dir):
    return _from_screening(spark, sf_dir, lambda cube, p, n: linear.Logistic.fit(cube, SCREENING, p, n, reference=REFERENCE, k_min=K))


def _evaluated_sql(model: str, k: int, scored: str) -> str:
    cohort = f"(SELECT avg(y) FROM ({_FEATURES_SQL}) WHERE c_custkey % 5 <> 0)"
    odds = f"(s.risk / (1 - s.risk) * ({POPULATION_RATE} / {cohort}) * ((1 - {cohort}) / {1 - POPULATION_RATE}))"
    risk = "s.risk" if model == "naive_bayes" else f"CASE WHEN s.risk <= 0 THEN 0 WHEN s.risk >= 1 THEN 1 ELSE {odds} / (1 + {odds}) END"
    rows = f"(SELECT {risk} AS risk, x.y FROM ({scored}) s JOIN ({_FEATURES_SQL}) x USING (c_custkey))"
    return f"SELECT '{model}' AS model, {k} AS k, * FROM ({q.confusion_sql(rows, f'risk >= {REFER_AT}')})"


_COMPARED = " UNION ALL ".join(
    _evaluated_sql(model, k, sql)
    for k in (0, K)
    for model, sql in (
        ("naive_bayes", f"{_nb_sql(k)} SELECT c_custkey, {q._R('risk')} AS risk FROM nb"),
        ("tree", model_sql.forest(_sql(0), SCREENING, ["c_custkey"], [SCREENING.features], k_min=k)),
        ("linear", _linear_sql(k)),
    )
)


@q.query(_COMPARED)
def screening_comparison(spark, sf_dir):
    """The referrals of three models with and without suppression, in one pass over the held-out rows; all but naive Bayes are moved to the population's rate."""
    view = patients(spark, sf_dir)
    models = {("naive_bayes", k): screening_nb(fitted(view), k) for k in (0, K)}
    with q.held(counts.cube(fitted(view), SCREENING)) as cube:
        p, n = q.totals(cube)
        for k in (0, K):
            models["tree", k] = trees.decision_tree(cube, SCREENING, p, n, k_min=k)
            models["linear", k] = linear.Logistic.fit(cube, SCREENING, p, n, reference=REFERENCE, k_min=k)
    scored, each = held_out(view).select("y", *SCREENING.features), []
    for (model, k), m in models.items():
        risk = F.round("risk", 6)
        shifted = risk if model == "naive_bayes" else recalibrate(risk, p / (p + n), POPULATION_RATE)
        scored = m.transform(scored).withColumn(f"{model}_{k}", shifted).drop("risk", "pred", "log_pos", "log_neg")
        each.append(F.struct(F.lit(model).alias("model"), F.lit(k).alias("k"), F.col(f"{model}_{k}").alias("risk")))
    long = scored.select("y", F.explode(F.array(*each)).alias("m")).select("y", "m.*")
    return q.rounded(metrics.confusion(long, (F.col("risk") >= REFER_AT).cast("int"), by=["model", "k"]))


_BN_TEST = " UNION ALL ".join(f"SELECT c_custkey, '{f}' AS feature, {_state_sql(f)} AS parent_state, {f} AS value FROM test" for f in SCREENING.features)
_BN_EVERY = " UNION ALL ".join(
    f"SELECT d.feature, {'p.feature || chr(61) || p.value' if SCREENING.parents.get(f) else chr(39) * 2} AS parent_state, d.value FROM dom d " + (f"JOIN dom p ON p.feature = '{SCREENING.parents[f][0]}' " if SCREENING.parents.get(f) else "") + f"WHERE d.feature = '{f}'"
    for f in SCREENING.features
)


@q.query(f"""WITH {_sql(K)}, found AS (SELECT feature, parent_state, value, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM ({_BN_CELLS}) GROUP BY 1, 2, 3),
cells AS (SELECT e.feature, e.parent_state, e.value, coalesce({_K('p', K)}, 0) AS a, coalesce({_K('n', K)}, 0) AS b FROM ({_BN_EVERY}) e LEFT JOIN found f ON f.feature = e.feature AND f.parent_state = e.parent_state AND f.value = e.value),
pr AS (SELECT feature, parent_state, value, ln((a + 1.0::DOUBLE) / (sum(a) OVER w + count(*) OVER w)) AS la, ln((b + 1.0::DOUBLE) / (sum(b) OVER w + count(*) OVER w)) AS lb FROM cells WINDOW w AS (PARTITION BY feature, parent_state)),
bl AS (SELECT x.c_custkey, ln(max(t.p) / max(t.p + t.n)::DOUBLE + 1e-12) + sum(la) AS a, ln(max(t.n) / max(t.p + t.n)::DOUBLE + 1e-12) + sum(lb) AS b FROM ({_BN_TEST}) x JOIN pr ON pr.feature = x.feature AND pr.parent_state = x.parent_state AND pr.value = x.value CROSS JOIN tot t GROUP BY 1)
SELECT c_custkey, {q._R('1 / (1 + exp(b - a))')} AS risk, CAST(1 / (1 + exp(b - a)) >= 0.5 AS INTEGER) AS pred FROM bl""")
def screening_bn_scores_k11(spark, sf_dir):
    view = patients(spark, sf_dir)
    p, n = counts.base_rates(fitted(view)).first()
    cells = suppress.suppress(counts.cpt(fitted(view), SCREENING), ["n_pos", "n_neg"])
    return q.rounded(naive_bayes.BayesNet.fit(cells, SCREENING, p, n).transform(held_out(view)).select("c_custkey", "risk", "pred"))


_HIST_SQL = f"""WITH {_sql(K)}, prior AS (SELECT p / (p + n)::DOUBLE AS r FROM tot), hb AS (SELECT feature, value, n_pos + n_neg AS support, (n_pos + 1) / (n_pos + n_neg + 2)::DOUBLE AS bucket_risk FROM marg),
hw AS (SELECT hb.feature, 1 + sum(support / s.n::DOUBLE * abs(bucket_risk - (SELECT r FROM prior))) AS weight FROM hb JOIN (SELECT feature, sum(support) AS n FROM hb GROUP BY 1) s ON s.feature = hb.feature GROUP BY hb.feature),
hx AS (UNPIVOT (SELECT c_custkey, {_TALL} FROM test) ON {_TALL} INTO NAME feature VALUE value),
hs AS (SELECT c_custkey, sum(weight * coalesce(bucket_risk, (SELECT r FROM prior))) / sum(weight) AS risk FROM hx JOIN hw ON hw.feature = hx.feature LEFT JOIN hb ON hb.feature = hx.feature AND hb.value = hx.value GROUP BY 1)
SELECT c_custkey, {q._R('risk')} AS risk, CAST(risk >= (SELECT r FROM prior) AS INTEGER) AS pred FROM hs"""


@q.query(_HIST_SQL)
def screening_hist_scores_k11(spark, sf_dir):
    view = patients(spark, sf_dir)
    marginals, p, n = screening_counts(fitted(view), K)
    return q.rounded(histogram.HistogramClassifier.fit(marginals, SCREENING, p, n).transform(held_out(view)).select("c_custkey", "risk", "pred"))


@q.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat('42:', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 50")
def seeded_sample(spark, sf_dir):
    return scan.sample(q.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 50, ["o_orderkey"], seed=42)


_POINTS = f"nbr AS (SELECT round(risk, 9) AS s, y FROM nb), pts AS (SELECT s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM nbr GROUP BY s), cv AS (SELECT s, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM pts WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), al AS (SELECT sum(p) AS np, sum(n) AS nn FROM pts)"
_WEIGHED = f"(SELECT {POPULATION_RATE}::DOUBLE / avg(y) AS wp, (1 - {POPULATION_RATE}::DOUBLE) / (1 - avg(y)) AS wn FROM pat WHERE c_custkey % 5 <> 0)"


@q.query(f"""{_nb_sql(K)}, {_POINTS}, conf AS ({q.confusion_sql("nbr", f"s >= {REFER_AT}")}),
ranks AS (SELECT {q._R("sum(n * (tp - p / 2.0::DOUBLE)) / (max(np) * max(nn))")} AS roc_auc, {q._R("sum(p * tp / (tp + fp)::DOUBLE) / max(np)")} AS pr_auc, {q._R("max(2 * tp / (tp + fp + np))")} AS f1_best FROM cv CROSS JOIN al),
pop AS (SELECT {q._R("max(2 * wp * tp / (wp * tp + wn * fp + wp * np))")} AS f1_population, {q._R("sum(p * wp * tp / (wp * tp + wn * fp)) / max(np)")} AS pr_auc_population FROM cv CROSS JOIN al CROSS JOIN {_WEIGHED})
SELECT *, {POPULATION_RATE}::DOUBLE AS population_rate, {REFER_AT}::DOUBLE AS threshold FROM conf CROSS JOIN ranks CROSS JOIN pop""")
def screening_metrics_k11(spark, sf_dir):
    """Referral metrics of naive Bayes under suppression, and its ranking at the population's rate of cases."""
    view = patients(spark, sf_dir)
    p, n = counts.base_rates(fitted(view)).first()
    scored = screening_nb(fitted(view), K).transform(held_out(view)).select("y", F.round("risk", 9).alias("risk"))
    return q.rounded(metrics.screening(scored, p / (p + n), POPULATION_RATE, REFER_AT))
