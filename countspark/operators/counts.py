"""The counts that all models are trained from, each by one grouped aggregation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countspark.plans.spec import DatasetSpec

STATE = "|"  # joins "parent=value" into one parent state


def _pos(label: str) -> Column:
    return F.count_if(F.col(label) == 1).alias("n_pos")


def _neg(label: str) -> Column:
    return F.count_if(F.col(label) == 0).alias("n_neg")


def base_rates(df: DataFrame, label: str = "y") -> DataFrame:
    return df.agg(_pos(label), _neg(label))


def cube(df: DataFrame, spec: DatasetSpec, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, features, n_pos, n_neg): the rows as one line for each combination of feature values, and of the columns `by`."""
    return spec.prepared(df).groupBy(*by, *spec.features).agg(_pos(spec.label), _neg(spec.label))


def by_label(counts: DataFrame, label: str = "y") -> DataFrame:
    """A cube's lines with a label and n, the rows that have it, in place of the class counts."""
    sides = F.array(F.struct(F.lit(1).alias(label), F.col("n_pos").alias("n")), F.struct(F.lit(0).alias(label), F.col("n_neg").alias("n")))
    return counts.select("*", F.explode(sides).alias("_side")).select("*", "_side.*").drop("_side", "n_pos", "n_neg").filter("n > 0")


def _long(df: DataFrame, spec: DatasetSpec, keep: list[str]) -> DataFrame:
    """One row for each row and feature: (keep, feature, value)."""
    return df.unpivot(keep, spec.features, "feature", "value")


def marginals(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """(feature, value, col_idx, n_pos, n_neg) for every value of the domains, zeros included."""
    seen = _long(spec.prepared(df), spec, [spec.label]).groupBy("feature", "value").agg(_pos(spec.label), _neg(spec.label))
    return _zero_filled(seen, spec)


def marginals_of_cube(counts: DataFrame, spec: DatasetSpec) -> DataFrame:
    seen = _long(counts, spec, ["n_pos", "n_neg"]).groupBy("feature", "value").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    return _zero_filled(seen, spec)


def _zero_filled(seen: DataFrame, spec: DatasetSpec) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return spec.domain_table(seen.sparkSession).join(seen, ["feature", "value"], "left").select("feature", "value", "col_idx", zero("n_pos"), zero("n_neg"))


def tidy(counts: DataFrame) -> DataFrame:
    """(feature, cls, value, cnt): counts with a row for each class."""
    by_class = F.explode(F.array(F.struct(F.lit(1).alias("cls"), F.col("n_pos").alias("cnt")), F.struct(F.lit(0).alias("cls"), F.col("n_neg").alias("cnt"))))
    return counts.withColumn("x", by_class).select("feature", "x.cls", "value", "x.cnt")


def domains(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, position, value): each feature's distinct values from position 0; whole numbers are ordered as numbers."""
    values = df.select(*[F.lower(F.col(f).cast("string")).alias(f) for f in features]).unpivot([], features, "feature", "value")
    number = F.col("value").try_cast("long")
    order = Window.partitionBy("feature").orderBy(number.isNull(), number, "value")  # over distinct values only
    return values.filter("value is not null").distinct().select("feature", (F.row_number().over(order) - 1).alias("position"), "value")


def gaussian_stats(df: DataFrame, numeric: list[str] | tuple[str, ...], label: str = "y") -> DataFrame:
    """(feature, cls, n, total, total_sq). A value that is null or no number is an error."""
    wide = df.select(F.col(label).cast("int").alias("cls"), *[F.col(c).try_cast("double").alias(c) for c in numeric])
    checked = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} must be a number in every row"))).otherwise(F.col(c)) for c in numeric]
    sums = [x for c, v in zip(numeric, checked) for x in (F.sum(v).alias(f"{c}__s"), F.sum(v * v).alias(f"{c}__q"))]
    by_class = wide.groupBy("cls").agg(F.count("*").alias("n"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__s").alias("total"), F.col(f"{c}__q").alias("total_sq")) for c in numeric])).alias("x")
    return by_class.select("cls", "n", rows).select("x.feature", "cls", "n", "x.total", "x.total_sq")


def parent_state(spec: DatasetSpec, feature: str) -> Column:
    """The values of a feature's parents as text, "" without parents."""
    ps = spec.parents.get(feature, ())
    return F.concat_ws(STATE, *[F.concat(F.lit(f"{p}="), F.lower(F.col(p).cast("string"))) for p in ps]) if ps else F.lit("")


def cpt(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """(feature, parent_state, value, n_pos, n_neg) for every state of the parents' domains and value of the feature's."""
    seen = spec.prepared(df).select(spec.label, _cells(spec)).groupBy("x.feature", "x.parent_state", "x.value").agg(_pos(spec.label), _neg(spec.label))
    return _every_cell(seen, spec)


def cpt_of_cube(counts: DataFrame, spec: DatasetSpec) -> DataFrame:
    """cpt() from a cube."""
    seen = counts.select("n_pos", "n_neg", _cells(spec)).groupBy("x.feature", "x.parent_state", "x.value").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    return _every_cell(seen, spec)


def _cells(spec: DatasetSpec) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), parent_state(spec, f).alias("parent_state"), F.col(f).alias("value")) for f in spec.features])).alias("x")


def _every_cell(seen: DataFrame, spec: DatasetSpec) -> DataFrame:
    every = []
    for f in spec.features:
        states = [""]
        for k, p in enumerate(spec.parents.get(f, ())):
            states = [s + (STATE if k else "") + f"{p}={v}" for s in states for v in spec.domains[p]]
        every += [(f, s, v) for s in states for v in spec.domains[f]]
    cells = seen.sparkSession.createDataFrame(every, "feature string, parent_state string, value string")  # as large as the declared domains
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return cells.join(seen, ["feature", "parent_state", "value"], "left").select("feature", "parent_state", "value", zero("n_pos"), zero("n_neg"))


def pairwise(counts: DataFrame, spec: DatasetSpec) -> DataFrame:
    """(fa, va, fb, vb, cnt, n_pos) for the observed pairs of values of each two features, fa before fb, from a cube.

    Each pair of features is a grouping set, so the cube is expanded once and combined before the shuffle.
    """
    sets = [[F.col(a), F.col(b)] for a, b in combinations(spec.features, 2)]
    by_pair = counts.groupingSets(sets, *[F.col(f) for f in spec.features]).agg(F.sum(F.col("n_pos") + F.col("n_neg")).alias("cnt"), F.sum("n_pos").alias("n_pos"), F.grouping_id().alias("gid"))
    full = (1 << len(spec.features)) - 1
    bit = {f: 1 << (len(spec.features) - 1 - i) for i, f in enumerate(spec.features)}
    fa = fb = va = vb = F.lit(None).cast("string")
    for a, b in combinations(spec.features, 2):
        here = F.col("gid") == full - bit[a] - bit[b]
        fa, fb = F.when(here, F.lit(a)).otherwise(fa), F.when(here, F.lit(b)).otherwise(fb)
        va, vb = F.when(here, F.col(a)).otherwise(va), F.when(here, F.col(b)).otherwise(vb)
    return by_pair.select(fa.alias("fa"), va.alias("va"), fb.alias("fb"), vb.alias("vb"), "cnt", "n_pos")


def level_histogram(counts: DataFrame, spec: DatasetSpec, node: Column | None = None) -> DataFrame:
    """(node, feature, value, n_pos, n_neg): what each candidate split of each node would put on its left, from a cube."""
    at = counts.withColumn("node", F.lit(0).cast("long") if node is None else node).filter("node is not null")
    return _long(at, spec, ["node", "n_pos", "n_neg"]).groupBy("node", "feature", "value").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("cnt"))


def agreement(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """The share of rows whose two columns are equal; weight: a column of how many rows a row stands for."""
    same, n = F.col(a) == F.col(b), F.lit(1) if weight is None else F.col(weight)
    return df.agg(F.try_divide(F.sum(F.when(same, n).when(~same, 0)), F.sum(F.when(same.isNotNull(), n))).alias("agreement"))
