"""What a model sees of a table: the label, the features in order, their domains and parents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DatasetSpec:
    """features: categorical ones, in order, with the values they may have; numeric: those of Gaussian models.

    parents: features whose values the distribution of another one depends on.
    """

    domains: dict[str, list[str]]
    label: str = "y"
    numeric: tuple[str, ...] = ()
    parents: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        for f, values in self.domains.items():
            if len(set(values)) != len(values) or any(v != v.lower() for v in values):
                raise ValueError(f"the values of {f} must be distinct and in lower case")
        for f, ps in self.parents.items():
            if unknown := {f, *ps} - set(self.domains):
                raise ValueError(f"unknown features: {sorted(unknown)}")
        done: set[str] = set()
        left = {f: set(self.parents.get(f, ())) for f in self.domains}
        while ready := {f for f, ps in left.items() if ps <= done}:
            done |= ready
            left = {f: ps for f, ps in left.items() if f not in ready}
        if left:
            raise ValueError(f"the parents of {sorted(left)} form a cycle")

    @property
    def features(self) -> list[str]:
        return list(self.domains)

    def candidates(self) -> list[tuple[str, str, int]]:
        """(feature, value, column index) in the order in which ties are decided."""
        return [(f, v, i) for i, (f, v) in enumerate((f, v) for f, vs in self.domains.items() for v in vs)]

    def domain_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f, v, i) for f, v, i in self.candidates()], "feature string, value string, col_idx int")

    def prepared(self, df: DataFrame) -> DataFrame:
        """The label as int and the features as lower-case strings; other columns as they are."""
        return df.withColumns({f: F.lower(F.col(f).cast("string")) for f in self.features} | {self.label: F.col(self.label).cast("int")})


def discover(df: DataFrame, features: list[str], label: str = "y", **more) -> DatasetSpec:
    """A spec whose domains are the distinct values of a table, numbers in their own order. Domains are bounded: they come to the driver."""
    from countspark.operators.counts import domains

    found: dict[str, list[str]] = {f: [] for f in features}
    for r in domains(df, features).orderBy("feature", "position").collect():
        found[r["feature"]].append(r["value"])
    return DatasetSpec(found, label, **more)


#: The labelled view over the star schema: fixed domains, planted signal.
RISK = DatasetSpec(
    domains={
        "flag": ["a", "n", "r"],
        "status": ["f", "o"],
        "month": [str(m) for m in range(1, 13)],
        "year": [str(y) for y in range(1995, 2002)],
        "priority": ["1-urgent", "2-high", "3-medium", "4-not specified", "5-low"],
        "segment": ["automobile", "building", "furniture", "household", "machinery"],
        "region": ["africa", "america", "asia", "europe", "middle east"],
    },
    numeric=("month_n", "day_n", "year_n"),
    parents={"month": ("year",), "segment": ("region",), "priority": ("flag",)},
)


def risk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order, customer and region, as RISK sees it; columns that no query asks for are pruned from the scans."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    joined = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    level = F.least(F.lit(100), F.floor("l_quantity") + F.when(F.col("l_returnflag") == "R", 40).when(F.col("l_returnflag") == "A", 20).otherwise(0)).cast("int")
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        level.alias("risk_level"),
        (level >= 50).cast("int").alias("y"),
        F.lower("l_returnflag").alias("flag"),
        F.lower("l_linestatus").alias("status"),
        F.month("l_shipdate").cast("string").alias("month"),
        F.year("l_shipdate").cast("string").alias("year"),
        F.lower("o_orderpriority").alias("priority"),
        F.lower("c_mktsegment").alias("segment"),
        F.lower("r_name").alias("region"),
        F.month("l_shipdate").alias("month_n"),
        F.dayofmonth("l_shipdate").alias("day_n"),
        F.year("l_shipdate").alias("year_n"),
    )


def in_test(df: DataFrame, name: str = "in_test") -> DataFrame:
    """df with a column that is true where test_of() keeps the row."""
    return df.withColumn(name, F.pmod("l_orderkey", F.lit(5)) == 0)


def train_of(df: DataFrame) -> DataFrame:
    return df.filter(F.pmod("l_orderkey", F.lit(5)) != 0)


def test_of(df: DataFrame) -> DataFrame:
    return df.filter(F.pmod("l_orderkey", F.lit(5)) == 0)
