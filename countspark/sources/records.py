"""Records as nested JSON, batches with checks, and appends that continue the ids."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countspark.operators.ordering import occurrences
from countspark.sources.scratch import exclusive, names, text_of, written

#: The two record types. Integers have bounds; every field is required.
FRAUD = T.StructType(
    [
        *[T.StructField(c, T.StringType(), False) for c in ("report_id", "reporting_bank_id", "reporting_jurisdiction", "reported_iban", "account_jurisdiction", "fraud_type", "is_active")],
        *[T.StructField(c, T.IntegerType(), False) for c in ("risk_level", "year", "month", "day")],
    ]
)
FRAUD_BOUNDS = {"risk_level": (0, 100), "year": (2018, 2025), "month": (1, 12), "day": (1, 31)}
SCREENING = T.StructType(
    [
        *[T.StructField(c, T.StringType(), False) for c in ("patient_id", "age_group", "menarche_category", "family_history", "has_prior_biopsy", "atypical_hyperplasia", "race_ethnicity")],
        *[T.StructField(c, T.IntegerType(), False) for c in ("age", "age_at_menarche", "age_at_first_birth", "num_first_degree_relatives", "num_prior_biopsies", "breast_density", "cancer_5yr")],
    ]
)
SCREENING_BOUNDS = {"age": (40, 74), "age_at_menarche": (8, 17), "age_at_first_birth": (0, 45), "num_first_degree_relatives": (0, 3), "num_prior_biopsies": (0, 5), "breast_density": (1, 4), "cancer_5yr": (0, 1)}


MOST_CLASSES = 1000


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records from JSON arrays of {"data": {...}, "schema": ...}, or of bare records, as flat columns."""
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    raw = spark.read.schema(T.StructType([T.StructField("data", nullable), *nullable])).option("multiLine", True).json(path)
    return raw.select(*[F.coalesce(F.col("data")[f.name], F.col(f.name)).alias(f.name) for f in schema])


def write_batches(df: DataFrame, path: str, schema_url: str, mode: str = "error") -> None:
    df.select(F.struct("*").alias("data"), F.lit(schema_url).alias("schema")).write.mode(mode).json(path)


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What write_batches() wrote: one wrapped record a line, which files can be split at."""
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return spark.read.schema(T.StructType([T.StructField("data", nullable), T.StructField("schema", T.StringType())])).json(path).select("data.*")


def violations(df: DataFrame, schema: T.StructType, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """(field, n_missing, n_out_of_bounds) for every field: one scan."""
    checks = []
    for f in schema:
        low, high = bounds.get(f.name, (None, None))
        out = F.lit(0).cast("long") if low is None else F.count_if(~F.col(f.name).between(low, high))
        checks.append(F.struct(F.lit(f.name).alias("field"), F.count_if(F.col(f.name).isNull()).alias("n_missing"), out.alias("n_out_of_bounds")))
    return df.agg(F.array(*checks).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def claim_ids(spark: SparkSession, path: str, n: int, last: int, patience: float = 10.0) -> int:
    """The first of n ids that are this caller's alone, after `last` and all that were claimed before.

    Claims are files path/_ids/VERSION, each made by one caller only, that name the range they take; who loses a version reads it and tries the
    next one. Ids of a claim whose rows were never written stay unused.
    """
    version, folder = 0, f"{path}/_ids"
    while True:
        known = [int(x) for x in names(spark, folder) if x.isdigit()]
        if known:
            version, waited = max(known), 0.0
            while not (said := text_of(spark, f"{folder}/{version:012d}")).endswith("\n"):
                if waited >= patience:
                    raise RuntimeError(f"{folder}/{version:012d} was begun and never finished: remove it")
                time.sleep(0.1)
                waited += 0.1
            last = max(last, int(said.split()[1]))
        if exclusive(spark, f"{folder}/{version + 1:012d}", f"{last + 1} {last + n}\n"):
            return last + 1


def append(df: DataFrame, path: str, id_col: str) -> tuple[int, int]:
    """Append rows whose ids continue after the largest number among those stored; gives the first and the last new one.

    Rows are written to the shared folder first, with their partition and place in it: their ids follow from what is written there, so that
    a task that runs again, or a table that reads differently, numbers nothing twice. Two appends at once claim different ranges.
    """
    spark = df.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max(F.col(id_col).try_cast("long"))).first()[0] or 0
    except AnalysisException as e:  # nothing is stored yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        last = 0
    place = F.monotonically_increasing_id()
    staged = written(df.withColumn("_p", F.shiftright(place, 33).cast("int")).withColumn("_i", place.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = {r["_p"]: r["count"] for r in staged.groupBy("_p").count().collect()}  # one number a partition
    total = sum(sizes.values())
    if not total:
        return last + 1, last
    first, base, so_far = claim_ids(spark, path, total, last), [], 0
    for p in sorted(sizes):
        base += [F.lit(p), F.lit(first + so_far).cast("long")]
        so_far += sizes[p]
    numbered = staged.withColumn(id_col, (F.create_map(*base)[F.col("_p")] + F.col("_i")).cast(df.schema[id_col].dataType if id_col in df.columns else "string"))
    numbered.select(*(df.columns if id_col in df.columns else [id_col, *df.columns])).write.mode("append").parquet(path)
    return first, first + total - 1


def load_labelled(df: DataFrame, label: str = "is_fraud", order: tuple[str, ...] = ("report_id", "id", "rowid")) -> DataFrame:
    """Records that must bear a label, without the columns that only tell their order."""
    if label not in df.columns:
        raise ValueError(f"no column {label}: label the records first")
    return df.drop(*[c for c in order if c in df.columns])


def in_order(df: DataFrame, id_col: str, whole: list[str] | None = None, level: str = "risk_level", threshold: int = 50) -> DataFrame:
    """All records with their place by number of their id (ids that are no numbers last, by text), these columns as whole numbers, and is_high_risk.

    No task sorts all rows: places are counted over ranges of ids.
    """
    typed = df.withColumns({c: F.col(c).cast("int") for c in whole or []})
    keyed = derive_label(typed, threshold) if level == "risk_level" else derive_label(typed.withColumn("risk_level", F.col(level)), threshold)
    number = F.col(id_col).try_cast("long")
    marked = keyed.withColumns({"_text": number.isNull(), "_number": number})
    return occurrences(marked, [], ["_text", "_number", id_col], "place").drop("_text", "_number")


def derive_label(df: DataFrame, threshold: int = 50, drop: list[str] | None = None) -> DataFrame:
    """With is_high_risk, and without ids and order columns where asked."""
    return df.withColumn("is_high_risk", (F.col("risk_level") >= threshold).cast("int")).drop(*(drop or []))


def species_table(df: DataFrame) -> DataFrame:
    """Numeric measurements and a target that has one of the usual names; a text target is numbered in alphabetical order.

    Columns named with a dash or an underscore are the same; without known names all numeric columns are features.
    """
    known = {"sepal_length", "sepal_width", "petal_length", "petal_width"}
    flat = df.select(*[F.col(f"`{c}`").alias(c.replace("-", "_").replace(" ", "_").lower()) for c in df.columns])
    target = next((c for c in ("species", "target", "class", "label") if c in flat.columns), None)
    if target is None:
        raise ValueError("no column species, target, class or label")
    numeric = [f.name for f in flat.schema if isinstance(f.dataType, T.NumericType) and f.name != target]
    features = [c for c in flat.columns if c in known] or numeric
    out = flat.select(*[F.col(c).try_cast("double").alias(c) for c in features], F.col(target).alias("target"))
    if isinstance(flat.schema[target].dataType, T.StringType):
        classes = [r[0] for r in out.select("target").filter("target is not null").distinct().orderBy("target").limit(MOST_CLASSES + 1).collect()]
        if len(classes) > MOST_CLASSES:
            raise ValueError(f"a target with more than {MOST_CLASSES} different values is no class")
        out = out.withColumn("target", F.array_position(F.array(*map(F.lit, classes)), F.col("target")).cast("int") - 1)
    return out


def batch_distribution(df: DataFrame, batch: str, label: str) -> DataFrame:
    """(batch, n, share_pos) for each batch."""
    return df.groupBy(batch).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("share_pos"))
