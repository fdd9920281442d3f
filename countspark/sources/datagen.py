"""Synthetic record generators as DataFrame expressions: each row's draws come from digests of its id and a seed.

So a row is the same however many rows or partitions there are, a task that is run again makes the same rows, and SQL elsewhere can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countspark.functions import clinical

# The distributions of the fraud records.
HIGH_SHARE, ACTIVE_SHARE, NO_JURISDICTION = 0.6534, 0.503, 0.15
HIGH_TYPES = {"mule_account": 0.25, "card_fraud": 0.24, "identity_theft": 0.15, "account_takeover": 0.19, "synthetic_identity": 0.17}
LOW_TYPES = {"suspicious_transfer": 0.51, "unusual_activity": 0.49}
JURISDICTIONS = {"JP": 0.118, "AU": 0.118, "DE": 0.117, "FR": 0.116, "US": 0.116, "GB": 0.114, "BR": 0.083, "ES": 0.078, "HK": 0.036, "CH": 0.035, "SG": 0.035, "CA": 0.034}
YEARS = {2018: 0.133, 2019: 0.093, 2020: 0.143, 2021: 0.142, 2022: 0.139, 2023: 0.144, 2024: 0.147, 2025: 0.059}
# The distributions of the screening records; a range of whole numbers follows each share.
AGES = {"40_49": (0.25, 40, 49), "50_59": (0.30, 50, 59), "60_69": (0.28, 60, 69), "70_74": (0.17, 70, 74)}
MENARCHE = {"under_12": (0.30, 8, 11), "12_13": (0.45, 12, 13), "14_plus": (0.25, 14, 17)}
FIRST_BIRTH = {"nulliparous": (0.15, 0, 0), "under_20": (0.12, 15, 19), "20_24": (0.25, 20, 24), "25_29": (0.28, 25, 29), "30_plus": (0.20, 30, 45)}
RACES = {"white": 0.55, "hispanic": 0.20, "asian_pi": 0.12, "black": 0.08, "other": 0.05}
RELATIVES, FAMILY_SHARE = {1: 0.85, 2: 0.12, 3: 0.03}, 0.15
BIOPSIES, BIOPSY_SHARE, ATYPICAL_SHARE = {1: 0.75, 2: 0.18, 3: 0.05, 4: 0.015, 5: 0.005}, 0.15, 0.05
DENSITY = {1: 0.10, 2: 0.40, 3: 0.40, 4: 0.10}
OUTCOME_BASELINE = {"40_49": 0.008, "50_59": 0.015, "60_69": 0.022, "70_74": 0.028}
OUTCOME_DENSITY = {1: 0.70, 2: 0.90, 3: 1.15, 4: 1.60}


def draw(seed: int, what: str) -> Column:
    """A number from 0 up to 1 for the row's id: 52 bits of an MD5 digest."""
    return _unit(F.concat_ws(":", F.lit(f"{seed}:{what}"), F.col("id").cast("string")))


def _unit(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def draw_sql(seed: int, what: str, id_: str = "id") -> str:
    """draw() in DuckDB's dialect."""
    return _unit_sql(f"'{seed}:{what}:' || CAST({id_} AS VARCHAR)")


def _unit_sql(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / {float(1 << 52)}::DOUBLE)"


def picked(keys: list[str], share: float, what: str, seed: int = 42) -> Column:
    """Whether a row is one of a share of all rows, by a digest of its keys; a null key counts as an empty one."""
    said = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return _unit(F.concat_ws(":", F.lit(f"{seed}:{what}"), *said)) < share


def picked_sql(keys: list[str], share: float, what: str, seed: int = 42) -> str:
    said = " || ':' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"({_unit_sql(f"'{seed}:{what}:' || {said}")} < {share}::DOUBLE)"


def choice(u: Column, weights: dict) -> Column:
    """The value at a point of the cumulative weights."""
    total, at, out = sum(weights.values()), 0.0, None
    for value, w in weights.items():
        at += w / total
        out = F.when(u < at, F.lit(value)) if out is None else out.when(u < at, F.lit(value))
    return out.otherwise(F.lit(list(weights)[-1]))


def whole(u: Column, low: int | Column, high: int | Column) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (low + F.floor(u * (high - low + 1))).cast("int")


def choice_sql(u: str, weights: dict) -> str:
    total, at, out = sum(weights.values()), 0.0, []
    for value, w in weights.items():
        at += w / total
        out.append(f"WHEN {u} < {at!r}::DOUBLE THEN {value!r}")
    return f"CASE {' '.join(out)} ELSE {list(weights)[-1]!r} END"


def whole_sql(u: str, low: int, high: int) -> str:
    return f"CAST({low} + floor({u} * {high - low + 1}) AS INTEGER)"


def fraud(spark: SparkSession, n: int, seed: int = 42, start: int = 1, noisy: bool = False, partitions: int | None = None) -> DataFrame:
    """n fraud records with ids from start on."""
    return fraud_of(spark.range(start, start + n, 1, partitions) if partitions else spark.range(start, start + n), seed, noisy)


def fraud_of(rows: DataFrame, seed: int = 42, noisy: bool = False) -> DataFrame:
    """A fraud record for each row (id); noisy: the type is drawn from the other class."""
    u = lambda what: draw(seed, what)
    high = u("class") < HIGH_SHARE
    typed = F.when(~high if noisy else high, choice(u("type"), HIGH_TYPES)).otherwise(choice(u("type"), LOW_TYPES))
    return rows.select(
        F.col("id").cast("string").alias("report_id"),
        F.format_string("BANK%03d", whole(u("bank"), 1, 50)).alias("reporting_bank_id"),
        F.when(u("none") < NO_JURISDICTION, "").otherwise(choice(u("reporting"), JURISDICTIONS)).alias("reporting_jurisdiction"),
        F.concat(F.lit("IBAN"), whole(u("iban"), 10_000_000, 99_999_999).cast("string")).alias("reported_iban"),
        choice(u("account"), JURISDICTIONS).alias("account_jurisdiction"),
        F.when(high, whole(u("level"), 50, 100)).otherwise(whole(u("level"), 0, 49)).alias("risk_level"),
        typed.alias("fraud_type"),
        choice(u("year"), YEARS).alias("year"),
        whole(u("month"), 1, 12).alias("month"),
        whole(u("day"), 1, 28).alias("day"),
        F.when(u("active") < ACTIVE_SHARE, "true").otherwise("false").alias("is_active"),
    )


def fraud_sql(ids: str, seed: int = 42, noisy: bool = False) -> str:
    """fraud_of() in DuckDB's dialect, without the account number; ids: a query that gives id."""
    u = lambda what: draw_sql(seed, what)
    high = f"{u('class')} < {HIGH_SHARE}::DOUBLE"
    return f"""SELECT CAST(id AS VARCHAR) AS report_id, 'BANK' || lpad(CAST({whole_sql(u("bank"), 1, 50)} AS VARCHAR), 3, '0') AS reporting_bank_id,
CASE WHEN {u("none")} < {NO_JURISDICTION}::DOUBLE THEN '' ELSE {choice_sql(u("reporting"), JURISDICTIONS)} END AS reporting_jurisdiction, {choice_sql(u("account"), JURISDICTIONS)} AS account_jurisdiction,
CASE WHEN {high} THEN {whole_sql(u("level"), 50, 100)} ELSE {whole_sql(u("level"), 0, 49)} END AS risk_level,
CASE WHEN {"NOT " if noisy else ""}({high}) THEN {choice_sql(u("type"), HIGH_TYPES)} ELSE {choice_sql(u("type"), LOW_TYPES)} END AS fraud_type,
{choice_sql(u("year"), YEARS)} AS "year", {whole_sql(u("month"), 1, 12)} AS "month", {whole_sql(u("day"), 1, 28)} AS "day", CASE WHEN {u("active")} < {ACTIVE_SHARE}::DOUBLE THEN 'true' ELSE 'false' END AS is_active
FROM ({ids})"""


def screening(spark: SparkSession, n: int, seed: int = 42, start: int = 1, partitions: int | None = None) -> DataFrame:
    """n screening records with ids from start on."""
    return screening_of(spark.range(start, start + n, 1, partitions) if partitions else spark.range(start, start + n), seed)


def screening_of(rows: DataFrame, seed: int = 42) -> DataFrame:
    """A screening record for each row (id); the outcome follows the product of relative risks."""
    u = lambda what: draw(seed, what)
    shares = lambda table: {k: v[0] for k, v in table.items()}

    def within(group: str, table: dict, what: str) -> Column:
        low, high = (clinical.lookup(F.col(group), {k: v[i] for k, v in table.items()}, 0).cast("int") for i in (1, 2))
        return whole(u(what), low, high)

    base = rows.withColumns({"age_group": choice(u("age"), shares(AGES)), "menarche_category": choice(u("menarche"), shares(MENARCHE)), "birth": choice(u("birth"), shares(FIRST_BIRTH))})
    base = base.withColumns(
        {
            "age": within("age_group", AGES, "age_in"), "age_at_menarche": within("menarche_category", MENARCHE, "menarche_in"), "age_at_first_birth": within("birth", FIRST_BIRTH, "birth_in"),
            "num_first_degree_relatives": F.when(u("family") < FAMILY_SHARE, choice(u("relatives"), RELATIVES)).otherwise(0), "num_prior_biopsies": F.when(u("biopsy") < BIOPSY_SHARE, choice(u("biopsies"), BIOPSIES)).otherwise(0),
            "race_ethnicity": choice(u("race"), RACES), "breast_density": choice(u("density"), DENSITY),
        }
    )
    some = lambda c: F.when(F.col(c) > 0, "yes").otherwise("no")
    base = base.withColumns({"family_history": some("num_first_degree_relatives"), "has_prior_biopsy": some("num_prior_biopsies"), "atypical_hyperplasia": F.when(F.col("num_prior_biopsies") == 0, "unknown").when(u("atypical") < ATYPICAL_SHARE, "yes").otherwise("no")})
    c = F.col
    # The relative risk is what the published formula has above its baseline, times that of density.
    published = clinical.bcrat_risk(c("age"), c("menarche_category"), c("age_at_first_birth"), c("num_first_degree_relatives"), c("num_prior_biopsies"), c("atypical_hyperplasia"))
    relative = F.log(F.lit(1.0) - published) / F.log(F.lit(1.0) - clinical.lookup(c("age_group"), clinical.BCRAT_BASELINE, 0.015))
    p = F.lit(1.0) - F.pow(F.lit(1.0) - clinical.lookup(c("age_group"), OUTCOME_BASELINE, 0.015), relative * clinical.lookup(c("breast_density"), OUTCOME_DENSITY, 1.0))
    return base.withColumn("cancer_5yr", (u("outcome") < p).cast("int")).select(
        c("id").cast("string").alias("patient_id"), "age", "age_group", "age_at_menarche", "menarche_category", "age_at_first_birth", "num_first_degree_relatives", "family_history",
        "num_prior_biopsies", "has_prior_biopsy", "atypical_hyperplasia", "race_ethnicity", "breast_density", "cancer_5yr",
    )
