"""Two published five-year screening risk formulas, and the bins of their inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published relative risks and baseline risks.
RR_MENARCHE = {"under_12": 1.207, "12_13": 1.098, "14_plus": 1.0}
RR_ATYPICAL = {"yes": 1.82, "no": 0.93, "unknown": 1.0}
# by age at first birth (below the bound), for 0, 1 and 2 or more relatives
RR_BIRTH_RELATIVES = [(20, (1.0, 2.56, 6.168)), (25, (1.24, 2.64, 5.318)), (30, (1.55, 2.705, 4.591)), (None, (1.93, 2.779, 3.953))]
# one biopsy, more than one: below the age of 50, from 50 on
RR_BIOPSY = {"young": (1.683, 2.75), "old": (1.237, 1.539)}
BCRAT_BASELINE = {"40_49": 0.004, "50_59": 0.007, "60_69": 0.011, "70_74": 0.014}
BCSC_BASELINE = {"40_49": 0.006, "50_59": 0.01, "60_69": 0.015, "70_74": 0.019}
RR_DENSITY = {1: 0.55, 2: 0.8, 3: 1.35, 4: 2.1}
RR_FAMILY = {"yes": 1.8, "no": 1.0}
RR_ANY_BIOPSY = {"yes": 1.5, "no": 1.0}
RR_RACE = {"white": 1.0, "black": 0.95, "hispanic": 0.75, "asian_pi": 0.65, "other": 0.85}


def lookup(c: Column, values: dict, default: float) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(c == F.lit(key), F.lit(value)).otherwise(out)
    return out


def age_group(age: Column) -> Column:
    return F.when(age < 50, "40_49").when(age < 60, "50_59").when(age < 70, "60_69").otherwise("70_74")


def first_birth_bin(age: Column) -> Column:
    return F.when(age == 0, "nulliparous").when(age < 20, "under_20").when(age < 25, "20_24").when(age < 30, "25_29").otherwise("30_plus")


def biopsy_bin(n: Column) -> Column:
    return F.when(n >= 3, "3_plus").otherwise(n.cast("string"))


def menarche_category(age: Column) -> Column:
    return F.when(age < 12, "under_12").when(age <= 13, "12_13").otherwise("14_plus")


def _absolute(baseline: Column, relative: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(1.0) - F.pow(F.lit(1.0) - baseline, relative))


def bcrat_risk(age: Column, menarche: Column, first_birth: Column, relatives: Column, biopsies: Column, atypical: Column) -> Column:
    """1 - (1 - baseline) ^ (product of the relative risks); unknown categories have the relative risk 1."""
    one, more = (F.when(age < 50, F.lit(RR_BIOPSY["young"][i])).otherwise(F.lit(RR_BIOPSY["old"][i])) for i in (0, 1))
    biopsy = F.when(biopsies == 0, F.lit(1.0)).when(biopsies == 1, one).otherwise(more)
    birth = F.lit(None).cast("double")
    for bound, by_relatives in reversed(RR_BIRTH_RELATIVES):
        here = F.when(relatives <= 0, F.lit(by_relatives[0])).when(relatives == 1, F.lit(by_relatives[1])).otherwise(F.lit(by_relatives[2]))
        birth = here if bound is None else F.when(first_birth < bound, here).otherwise(birth)
    relative = lookup(menarche, RR_MENARCHE, 1.0) * biopsy * birth * lookup(F.lower(atypical), RR_ATYPICAL, 1.0)
    return _absolute(lookup(age_group(age), BCRAT_BASELINE, 0.015), relative)


def bcsc_risk(age: Column, density: Column, family: Column, biopsy: Column, race: Column) -> Column:
    relative = lookup(density, RR_DENSITY, 1.0) * lookup(F.lower(family), RR_FAMILY, 1.0) * lookup(F.lower(biopsy), RR_ANY_BIOPSY, 1.0) * lookup(F.lower(race), RR_RACE, 1.0)
    return _absolute(lookup(age_group(age), BCSC_BASELINE, 0.01), relative)
