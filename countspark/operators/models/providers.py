"""Where tree learners get their counts from: a protocol that a user's own source may follow, the one over a cube, and a store of what is known.

A path is what a row has been asked on its way: (feature, value, branch), branch being whether it has the value. For each path a provider
says how many positives and others each candidate of the spec would put on its left; the store keeps that as one dense array a path.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countspark.plans.spec import DatasetSpec

Path = tuple[tuple[str, str, bool], ...]


class CountProvider(Protocol):
    """counts(paths) has the rows (path int, candidate int, n_pos, n_neg): by place in the list of paths and in the spec's candidates; what no row of the data has is left out or 0."""

    spec: DatasetSpec

    def counts(self, paths: list[Path]) -> DataFrame: ...


def equal(feature: str, value: str) -> Column:
    return F.coalesce(F.lower(F.col(feature).cast("string")) == F.lit(value), F.lit(False))


def follows(path: Path) -> Column:
    """Whether a row goes along a path."""
    steps = [equal(f, v) if branch else ~equal(f, v) for f, v, branch in path]
    out = F.lit(True)
    for s in steps:
        out = out & s
    return out


def codes(spec: DatasetSpec) -> Column:
    """The places of a row's values among the spec's candidates, one for each feature; -1 for a value that is in no domain."""
    out, before = [], 0
    for f, values in spec.domains.items():
        at = F.array_position(F.array(*map(F.lit, values)), F.lower(F.col(f).cast("string"))).cast("int")
        out.append(F.when(at > 0, at + (before - 1)).otherwise(-1))
        before += len(values)
    return F.array(*out)


class CubeCounts:
    """Counts from (features, n_pos, n_neg): one pass over the cube for all paths, summed within tasks first; a row comes out for each path and candidate at most."""

    def __init__(self, cube: DataFrame, spec: DatasetSpec):
        self.cube, self.spec = cube, spec

    def counts(self, paths: list[Path]) -> DataFrame:
        at = F.array(F.lit(0)) if paths == [()] else F.array_compact(F.array(*[F.when(follows(p), F.lit(i)) for i, p in enumerate(paths)]))
        rows = self.cube.select(codes(self.spec).alias("codes"), F.explode(at).alias("path"), "n_pos", "n_neg")
        tall = rows.select("path", F.explode("codes").alias("candidate"), "n_pos", "n_neg").filter("candidate >= 0")
        return tall.groupBy("path", "candidate").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


class QueryCounts:
    """Counts from a user's function that counts the rows of one path, feature, value and class; for sources that answer no more than that."""

    def __init__(self, spark, spec: DatasetSpec, count: Callable[[Path, str, str, int], int]):
        self.spark, self.spec, self.count = spark, spec, count

    def counts(self, paths: list[Path]) -> DataFrame:
        rows = [(i, c, self.count(p, f, v, 1), self.count(p, f, v, 0)) for i, p in enumerate(paths) for f, v, c in self.spec.candidates()]
        return self.spark.createDataFrame(rows, "path int, candidate int, n_pos long, n_neg long")


class Known:
    """A store over a provider: each path is asked for once, however many trees come along it, in whatever order of its steps.

    Where a node and its left side are known, the right side is what is left of the node.
    """

    def __init__(self, provider: CountProvider):
        self.provider, self.found, self.asked = provider, {}, 0
        self.at = {(f, v): i for f, v, i in provider.spec.candidates()}

    def __call__(self, paths: list[Path]) -> list[np.ndarray]:
        """For each path, an array of two rows (positives, others) with a column for each candidate."""
        missing: dict[frozenset, Path] = {}
        for p in paths:
            for need in [] if frozenset(p) in missing else self._needs(p):
                missing.setdefault(frozenset(need), need)
        ask = [p for k, p in missing.items() if k not in self.found]
        if ask:
            self.asked += len(ask)
            self.found |= {frozenset(p): np.zeros((2, len(self.at)), np.int64) for p in ask}
            for r in self.provider.counts(ask).collect():  # as many as the paths have candidates
                self.found[frozenset(ask[r["path"]])][:, r["candidate"]] = r["n_pos"], r["n_neg"]
        return [self._of(p) for p in paths]

    def _needs(self, path: Path) -> list[Path]:
        """The paths whose counts give this one's."""
        if frozenset(path) in self.found or not path or path[-1][2]:
            return [path]
        f, v, _ = path[-1]
        return [*self._needs(path[:-1]), (*path[:-1], (f, v, True))]

    def _of(self, path: Path) -> np.ndarray:
        key = frozenset(path)
        if key not in self.found:
            f, v, _ = path[-1]
            self.found[key] = self._of(path[:-1]) - self.found[frozenset((*path[:-1], (f, v, True)))]
        return self.found[key]
