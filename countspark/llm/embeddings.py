"""Embedding near-duplicates by binary codes of randomly rotated vectors.

A vector is rotated at random and kept as the signs of its coordinates, with one number: its inner product with the corner
of the cube that the signs name. Divided by that number, the product of a rotated query with the corner is an unbiased
estimate of the cosine, whose error is bounded with the confidence that a number of standard deviations
gives. Only pairs whose upper bound reaches the threshold are computed exactly, in double precision.

Vectors meet in cells: each goes to the cells of its nearest few centers, taken from a bounded sample, so that a link whose
ends have none in common is rare (about 1 in 1,000 at cosine 0.95, fewer above); without a number of nearest cells all meet all,
which is exact and quadratic. Only codes and factors are dealt to all cells: there they decide which vectors may have
a link at all, and only these are sent, whole, to the cells in question. A pair is counted in the first cell that both are in.
Copies are one vector with a count; cells too large for one task are split into blocks, whose pairs are tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countspark.llm.common import blocked, components, drop, materialise, ship
from countspark.llm.simhash import chunked, local_roots

NEAREST = 6  # cells of each vector
MOST_CELLS = 16384
SAMPLE_PER_CELL = 3  # vectors read for each center
APART = 0.8  # centers are less alike than this
DEVIATIONS = 4.0  # of the estimates, within which the cosines are taken to be
BLOCK = 2048
BORDER = 1e-11  # products of whole blocks are off by less; cosines this close to the threshold are computed pair by pair
SEED = 11


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, d)).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed signs of rotated unit vectors, and their correction factors."""
    turned = units @ rotation(units.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(units.shape[1])


def bounds(queries: np.ndarray, codes: np.ndarray, factors: np.ndarray, deviations: float = DEVIATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines of unit vectors with encoded ones, and the errors that they stay within."""
    d = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    turned = (queries @ rotation(d).T).astype(np.float32)
    estimate = turned @ signs.T / (np.sqrt(d) * factors).astype(np.float32)
    error = deviations * np.sqrt(np.maximum(1 - factors**2, 0) / np.maximum(d - 1, 1)) / factors
    return estimate, error.astype(np.float32) + 1e-5


def hopeful(codes: np.ndarray, factors: np.ndarray, d: int, least: float, deviations: float, own: np.ndarray | None) -> np.ndarray:
    """Which encoded vectors may have a cosine of `least` with another one, by codes on both sides.

    The product of two corners over both factors is an estimate of the cosine (too high a one for near vectors, whose corners err alike), and
    its error comes from both. own: only vectors with different numbers meet.
    """
    wide = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    wide[:, : codes.shape[1]] = codes
    words = wide.view(np.uint64)
    spread = 1 / factors**2
    hope = np.zeros(len(codes), bool)
    for q in range(0, len(codes), 256):
        apart = np.zeros((len(words[q : q + 256]), len(codes) - q), np.int32)
        for w in words.T:
            apart += np.bitwise_count(w[q : q + 256, None] ^ w[q:])
        error = deviations * np.sqrt(np.maximum(spread[q : q + 256, None] * spread[q:] - 1, 0) / max(d - 1, 1))
        near = (1 - 2 * apart / d) / (factors[q : q + 256, None] * factors[q:]) + error >= least
        near &= np.arange(near.shape[1]) > np.arange(near.shape[0])[:, None]
        if own is not None:
            near &= own[q : q + 256, None] != own[q:]
        hope[q : q + 256] |= near.any(1)
        hope[q:] |= near.any(0)
    return hope


def centers_from(sample: list[np.ndarray], cells: int) -> dict[int, np.ndarray]:
    """By dimension: sampled directions that are apart from each other, and random ones for the rest."""
    by_dim: dict[int, list[np.ndarray]] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    return {d: _apart(unit(_scaled(np.array(vs, float))), cells) for d, vs in by_dim.items()}


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their squares neither overflow nor vanish: no digit and no cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _apart(candidates: np.ndarray, cells: int) -> np.ndarray:
    kept = np.zeros((0, candidates.shape[1]))
    for i in range(0, len(candidates), 512):
        part = candidates[i : i + 512]
        part = part[~(part @ kept.T >= APART).any(1)]
        near = np.triu(part @ part.T >= APART, 1)
        alone = np.ones(len(part), bool)
        for k in range(len(part)):
            if alone[k]:
                alone &= ~near[k]
        kept = np.concatenate([kept, part[alone]])[:cells]
    rest = np.random.default_rng((SEED, 1, candidates.shape[1])).normal(size=(cells - len(kept), candidates.shape[1]))
    return np.concatenate([kept, unit(rest) if len(rest) else rest])


def _checked(batch: pa.RecordBatch, column: str) -> list[np.ndarray | None]:
    """The vectors of a column in their own precision; None for those that link with nothing."""
    out = []
    for v in batch.column(column):
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False)
            if not np.isfinite(x).all() or not x.any():
                x = None
        out.append(x)
    return out


def _links(rows: pa.Table, cell: int, across: bool, kind: type, least: float, deviations: float | None):
    """(links, roots) of the rows of one task: numbers of vectors linked with each, and the row each is connected to.

    Whether a pair links depends on the two vectors alone: where a product of blocks comes too close to the threshold to
    decide, the pair is computed by itself.
    """
    counts, own = rows["copies"].to_numpy(), rows["own"].to_numpy()
    raw = _scaled(np.frombuffer(b"".join(rows["vector"].to_pylist()), kind).reshape(len(counts), -1).astype(float))
    cells = np.frombuffer(b"".join(rows["cells"].to_pylist()), np.int32).reshape(len(counts), -1)
    norms = np.linalg.norm(raw, axis=1)
    units = raw / norms[:, None]
    codes, factors = encode(units)
    links, label = np.zeros(len(counts), np.int64), np.arange(len(counts))
    for q in range(0, len(counts), 256):
        part = slice(q, q + 256)
        if deviations is None:
            likely = np.ones((len(units[part]), len(units) - q), bool)
        else:
            estimate, error = bounds(units[part], codes[q:], factors[q:], deviations)
            likely = estimate + error >= least
        likely &= np.arange(likely.shape[1]) > np.arange(likely.shape[0])[:, None]
        if across:
            likely &= own[part, None] != own[q:]
        if likely.mean() > 0.05:  # a dense block costs less as one product
            near = units[part] @ units[q:].T
            likely &= near >= least - BORDER
            a, b = np.nonzero(likely)
            sure = near[a, b] > least + BORDER
        else:
            a, b = np.nonzero(likely)
            sure = np.zeros(len(a), bool)
        a, b = a + q, b + q
        for i in range(0, len(a), 1 << 16):
            x, y, hit = a[i : i + (1 << 16)], b[i : i + (1 << 16)], sure[i : i + (1 << 16)].copy()
            open_ = np.flatnonzero(~hit)
            hit[open_] = np.einsum("ij,ij->i", raw[x[open_]], raw[y[open_]]) / (norms[x[open_]] * norms[y[open_]]) >= least
            x, y = x[hit], y[hit]
            earlier = np.zeros(len(x), bool)  # both are in a cell before this one, where the pair is counted
            for k in range(cells.shape[1]):
                own_cell = cells[x, k]
                earlier |= (own_cell < cell) & (cells[y] == own_cell[:, None]).any(1)
            x, y = x[~earlier], y[~earlier]
            links += np.bincount(x, counts[y], len(counts)).astype(np.int64) + np.bincount(y, counts[x], len(counts)).astype(np.int64)
            label = local_roots(len(counts), x, y, label)
    return links, label


def _tasks(batches: Iterator[pa.RecordBatch], keys: list[str], block: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """The rows of each task of several vectors, with its keys, from batches sorted by these."""
    for chunk in chunked(batches, keys, block):
        marks = np.stack([chunk[k].to_numpy() for k in keys], 1)
        starts = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1, [len(marks)]])
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s > 1:
                yield chunk.slice(s, e - s), marks[s].tolist()


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK,
    nearest: int | None = NEAREST, most_cells: int = MOST_CELLS, deviations: float | None = DEVIATIONS,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    n_links: the other rows whose cosine with it, in double precision, is at least `least`; component_id: the smallest id that links lead to, its own
    included; kept: whether that is its own. Vectors that are null, empty or zero, or hold a null or a number that isn't finite, link with
    nothing; so do vectors of different lengths. Rows link by their vectors, whatever their ids: rows that share an id have
    their own links, and rows without one link like any other and get the smallest id of their component, or null where
    there is none; kept is null for them. Ids may be of any type with an order. An empty table gives no row, very long vectors cost memory by
    their length, and other columns, whatever their names, are not read.

    nearest, most_cells and deviations trade recall for work; nearest=None, deviations=None computes every pair, in blocks.
    """
    spark = vectors.sparkSession
    ship(spark)
    double = "double" in vectors.schema[vector_col].dataType.simpleString()
    kind, width = (np.float64, 8) if double else (np.float32, 4)
    id_kind = vectors.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if v is None else v.astype(kind).tobytes() for v in _checked(batch, "vector")]
            keys = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in raw]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["id", "key", "vector"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInArrow(read, f"id {id_kind}, key binary, vector binary")
    rows = materialise(rows)
    classes = materialise(rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    keys, past = ["dim", "cell", "i", "j"], []
    if nearest is None:
        dealt = classes.select((F.octet_length("vector") / width).cast("int").alias("dim"), F.lit(0).alias("cell"), "key", F.lit(b"\0" * 4).alias("cells"), "copies", "vector")
    else:
        n = classes.count()
        cells = int(min(most_cells, max(16, (nearest * n) ** 0.5)))
        taken = classes.orderBy("key").limit(SAMPLE_PER_CELL * cells).select("vector").collect()  # at most 3 * most_cells; keys are hashes
        shared = spark.sparkContext.broadcast(centers_from([np.frombuffer(r["vector"], kind) for r in taken], cells))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = batch.column("vector").to_pylist()
                for d in sorted({len(v) // width for v in raw}):
                    here = np.array([i for i, v in enumerate(raw) if len(v) == d * width])
                    centers = shared.value.get(d)
                    if centers is None:
                        centers = _apart(np.ones((1, d)) / np.sqrt(d), cells)
                    for i in range(0, len(here), 1024):
                        part = here[i : i + 1024]
                        units = unit(_scaled(np.frombuffer(b"".join(raw[k] for k in part), kind).reshape(-1, d).astype(float)))
                        codes, factors = encode(units)
                        near = np.sort(np.argpartition(-(units @ centers.T), nearest, axis=1)[:, :nearest], axis=1).astype(np.int32)
                        rep = np.repeat(np.arange(len(part)), nearest)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(rep), d, np.int32)), pa.array(near.ravel()), batch.column("key").take(pa.array(part[rep])),
                                pa.array([near[k].tobytes() for k in rep], pa.binary()), pa.array([codes[k].tobytes() for k in rep], pa.binary()), pa.array(factors[rep]),
                            ],
                            names=["dim", "cell", "key", "cells", "code", "factor"],
                        )

        def hope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, (d, _, i, j) in _tasks(batches, keys, block):
                codes = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(part.num_rows, -1)
                hit = hopeful(codes, part["factor"].to_numpy(), d, least, deviations, part["own"].to_numpy() if i != j else None)
                yield from part.select(["dim", "cell", "key", "cells"]).filter(pa.array(hit)).combine_chunks().to_batches()

        coded = materialise(classes.select("key", "vector").mapInArrow(deal, "dim int, cell int, key binary, cells binary, code binary, factor double"))
        if deviations is None:
            found = coded.select("dim", "cell", "key", "cells")
        else:
            met = blocked(coded, ["dim", "cell"], "key", block).repartition(*keys).sortWithinPartitions(*keys)
            found = materialise(met.mapInArrow(hope, "dim int, cell int, key binary, cells binary").distinct())
            past.append(found)
        past.append(coded)
        dealt = found.join(classes.select("key", "copies", "vector"), "key").select("dim", "cell", "key", "cells", "copies", "vector")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, cell, i, j) in _tasks(batches, keys, block):
            links, label = _links(part, cell, i != j, kind, least, deviations)
            hit = np.flatnonzero(links)
            named = part["key"].combine_chunks()
            yield pa.RecordBatch.from_arrays([named.take(pa.array(hit)), named.take(pa.array(label[hit])), pa.array(links[hit])], names=["a", "b", "n"])

    dealt = materialise(dealt)
    drop(*past)
    tasks = blocked(dealt, ["dim", "cell"], "key", block).repartition(*keys).sortWithinPartitions(*keys)
    found = materialise(tasks.mapInArrow(link, "a binary, b binary, n long"))
    totals = materialise(found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "key"))
    roots = components(found.select("a", "b")).withColumnRenamed("node", "key")
    named = materialise(
        classes.select("key", "id", "copies").join(totals, "key", "left").join(roots, "key", "left")
        .select("key", "id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("root"))
    )
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = materialise(named.join(smallest, "root").select("key", "n_links", "component_id"))
    drop(classes, dealt, found, totals)
    valid = rows.filter("key is not null").select("id", "key").join(named, "key").select("id", "n_links", "component_id")
    alone = rows.filter("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return valid.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
