"""SimHash near-duplicates: 64-bit fingerprints, linked at a few differing bits through a Gray-order hierarchical index.

Fingerprints are deduplicated first, so a group of copies is one row. Two fingerprints that differ in at most D bits agree
in k of D + k bit blocks; each choice of k blocks deals the fingerprints by its bits, and k grows with their number, so that
groups stay small. Within a dealt group, a tree is built over the
fingerprints in Gray order: its upper nodes hold the bits that all members share, its lower nodes the rest, and a query
adds up differing bits on its way down and leaves whole groups as soon as they exceed D. Groups too large for one task are
split into blocks, of which every pair is a task of its own, so no link is lost and no task is unbounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from countspark.llm.common import blocked, components, drop, materialise, ship

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LEAF, FANOUT = 16, 8  # rows of a lowest node, children of each other node
CHUNK = 4096  # rows that are indexed together
QUERIES = 256  # rows that descend the index together


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The 64-bit SimHash of a UTF-8 text; 0 where it has no word."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        starts = [0, *(e + 1 for e in ends)]
        hashes = [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :])]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) for every row; a null text counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def gray_rank(x: F.Column) -> F.Column:
    """The position of a 64-bit code in the Gray sequence: the exclusive-or of all its right shifts."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


class GrayIndex:
    """A tree over fingerprints in Gray order, whose nodes hold the shared bits that no node above them holds."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.levels = fps, []
        size = LEAF
        while True:
            starts = np.arange(0, len(fps), size)
            ones, any_ = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
            self.levels.append([size, ~(ones ^ any_), ones])
            if len(starts) <= FANOUT:
                break
            size *= FANOUT
        self.levels.reverse()
        for (_, up, _), level in reversed(list(zip(self.levels, self.levels[1:]))):
            above = np.repeat(up, FANOUT)[: len(level[1])]
            level[1] = level[1] & ~above

    def within(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, row) pairs at most so many bits apart."""
        n = len(self.levels[0][1])
        q, node = np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        apart = np.zeros(len(q), np.uint8)
        for at, (_, mask, ones) in enumerate(self.levels):
            if at:
                q, node, apart = self._children(q, node, apart, FANOUT, len(mask))
            apart = apart + np.bitwise_count((queries[q] ^ ones[node]) & mask[node])
            keep = apart <= most
            q, node, apart = q[keep], node[keep], apart[keep]
        q, row, _ = self._children(q, node, apart, LEAF, len(self.fps))
        keep = np.bitwise_count(queries[q] ^ self.fps[row]) <= most
        return q[keep], row[keep]

    @staticmethod
    def _children(q, node, apart, fanout, n):
        child = (node[:, None] * fanout + np.arange(fanout)).ravel()
        keep = child < n
        return np.repeat(q, fanout)[keep], child[keep], np.repeat(apart, fanout)[keep]


def local_roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes, the smallest node that the pairs (a, b) lead to; label: what earlier pairs led to."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (label[a], label[b], a, b):
            np.minimum.at(new, ends, low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _link(rows: pa.Table, most: int) -> pa.RecordBatch:
    """Edges from each fingerprint of a chunk to the first of those it is linked with there."""
    fps = rows["fp"].to_numpy()
    index, label = GrayIndex(fps.view(np.uint64)), np.arange(len(fps))
    for i in range(0, len(fps), QUERIES):
        q, row = index.within(index.fps[i : i + QUERIES], most)
        q += i
        keep = row > q
        label = local_roots(len(fps), q[keep], row[keep], label)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[label[moved]])], names=["a", "b"])


def chunked(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Whole runs of equal keys from sorted batches, gathered to so many rows at least; only the last may have fewer."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            take = max(1, min(batch.num_rows, least))
            held.append(batch.slice(0, take))
            batch, n = batch.slice(take), n + take
            if n < least:
                continue
            rows = pa.Table.from_batches(held)
            change = np.zeros(rows.num_rows - 1, bool)
            for k in keys:
                v = rows[k].to_numpy()
                change |= v[1:] != v[:-1]
            if len(ends := np.flatnonzero(change)):
                yield rows.slice(0, int(ends[-1]) + 1)
                rows = rows.slice(int(ends[-1]) + 1)
            held, n = rows.to_batches(), rows.num_rows
    if n:
        yield pa.Table.from_batches(held)


def tables(n: int, most: int, block: int = CHUNK) -> list[int]:
    """Masks of the bits that deal n fingerprints: two at most `most` bits apart agree in all bits of one of them, whatever n.

    There are as many more bits in each as keep a group of evenly spread fingerprints at a quarter of a block; in the end, all
    choices of that many blocks.
    """
    for k in range(1, 4):
        bounds = [round(64 * i / (most + k)) for i in range(most + k + 1)]
        blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(bounds, bounds[1:])]
        masks = [sum(c) for c in combinations(blocks, k)]
        if n <= block // 4 << min(m.bit_count() for m in masks):
            break
    return masks


def links(fps: DataFrame, most: int = 4, block: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect the rows (fp), which are distinct, whose fingerprints differ in at most `most` bits."""
    ship(fps.sparkSession)
    masks = tables(fps.count(), most, block)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    turned = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    dealt = fps.select("fp", gray_rank(F.col("fp")).alias("rank"), F.explode(turned).alias("x")).select("fp", "rank", "x.*")
    keys = ["band", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunked(batches, keys, CHUNK):
            yield _link(rows, most)

    tasks = blocked(dealt, ["band", "key"], "fp", block).select(*keys, "rank", "fp")
    return tasks.repartition(*keys).sortWithinPartitions(*keys, "rank").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """(id, fingerprint hex, component_id) for every row of docs.

    component_id: the smallest id reachable by links, the row's own included. A null text counts as empty; empty texts
    have the fingerprint zero and are linked like any other. Rows with equal texts have equal fingerprints. A row whose
    id is null links like any other and gets the smallest id of its component, or null where no row with an id is in it. Ids
    may be of any type with an order. Very long texts cost time and memory by their length, an empty table gives no row,
    and other columns, whatever their names, are not read.
    """
    by_doc = materialise(fingerprints(docs, id_col, text_col, shingle))
    fps = materialise(by_doc.groupBy("fp").agg(F.min("id").alias("first_id")))
    edges = materialise(links(fps.select("fp"), most))
    roots = components(edges).withColumnRenamed("node", "fp")
    rooted = materialise(fps.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(rooted.join(smallest, "root").select("fp", "component_id"))
    drop(fps, edges, rooted)
    return by_doc.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] = near_duplicates, **how) -> DataFrame:
    """The rows of docs, all columns, of which each group of near-duplicates leaves one: that with the smallest id, rows without an id last.

    Groups are of texts, and rows decide by id and text together: rows of one id may be in different groups, and each of these leaves
    its own. Of rows that share id and text, in effect, the one with the smallest hash of all its columns stays. An empty table stays
    empty, and very long texts only cost what find() asks for them. find: gives each row's component_id, the smallest id of its group.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("text"))
    found = find(docs.select(row.alias("_row"), F.col(text_col).alias("_text")), "_row", "_text", **how)
    leaders = materialise(found.filter(F.col("_row") == F.col("component_id")).groupBy("_row").agg(F.count("*").alias("_rows")))
    named = docs.withColumn("_row", row)
    kept = named.join(leaders.filter("_rows = 1").select("_row"), "_row", "left_semi").select(*docs.columns)
    repeated = leaders.filter("_rows > 1").select("_row")
    if repeated.limit(1).count():
        again = named.join(repeated, "_row", "left_semi").groupBy("_row")
        kept = kept.unionByName(again.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("x")).select("x.*"))
    return kept
