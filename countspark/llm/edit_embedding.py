"""Fingerprints by randomised edit embedding.

A shared random walk reads a text: at each step it writes the character it stands on, and a random bit of the step and the
character says whether it moves on. Texts at a small edit distance fall into step again soon after each edit, so
edit distance becomes Hamming distance between the written sequences. The fingerprint samples these at shared random steps.
Each sample has its own endless list of steps, thinning out, and takes the last one within the text's own walk: that is
a uniform choice for every length, and texts of like lengths choose alike. Equal samples in a band of the fingerprint make
candidates, which the whole fingerprints verify.
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

SAMPLES = 128  # of one byte each
PERIOD, CLASSES = 4096, 64  # the random bits repeat after so many steps; characters share them by so many classes
SEED = 20


class _Moves(dict):
    """For each character, the step after the one at which the walk leaves it, by the step at which it comes there."""

    def __init__(self):
        super().__init__()
        bits = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD))
        bits[:, -1] = 1
        steps = np.arange(PERIOD)
        self.tables = []
        for row in bits:
            leaves = np.where(row == 1, steps, PERIOD)
            self.tables.append(((np.minimum.accumulate(leaves[::-1])[::-1] + 1) % PERIOD).tolist())

    def __missing__(self, c: str) -> list[int]:
        table = self[c] = self.tables[(ord(c) * 2654435761 >> 12) % CLASSES]
        return table


@lru_cache(maxsize=1)
def _shared() -> tuple[_Moves, np.ndarray]:
    """The walk's moves, and for each sample the steps it may take, rising."""
    draws = np.random.default_rng(SEED + 1).random((SAMPLES, 96))
    at, rows = np.zeros(SAMPLES), [np.zeros(SAMPLES)]
    for i in range(draws.shape[1]):
        at = np.minimum(np.floor(np.maximum(at, 1) / np.maximum(draws[:, i], 1e-9)) + 1, 2.0**60)
        rows.append(at)
    return _Moves(), np.array(rows).T.astype(np.int64)


def walk(text: str, at: int = 0) -> np.ndarray:
    """The steps, counted from the walk's start, after which it has left each character of the text, if it comes there at step `at`."""
    moves, _ = _shared()
    j = at % PERIOD
    steps = np.array([j := table[j] for table in map(moves.__getitem__, text)], np.int64)
    if not len(steps):
        return steps
    back = np.empty(len(steps), bool)
    back[0], back[1:] = steps[0] <= at % PERIOD, steps[1:] <= steps[:-1]
    return steps + (at - at % PERIOD) + PERIOD * np.cumsum(back)


def samples(text: str, steps: np.ndarray) -> np.ndarray:
    """One byte, 1 to 255, for each sample of a walked text; 0 everywhere for an empty text."""
    if not len(steps):
        return np.zeros(SAMPLES, np.uint8)
    _, choices = _shared()
    taken = choices[np.arange(SAMPLES), (choices < steps[-1]).sum(1) - 1]
    where = np.searchsorted(steps, taken, "right").tolist()
    codes = np.fromiter((ord(text[i]) for i in where), np.uint64, SAMPLES)
    return ((codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint binary) for every row; a null text counts as empty. Equal texts have equal fingerprints."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([samples(t, walk(t)).tobytes() for t in texts], pa.binary())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint binary").withColumnRenamed("id", id_col)


def linked(alike: DataFrame, least: float = 0.8, block: int = 2048) -> DataFrame:
    """Edges (a, b) that connect the rows (fingerprint), which are distinct, that agree in a share of `least` at least.

    Pairs are candidates if they agree in all samples of a band. There is one band more than samples in which a pair may
    differ, so no pair is lost.
    """
    ship(alike.sparkSession)
    n = int(SAMPLES * (1 - least) + 1e-6) + 1
    bounds = [SAMPLES * k // n for k in range(n + 1)]
    band = F.posexplode(F.array(*[F.xxhash64(F.substring("fingerprint", 1 + s, e - s)) for s, e in zip(bounds, bounds[1:])])).alias("band", "key")
    keys = ["band", "key", "i", "j"]
    # numbers for fingerprints find the keys that several share; the fingerprints themselves only go to these (a number of two only adds keys)
    numbered = alike.select("fingerprint", F.xxhash64("fingerprint").alias("number"))
    keyed = materialise(numbered.select("number", band))
    shared = keyed.groupBy("band", "key").count().filter("count > 1").select("band", "key")
    needed = materialise(keyed.join(shared, ["band", "key"]).groupBy("number").agg(F.collect_set(F.struct("band", "key")).alias("keys")))
    drop(keyed)
    dealt = numbered.join(needed, "number").select("fingerprint", F.explode("keys").alias("x")).select("fingerprint", "x.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunked(batches, keys, block):
            names = rows["fingerprint"].combine_chunks()
            bits = np.frombuffer(b"".join(names.to_pylist()), np.uint8).reshape(-1, SAMPLES)
            begins = np.ones(len(bits), bool)
            begins[1:] = np.any([rows[k].to_numpy()[1:] != rows[k].to_numpy()[:-1] for k in keys], 0)
            starts = np.append(np.flatnonzero(begins), len(bits))
            for s, e in zip(starts[:-1], starts[1:]):
                label = np.arange(e - s)
                for q in range(s, e if e - s > 1 else s, 256):
                    part = bits[q : min(q + 256, e)]
                    same = np.stack([(row == bits[s:e]).mean(1) for row in part])
                    a, b = np.nonzero(same >= least)
                    label = local_roots(e - s, a + q - s, b, label)
                moved = np.flatnonzero(label != np.arange(e - s))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(s + moved)), names.take(pa.array(s + label[moved]))], names=["a", "b"])

    tasks = blocked(dealt, ["band", "key"], "fingerprint", block)
    return tasks.repartition(*keys).sortWithinPartitions(*keys, "fingerprint").select("fingerprint", *keys).mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block: int = 2048) -> DataFrame:
    """(id, fingerprint hex, component_id): components of texts whose fingerprints agree in a share of `least` at least.

    Fingerprints link, whatever ids their rows have: rows that share an id may be in different components, and a row without one
    links like any other and gets the smallest id of its component, or null where there is none. Ids may be of any type with an order; null
    and empty texts are alike. Very long texts cost time by their length; an empty table gives no row; other columns, whatever their names, are not read.
    """
    by_doc = materialise(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"))
    alike = materialise(by_doc.groupBy("fingerprint").agg(F.min("id").alias("first_id")))
    edges = materialise(linked(alike.select("fingerprint"), least, block))
    roots = components(edges).withColumnRenamed("node", "fingerprint")
    rooted = materialise(alike.join(roots, "fingerprint", "left").select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(rooted.join(smallest, "root").select("fingerprint", "component_id"))
    drop(alike, edges, rooted)
    return by_doc.join(named, "fingerprint").select(F.col("id").alias(id_col), F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


class _Walked:
    """A document with its walk and samples."""

    def __init__(self, doc_id, text: str):
        self.id, self.text = doc_id, text
        self.steps = walk(text)
        self.samples = samples(text, self.steps)

    def against(self, after: _Walked) -> tuple:
        """The result row, with the end of this text replaced by the beginning of the one after."""
        k = len(self.text) // 3
        head, new = len(self.text) - k, after.text[:k]
        edited = self.text[:head] + new
        steps = self.steps[:head]
        own = samples(edited, np.concatenate([steps, walk(new, int(steps[-1]) if head else 0)])) if k else self.samples
        return (
            self.id, len(self.text), hashlib.sha256(edited.encode()).hexdigest(), self.samples.tobytes().hex(), own.tobytes().hex(),
            float((self.samples == own).mean()), float((self.samples == after.samples).mean()),
        )


COLUMNS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last third replaced by as much of the next document's beginning, in descending order of id (ties
    by the MD5 of the text, null ids last), the first document following the last. Likeness is the share of equal samples. A null text counts as empty.

    Documents are sorted over ranges of id, digest and, for rows that share both, a number dealt out in turn, so that no id is more than one
    task's. Each range is read as a stream; only its first and last document, of which there are as many as partitions, are kept with their
    texts, and each last one meets the first one of the next range by number.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    types = ["long", "string", "string", "string", "double", "double"]
    schema = f"id {kind}, " + ", ".join(f"{c} {t}" for c, t in zip(COLUMNS[1:], types))

    def batch_of(rows: list[tuple], ends: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.int64()]
        every = [(*r, None, None, None) for r in rows] + [(i, *[None] * 6, end, text, nth) for i, end, text, nth in ends]
        columns = list(zip(*every)) if every else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*COLUMNS, "end", "text", "nth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, id_type, nth = None, None, TaskContext.get().partitionId()
        for batch in batches:
            rows, ends, id_type = [], [], batch.schema.field("id").type
            for doc_id, text in zip(batch.column("id"), batch.column("text")):
                now = _Walked(doc_id.as_py(), text.as_py() or "")
                if held is None:
                    ends.append((now.id, 0, now.text, nth))
                else:
                    rows.append(held.against(now))
                held = now
                if len(rows) >= 1000:
                    yield batch_of(rows, ends, id_type)
                    rows, ends = [], []
            yield batch_of(rows, ends, id_type)
        if held is not None:
            yield batch_of([], [(held.id, 1, held.text, nth)], id_type)

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_Walked(r["id"], r["text"]).against(_Walked(None, r["next"])) for r in batch.to_pylist()]
            yield batch_of(rows, [], batch.schema.field("id").type).select(COLUMNS)

    order = [F.col("id").desc_nulls_last(), F.col("digest").asc()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), turn.alias("turn"))
    dealt = rows.repartitionByRange(*order, "turn").drop("turn")
    done = materialise(dealt.sortWithinPartitions(*order).drop("digest").mapInArrow(run, schema + ", `end` int, text string, nth long"))
    ends = done.filter("`end` is not null").select("id", "end", "text", "nth")
    full = sorted(r["nth"] for r in ends.filter("`end` = 1").select("nth").collect())  # one number a partition
    tails = ends.filter("`end` = 1").select("id", "text", "nth")
    if full:
        after = F.create_map(*[F.lit(x) for pair in zip(full, full[1:] + full[:1]) for x in pair])
        heads = ends.filter("`end` = 0").select(F.col("text").alias("next"), F.col("nth").alias("following"))
        tails = tails.withColumn("following", after[F.col("nth")]).join(heads, "following").select("id", "text", "next")
        joined = tails.mapInArrow(join_ends, schema)
        return done.filter("`end` is null").select(*COLUMNS).union(joined).withColumnRenamed("id", id_col)
    return done.select(*COLUMNS).withColumnRenamed("id", id_col)
