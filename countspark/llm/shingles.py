"""Near-duplicates by word shingles: texts whose sets of five-word runs have a Jaccard similarity of 0.8 or more.

At that similarity 64-bit SimHashes of the five-word runs differ in about ten bits, give or take three, and bands of so few bits
as would still agree tell nothing apart. So texts are dealt by BANDS bands of PER_BAND min-hashes, of which a pair at 0.8
shares one but for 7 in a million, a pair at 0.9 always, in effect. Within a group the SimHashes' Gray-order index finds the pairs
at most BITS bits apart, of which those whose min-hashes agree as often as 0.8 makes likely (ALIKE of all: 3 in a million
fall below) are verified on all their shingles, of which 64-bit digests stand in for the words.

Before all that, operator 8's index links SimHashes at most 4 bits apart, and these links are verified in the same way; what they connect
needs no further pair. Bands are for the rest.

A band's group is a star first: every member against one other, at first the one that meets the most texts in its groups, which
for edited copies is the text that they come from. What these links connect needs no further pair; only
members of a group that are still in different components meet all others. So a large group of copies costs as many pairs as it has rows.
The others are compared within tasks: first by SimHashes and min-hashes, and those rows that may be alike to another one,
with their texts, once more. What leaves a task is at most a row for each row, however many texts just miss the bound.

Asked to be exact, texts are dealt by their smallest shingles instead: sets of n and m digests, both in one order, that are alike at 0.8 share one of
the first n / 5 + 1 and m / 5 + 1. SimHashes and sketches then exclude nothing, and no pair is lost, at the price of a key for each fifth word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from countspark.llm.common import at_work, blocked, components, drop, materialise, ship
from countspark.llm.simhash import LOWER, QUERIES, GrayIndex, chunked, gray_rank, links, local_roots, majority

SHINGLE = 5
BANDS, PER_BAND = 30, 5
STARS = 1  # rounds of stars, each with other centers
BITS, ALIKE = 26, 98  # of 64 bits, at most; of all min-hashes, at least
HELD = 2_000_000  # digests of texts, about, that a worker keeps while it verifies
SMALL, BLOCK = 512, 1024  # rows that are indexed together: so many at least, or a block of a larger group
_RNG = np.random.default_rng(8)
TIMES, PLUS = (_RNG.integers(0, 1 << 64, BANDS * PER_BAND, np.uint64) for _ in range(2))
TIMES |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """The sorted digests of the five-word runs of a UTF-8 text, each once, without regard to ASCII case and space; of a shorter one, of all its words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    said = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(said) - SHINGLE + 1)
    found = np.ones(n, np.uint64)
    for k in range(min(SHINGLE, len(said))):
        found = found * _MIX + said[k : k + n]
    found ^= found >> np.uint64(29)
    found *= _MIX
    found ^= found >> np.uint64(32)
    return np.unique(found)


def signature(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band of min-hashes, and a byte of each min-hash; no key for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64), bytes(len(TIMES))
    low = np.full(len(TIMES), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 256):
        low = np.minimum(low, (found[i : i + 256, None] * TIMES + PLUS).min(0))
    keys = np.array([xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, PER_BAND))], np.uint64)
    return keys.view(np.int64), (low % np.uint64(251)).astype(np.uint8).tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """True if the Jaccard similarity is 0.8 or more; two empty sets are alike."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return 5 * n >= 4 * (len(both) - n)


def same_words(text: F.Column) -> F.Column:
    """A digest of the words in their order, without regard to ASCII case and space; a null text counts as empty."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.md5(F.trim(F.regexp_replace(low, r"[\x09-\x0D\x20]+", " ")).cast("binary")))


def _once(rows: DataFrame) -> DataFrame:
    """The rows (same, text), each `same` once for each task, so that copies don't travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("shingles")
        seen: set[bytes] = set()
        for batch in batches:
            keys, n = batch.column("same").to_pylist(), len(seen)
            new = [k not in seen and not seen.add(k) for k in keys]
            yield batch.filter(pa.array(new, pa.bool_())) if len(seen) < n + len(keys) else batch

    return rows.mapInArrow(run, rows.schema)


def _signed(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(id, same, n, bands, fp, sketch) for every row of (id, same, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("shingles")
        for batch in batches:
            sizes, keys, fps, sketches = [], [], [], []
            for t in batch.column(2).cast(pa.large_binary()):
                text = t.as_py() or b""
                found = shingles(text)
                key, sketch = (found[: len(found) // 5 + 1].view(np.int64), b"") if exact else signature(found)
                sizes.append(len(found))
                keys.append(key)
                fps.append(majority(found))
                sketches.append(sketch)
            columns = [batch.column(1), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "same", "n", "bands", "fp", "sketch"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, same binary, n int, bands array<long>, fp long, sketch binary")


_MEMBER = "key long, band int, same binary, n int, component binary, bands array<long>, fp long, sketch binary"
_KEYS = ["key", "i", "j"]


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """Members by key, in Gray order, with the blocks of the task that each row is for."""
    tasks = blocked(members.withColumn("rank", gray_rank(F.col("fp"))), ["key"], "same", block)
    return tasks.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "rank")


def _near(rows: pa.Table, exact: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key that may be alike and are in different components, in the first band that they share."""
    index = GrayIndex(rows["fp"].to_numpy().view(np.uint64))
    if not exact:
        sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, BANDS)
    n, key, band = rows["n"].to_numpy().astype(np.int64), rows["key"].to_numpy(), rows["band"].to_numpy()
    of = rows["component"].combine_chunks().dictionary_encode().indices.to_numpy()
    for i in range(0, len(n), QUERIES):
        a, b = index.within(index.fps[i : i + QUERIES], 64 if exact else BITS)
        a += i
        keep = (a < b) & (key[a] == key[b]) & (of[a] != of[b]) & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))
        a, b = a[keep], b[keep]
        for k in range(0, len(a), 1 << 15):
            x, y = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
            if exact:
                yield x, y
                continue
            hit = (bands[x] == bands[y]).argmax(1) == band[x]
            x, y = x[hit], y[hit]
            hit = (sketches[x] == sketches[y]).sum(1) >= ALIKE
            yield x[hit], y[hit]


def _hopeful(members: DataFrame, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """The members (key, band, same, n, component, fp, sketch) that may be alike to another one of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("shingles")
        for rows in chunked(batches, _KEYS, SMALL):
            hope = np.zeros(rows.num_rows, bool)
            for a, b in _near(rows, exact):
                hope[a] = hope[b] = True
            yield from rows.select(_names(_MEMBER)).filter(pa.array(hope)).to_batches()

    return _dealt(members, block).mapInArrow(run, _MEMBER).distinct()


def _alike(members: DataFrame, texts: DataFrame, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """Edges (a, b) that connect the members of each key whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("shingles")
        for rows in chunked(batches, _KEYS, SMALL):
            label, known, text = np.arange(rows.num_rows), {}, rows["text"].combine_chunks().cast(pa.large_binary())
            for a, b in _near(rows, exact):
                open_ = label[a] != label[b]  # the others are connected by now
                found = []
                for x, y in zip(a[open_].tolist(), b[open_].tolist()):
                    for z in (x, y):
                        if z not in known:
                            known[z] = shingles(text[z].as_py() or b"")
                    found.append(alike(known[x], known[y]))
                hit = np.array(found, bool)
                label = local_roots(rows.num_rows, a[open_][hit], b[open_][hit], label)
            moved, names = np.flatnonzero(label != np.arange(len(label))), rows["same"].combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(label[moved]))], names=["a", "b"])

    return _dealt(members.join(texts, "same"), block).mapInArrow(run, "a binary, b binary")


def _simhash_pairs(first: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts that operator 8's index links by their SimHashes: one text of each SimHash with its others, and with one of each that it is linked to."""
    of = materialise(first.groupBy("fp").agg(F.min("same").alias("one")))
    near = links(of.select("fp"))
    ends = near.join(of.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b").select("x", "y")
    equal = first.select("fp", "same").join(of, "fp").filter("same <> one").select(F.col("one").alias("x"), F.col("same").alias("y"))
    pairs = materialise(ends.unionByName(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    drop(of)
    return pairs


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("shingles")
        known: dict[bytes, np.ndarray] = {}
        held = 0

        def of(key: bytes, text: pa.Scalar) -> np.ndarray:
            nonlocal held
            if (found := known.get(key)) is None:
                if held > HELD:
                    known.clear()
                    held = 0
                found = known[key] = shingles(text.as_py() or b"")
                held += len(found) + 32
            return found

        for batch in batches:
            names, texts = [c.to_pylist() for c in batch.columns[:2]], [c.cast(pa.large_binary()) for c in batch.columns[2:]]
            keep = [alike(of(a, s), of(b, t)) for a, b, s, t in zip(*names, *texts)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left = pairs.join(texts.withColumnsRenamed({"same": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"same": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stars: int = STARS, exact: bool = False) -> DataFrame:
    """(id, component_id) for every row of docs: the smallest id reachable by links, the row's own included.

    A null text counts as empty; texts without words are alike. Rows link by their texts: those that share an id may be in
    different components, and a row without one links like any other and gets the smallest id of its component, or null
    where there is none. Ids may be of any type with an order. Very long texts cost time by their length, an empty table gives no row, and
    other columns, whatever their names, are not read. exact: lose no pair at all (see above), where the default loses 7 in a million at exactly 0.8.
    """
    ship(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), same_words(F.col(text_col)).alias("same"), F.col(text_col).alias("text"))
    by_doc = materialise(_signed(given, exact))
    first = materialise(by_doc.groupBy("same").agg(F.min("id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "bands", "fp", "sketch")]))
    # a number stands for a text until it is known which keys several share; a number of two texts only gives both their keys
    numbered = first.select("same", "n", "bands", F.xxhash64("same").alias("number"))
    keyed = materialise(numbered.select("number", F.explode("bands").alias("key")))
    shared = materialise(keyed.groupBy("key").count().filter("count > 1"))
    met = keyed.join(shared, "key").groupBy("number").agg(F.collect_set(F.struct("key", "count")).alias("keys"))  # as many as a text has bands
    needed = materialise(numbered.join(met, "number").withColumn("met", F.aggregate("keys", F.lit(0).cast("long"), lambda s, x: s + x["count"])))
    linked = _simhash_pairs(first)
    ours = needed.select("same").union(linked.select("a")).union(linked.select("b"))
    texts = materialise(_once(given.select("same", "text")).join(ours, "same", "left_semi").groupBy("same").agg(F.first("text").alias("text")))
    edges = materialise(_verified(linked, texts))
    roots = materialise(components(edges).withColumnRenamed("node", "same").withColumnRenamed("component", "root"))
    each = needed.select("same", "n", "met", "bands", F.explode("keys.key").alias("key")).withColumn("band", F.array_position("bands", F.col("key")).cast("int") - 1)
    rooted = each.filter("band >= 0").join(roots, "same", "left")
    open_ = materialise(rooted.select("key", "band", "same", "n", "met", F.coalesce("root", "same").alias("component")))
    drop(keyed, shared, needed, linked, roots)
    for turn in range(stars):
        order = F.struct(F.col("met") if turn == 0 else F.lit(0), F.xxhash64("same", F.lit(turn)))
        center = open_.groupBy("key").agg(F.max_by(F.struct("same", "n", "component"), order).alias("c"))
        other = materialise(center.select("key", F.col("c.same").alias("other"), F.col("c.n").alias("m"), F.col("c.component").alias("theirs")))
        near = F.least("n", "m") * 5 >= F.greatest("n", "m") * 4  # others can't be alike
        met = open_.join(other, "key").filter((F.col("component") != F.col("theirs")) & near)
        pairs = materialise(met.select(F.least("same", "other").alias("a"), F.greatest("same", "other").alias("b")).distinct())
        found = materialise(edges.unionByName(_verified(pairs, texts)))
        roots = materialise(components(found).withColumnRenamed("node", "same").withColumnRenamed("component", "root"))
        now = materialise(open_.join(roots, "same", "left").select("key", "band", "same", "n", "met", F.coalesce("root", "same").alias("component")))
        mixed = materialise(now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key"))
        after = materialise(now.join(mixed, "key"))
        drop(edges, open_, other, pairs, roots, now, mixed)
        edges, open_ = found, after
    members = open_.join(first.select("same", "bands", "fp", "sketch"), "same").select(_names(_MEMBER))
    hopeful = materialise(_hopeful(members, exact=exact))
    drop(open_)
    found = materialise(edges.unionByName(_alike(hopeful, texts, exact=exact)))
    drop(edges, hopeful)
    edges = found
    roots = components(edges).withColumnRenamed("node", "same")
    rooted = materialise(first.join(roots, "same", "left").select("same", "first_id", F.coalesce("component", "same").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(rooted.join(smallest, "root").select("same", "component_id"))
    drop(first, texts, edges, rooted)
    return by_doc.join(named, "same").select(F.col("id").alias(id_col), "component_id")
