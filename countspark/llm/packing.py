"""Best-fit packing of token sequences by matching the large items first.

Pieces above a third of the capacity share a bin with at most one other such piece: the longest is matched with the
longest that still fits. Shorter pieces then go, longest first, where the least room is left. Lengths are integers up to the
capacity, so all this is decided on their histogram: equal bins are one run of sequence numbers with a common gap.
The decision is a list of segments: of the pieces of one length, those with ranks first to first + count - 1 go, `each` to a
bin, into the bins from `bin` on, at `offset`. A gap at least halves whenever pieces are put into it, so there are
at most log2(capacity) segments for each run, and at most a few runs for each length, however many pieces there are.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countspark.llm.common import at_work, keeps, materialise, ship
from countspark.llm.split import usual, word_bpe_pieces

CACHE = 100_000_000  # bytes, about, of pieces and ids that a worker keeps
CHARS = 4_000_000  # of texts whose words are looked up together, unless one text is longer
PIECES = 4096  # that the tokenizer gets at once
IDS = 1_000_000  # that are held as numbers, unless one text has more; a batch of Spark's has 10,000 texts
ENTRY = 180  # bytes that an entry takes beside its characters and ids


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive items of `most` in sum, or of one larger item."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, most + (upto[at - 1] if at else 0), "right")))
        yield at, end
        at = end


class _WordIds:
    """A tokenizer that looks words up for many texts at once: each different word between white space is split once, into pieces whose ids are kept.

    No piece holds white space, so the ids of a text are those of its words, one after the other.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.known: dict[str, bytes] = {}  # of this very type: a set's difference() looks up in it instead of walking it
        self.held = 0
        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def ids(self, text: str) -> bytes:
        """What the tokenizer gives for a text, as little-endian unsigned 32-bit integers."""
        return b"".join(x.to_pylist()[0] for x in self.of([text]))

    def of(self, texts: list[str], end: bytes = b"") -> Iterator[pa.Array]:
        """The ids of all texts in turn, each followed by `end`, as arrays of binaries."""
        for a, b in _runs(np.array([len(t) for t in texts]), CHARS):
            yield from self._block(texts[a:b], end)

    def _block(self, texts: list[str], end: bytes) -> Iterator[pa.Array]:
        # Texts of usual characters without special tokens go by words, the others whole; a last entry of each text holds what isn't words.
        tails, last, low = [end], np.zeros(len(texts), np.int32), []
        for i, text in enumerate(texts):
            lowered = text.lower()
            if "<|" in text or not usual(lowered):
                last[i] = len(tails)
                tails.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + end)
                lowered = ""
            low.append(lowered)
        split = pc.ascii_split_whitespace(pa.array(low, pa.large_string()))
        del low
        coded = split.values.dictionary_encode()
        words, codes, ends = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), split.offsets.to_numpy()
        del split, coded
        found, sizes = self._words(words)
        pool = np.frombuffer(found + b"".join(tails), "<u4")
        sizes = np.concatenate([sizes, np.array([len(t) // 4 for t in tails])])
        starts = np.cumsum(sizes) - sizes
        n_words = np.diff(ends)
        before = np.concatenate([[0], np.cumsum(sizes[codes])])[ends]
        for a, b in _runs(np.diff(before) + sizes[len(words) + last], IDS):
            own = np.insert(codes[ends[a] : ends[b]], ends[a + 1 : b + 1] - ends[a], len(words) + last[a:b])
            counts = sizes[own]
            upto = np.cumsum(counts)
            ids = pool[np.repeat(starts[own] - upto + counts, counts) + np.arange(upto[-1])]
            offsets = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(n_words[a:b] + 1)])]
            yield pa.Array.from_buffers(pa.binary(), b - a, [None, pa.array(4 * offsets, pa.int32()).buffers()[1], pa.py_buffer(ids)])

    def _words(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """The ids of all words in turn, and how many each has."""
        parts = word_bpe_pieces("\n".join(words), marks=True)
        if self.held > CACHE:
            self.known.clear()
            self.held = 0
        self.known["\n"] = b""
        missing = list(set(parts).difference(self.known))
        for some in (missing[i : i + PIECES] for i in range(0, len(missing), PIECES)):
            found = [x.ids for x in self.pieces.encode_batch_fast(some, add_special_tokens=False)]
            ends = np.cumsum([4 * len(x) for x in found]).tolist()
            packed = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
            self.held += sum(map(len, some)) + len(packed) + ENTRY * len(some)
            self.known.update(zip(some, [packed[s:e] for s, e in zip([0, *ends], ends)]))
        each = list(map(self.known.__getitem__, parts))
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))]) // 4
        marks = np.flatnonzero(np.fromiter(map("\n".__eq__, parts), bool, len(parts)))
        return b"".join(each), np.diff(upto[np.concatenate([[0], marks, [len(parts)]])])[: len(words)]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> _WordIds:
    return _WordIds(path)


keeps("packing", _tokenizer.cache_clear)


def token_ids(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): each text's ids as little-endian unsigned 32-bit integers, then end_id. A null text counts as empty."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("packing")
        tokenizer = _tokenizer(path)
        for batch in batches:
            at = 0
            for ids in tokenizer.of([t or "" for t in batch.column(1).to_pylist()], end):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), ids], names=["id", "ids"])
                at += len(ids)

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return found.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def cut(sequences: DataFrame, capacity: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, length, ids): sequences of ids in pieces of at most capacity; only longer ones are cut."""
    n = F.octet_length("ids") / 4
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity).cast("int") - 1, F.lit(0))))
    return (
        sequences.withColumn("piece", at)
        .withColumn("ids", F.substring("ids", F.col("piece") * (4 * capacity) + 1, F.lit(4 * capacity)))
        .select(id_col, "piece", (F.col("piece").cast("long") * capacity).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("length"), "ids")
    )


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Segments (length, first, count, bin, each, offset) for a histogram of lengths, and the number of bins."""
    left, used = dict(counts), dict.fromkeys(counts, 0)
    segments: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # (gap, first bin, bins), sorted
    bins = 0

    def put(length: int, count: int, at: int, each: int, offset: int) -> None:
        segments.append((length, used[length], count, at, each, offset))
        used[length] += count
        left[length] -= count

    def room(gap: int, at: int, n: int) -> None:
        if gap and n:
            bisect.insort(gaps, (gap, at, n))

    large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
    rising = large[::-1]
    for a in large:
        while left[a]:
            i = bisect.bisect_right(rising, min(a, capacity - a)) - 1
            while i >= 0 and (not left[rising[i]] or rising[i] == a and left[a] < 2):
                if not left[rising[i]]:
                    rising.pop(i)
                i -= 1
            if i < 0:
                n = left[a]
                put(a, n, bins, 1, 0)
                room(capacity - a, bins, n)
            elif rising[i] == a:
                n = left[a] // 2
                put(a, 2 * n, bins, 2, 0)
                room(capacity - 2 * a, bins, n)
            else:
                b = rising[i]
                n = min(left[a], left[b])
                put(a, n, bins, 1, 0)
                put(b, n, bins, 1, a)
                room(capacity - a - b, bins, n)
            bins += n
    for a in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        while left[a]:
            i = bisect.bisect_left(gaps, (a, -1, -1))
            if i < len(gaps):
                gap, at, n = gaps.pop(i)
            else:
                gap, at, n = capacity, bins, -(-left[a] // (capacity // a))
                bins += n
            each = gap // a
            full = min(n, left[a] // each)
            if full:
                put(a, full * each, at, each, capacity - gap)
                room(gap - each * a, at, full)
            if full < n and left[a]:
                rest = left[a]  # fewer than `each`
                put(a, rest, at + full, rest, capacity - gap)
                room(gap - rest * a, at + full, 1)
                full += 1
            room(gap, at + full, n - full)
    return segments, bins


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """The rows of pieces, which have a column length from 1 to capacity, with sequence_id and offset.

    Equal lengths are interchangeable, so each length's rows are numbered: within salts, of which a length has as many as
    the root of its count, from where the salts before end. Rows that are equal in all columns are interchangeable too, and share a salt:
    give them a column that parts them where they may be many.
    An empty table gives an empty table. Pieces must not be recomputed differently between reads: pass a written table.
    """
    spark = pieces.sparkSession
    ship(spark)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if bad := [n for n in counts if n is None or not 1 <= n <= capacity]:
        raise ValueError(f"lengths must be from 1 to {capacity}: {bad[:5]}")
    segments, _ = plan(counts, capacity)
    table = np.array(sorted(segments), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    salts = spark.createDataFrame([(n, max(1, int(c**0.5))) for n, c in counts.items()], "length long, _salts int")
    salted = pieces.join(F.broadcast(salts), "length").withColumn(
        "_salt", F.pmod(F.xxhash64(*[c for c in pieces.columns if c != "length"]), F.col("_salts")).cast("int")
    )
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")))
    at = Window.partitionBy("length", "_salt").orderBy(*[c for c in pieces.columns if c != "length"])
    ranked = (
        salted.withColumn("_row", F.row_number().over(at))
        .join(base, ["length", "_salt"])
        .select(*pieces.columns, (F.col("_base") + F.col("_row") - 1).alias("_rank"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("packing")
        length, first, _, to, each, offset = shared.value.T
        # One sorted key for the pair: where a length's segments begin, and the rank in them.
        lengths, starts = np.unique(length, return_index=True)
        ends = np.append(starts[1:], len(length))
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            seg = np.empty(len(own), np.int64)
            for n in np.unique(own):
                k = np.searchsorted(lengths, n)
                here = own == n
                seg[here] = starts[k] + np.searchsorted(first[starts[k] : ends[k]], rank[here], "right") - 1
            nth = rank - first[seg]
            columns = [*batch.columns[:-1], pa.array(to[seg] + nth // each[seg]), pa.array(offset[seg] + nth % each[seg] * own)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row's text.

    A null or empty text has one piece that holds only end_id. Rows with the same id are separate documents. Other
    columns are not read.
    """
    parts = cut(token_ids(docs, path, end_id, id_col, text_col), capacity, id_col)
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)).alias("_turn")  # written with the pieces; spreads those of equal rows over the salts
    return pack(materialise(parts.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), turn)), capacity).drop("_turn")
