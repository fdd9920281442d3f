"""Byte-level BPE by prefix dynamic programming, with exact appends and re-encoding near edits.

A sequence of tokens is the BPE encoding of its bytes exactly if each two neighbours are the encoding of theirs. So every
prefix of a piece has one valid last token: the one token that ends there and may follow the valid last token of what is
before it. A table of these last tokens is an encoding that grows with appended bytes, and that after an edit needs new
entries only until as many entries as the longest token has bytes agree with the old ones.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countspark.llm.common import at_work, keeps, ship
from countspark.llm.split import byte_bpe_pieces

CACHE = 80_000_000  # bytes, about, of pieces and ids that a worker keeps
ENTRY = 180  # bytes that an entry takes beside its characters and ids
PAIRS = 400_000  # pairs of neighbours whose validity a worker keeps


class PrefixBpe:
    """A vocabulary of ranked byte strings, and the rules that follow from it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._follows: dict[int, bool] = {}
        self.size = max(self.tokens) + 1
        self.usable = {t: i for t, i in ranks.items() if self.halves(i)}
        # The length of the longest token that ends in some three bytes.
        self.reach: dict[bytes, int] = {}
        for t in self.usable:
            self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 0))

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; (token, token) for one byte; None if no merges lead to it."""
        if token not in self._halves:
            text = self.tokens[token]
            found = (token, token) if len(text) == 1 else None
            for cut in range(1, len(text)):
                a, b = self.ranks.get(text[:cut]), self.ranks.get(text[cut:])
                if a is None or b is None or max(a, b) >= token and len(text) > 2:
                    continue
                if self.halves(a) and self.halves(b) and self._stays(a, b, token):
                    found = (a, b)
                    break
            self._halves[token] = found
        return self._halves[token]

    def _stays(self, left: int, right: int, bound: float) -> bool:
        """True if no merge of a rank below bound, nor any that comes before the last one beside it, crosses the border."""
        while True:
            joint = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joint is not None and joint < bound and self.halves(joint) == (left, right):
                return False
            # Undo the later of the two merges next to the border; the earlier ones were made before it.
            whole_left, whole_right = len(self.tokens[left]) == 1, len(self.tokens[right]) == 1
            if whole_left and whole_right:
                return True
            if not whole_left and (whole_right or left > right):
                bound, left = left, self.halves(left)[1]
            else:
                # Merges of equal rank are made from the left, so one across the border of the same rank would come first.
                bound, right = right + 1, self.halves(right)[0]

    def may_follow(self, left: int, right: int) -> bool:
        key = left * self.size + right
        if (known := self._follows.get(key)) is None:
            if len(self._follows) > PAIRS:
                self._follows.clear()
            known = self._follows[key] = self._stays(left, right, float("inf"))
        return known

    def extend(self, text: bytes, last: list[int], stop: Callable[[int], bool] | None = None) -> None:
        """Append the valid last token of each further prefix of text to last; stop(prefix length) ends it early."""
        usable, reach, size, follows = self.usable.get, self.reach.get, self.size, self._follows.get
        for end in range(len(last) + 1, len(text) + 1):
            start = end - reach(text[end - 3 : end], 2) if end > 2 else 0
            for start in range(max(start, 0), end):
                if (token := usable(text[start:end])) is None:
                    continue
                if start:
                    if (known := follows(last[start - 1] * size + token)) is None:
                        known = self.may_follow(last[start - 1], token)
                    if not known:
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"the vocabulary lacks the byte {text[end - 1 : end]!r}")
            if stop and stop(end):
                return

    def read(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens holds."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        last: list[int] = []
        self.extend(piece, last)
        return self.read(last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PieceTable:
    """One piece's bytes and last tokens, kept up to date under appends and edits."""

    def __init__(self, bpe: PrefixBpe, piece: bytes = b""):
        self.bpe, self.text, self.last, self.computed = bpe, b"", [], 0
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.text += more
        self.computed += len(more)
        self.bpe.extend(self.text, self.last)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes start:end; entries before start stay, and so do those after the table has come into step again."""
        old, shift = self.last, len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        self.last = old[:start]
        after, same = start + len(new), 0

        def in_step(n: int) -> bool:
            nonlocal same
            if n > after:
                same = same + 1 if self.last[n - 1] == old[n - 1 - shift] else 0
            return same >= self.bpe.longest

        self.bpe.extend(self.text, self.last, in_step)
        self.computed += len(self.last) - start
        self.last += old[len(self.last) - shift :]

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.text)
        return [whole] if whole is not None else self.bpe.read(self.last)


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    with open(path, "rb") as f:
        return PrefixBpe({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})


class _Packed(dict):
    """The ids of pieces as little-endian bytes, encoded when first asked for."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe, self.held = bpe, 0
        self.packed = {i: i.to_bytes(4, "little") for i in bpe.tokens}.__getitem__

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = b"".join(map(self.packed, self.bpe.encode(piece.encode())))
        self.held += len(piece) + len(ids) + ENTRY
        if self.held > CACHE:
            self.clear()
            self.held = 0
        return ids


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tuple[Callable[[str], list[str]], _Packed]:
    return byte_bpe_pieces(pattern), _Packed(load(path))


def _forget() -> None:
    load.cache_clear()
    _encoder.cache_clear()


keeps("bpe", _forget)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for every row: ids are the text's tokens as little-endian unsigned 32-bit integers.

    Each match of the pattern is encoded separately, without special tokens. A null text counts as empty: no tokens. Repeated
    rows are encoded each; a very long text takes time and memory linear in it. Other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("bpe")
        pieces, packed = _encoder(path, pattern)
        for batch in batches:
            ids = [b"".join(map(packed.__getitem__, pieces(t.as_py() or ""))) for t in batch.column(1)]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return found.mapInArrow(run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encode() with a further column decoded: the bytes of their ids. Null ids give null."""
    ship(encoded.sparkSession)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("bpe")
        bpe = load(path)
        for batch in batches:
            out = [None if x.as_py() is None else bpe.decode(np.frombuffer(x.as_py(), "<u4").tolist()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
