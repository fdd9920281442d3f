"""Greedy longest-match word-piece lengths, counted in one pass over the characters without building pieces.

A trie of the vocabulary gets failure links: where a node has no child for the next character, the link leads to the node
of what is left after the pieces that are certain by then are taken off, and the number of these is stored
with the link. A word's length is the sum of the numbers on the links that it takes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Collection, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countspark.llm.common import at_work, keeps, ship

CACHE = 30_000_000  # characters of words whose lengths a worker keeps, and as much for each word as 64 of them
_UNKNOWN = 1 << 40  # added to the count of a word that the vocabulary can't spell
_START, _INSIDE = 0, 1  # the roots for the beginning of a word and for what follows in it


class PieceCounter:
    """Counts pieces of words. starts: the pieces that begin a word, "" being a bare word mark; insides: those that continue one."""

    def __init__(self, starts: Collection[str], insides: Collection[str]):
        self.child: dict[tuple[int, str], int] = {}
        ends: set[int] = set()
        below: list[list[tuple[str, int]]] = [[], []]
        for root, pieces in ((_START, starts), (_INSIDE, insides)):
            for piece in pieces:
                node = root
                for c in piece:
                    if (step := self.child.get((node, c))) is None:
                        step = self.child[node, c] = len(below)
                        below[node].append((c, step))
                        below.append([])
                    node = step
                if piece:
                    ends.add(node)
        self.link: list[int | None] = [None] * len(below)
        self.popped = [0] * len(below)
        if "" in starts:  # a word that no longer piece begins starts with the bare mark
            self.link[_START], self.popped[_START] = _INSIDE, 1
        queue = deque([_START, _INSIDE])
        while queue:
            node = queue.popleft()
            for c, step in below[node]:
                if step in ends:
                    self.link[step], self.popped[step] = _INSIDE, 1
                else:
                    at, n = self.link[node], self.popped[node]
                    while at is not None and (at, c) not in self.child:
                        at, n = self.link[at], n + self.popped[at]
                    if at is not None:
                        self.link[step], self.popped[step] = self.child[at, c], n
                queue.append(step)

    def count(self, word: str) -> int | None:
        """The number of pieces, or None if greedy matching can't spell the word."""
        child, link, popped = self.child, self.link, self.popped
        node, n = _START, 0
        for c in word:
            while (step := child.get((node, c))) is None:
                n += popped[node]
                if (node := link[node]) is None:
                    return None
            node = step
        while node != _INSIDE:
            n += popped[node]
            if (node := link[node]) is None:
                return None
        return n


@lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    """From a sentencepiece model: a word is the word mark and its characters, and any piece may continue it; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return PieceCounter({p[1:] for p in pieces if p[0] == "▁"}, pieces)


class _Lengths(dict):
    def __init__(self, counter: PieceCounter):
        super().__init__()
        self.counter, self.held = counter, 0

    def __missing__(self, word: str) -> int:
        self.held += len(word) + 64
        if self.held > CACHE:
            self.clear()
            self.held = len(word) + 64
        n = self.counter.count(word)
        n = self[word] = 1 + _UNKNOWN if n is None else n
        return n


@lru_cache(maxsize=2)
def _lengths(path: str) -> _Lengths:
    return _Lengths(load(path))


keeps("token_counts", _lengths.cache_clear)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_unknown, n_tokens) for every row: words are what white space parts.

    A word that the vocabulary can't spell counts as one unknown token, whatever its length. A null text counts as empty: 0, 0, 0.
    Repeated rows are counted each, very long texts and words in time linear in them. Other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("token_counts")
        lengths = _lengths(path)
        for batch in batches:
            words, unknown, tokens = [], [], []
            for text in batch.column(1):
                parts = (text.as_py() or "").split()
                total = sum(map(lengths.__getitem__, parts))
                words.append(len(parts))
                unknown.append(total // _UNKNOWN)
                tokens.append(total % _UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, unknown, tokens))], names=["id", "n_words", "n_unknown", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return found.mapInArrow(run, f"id {kind}, n_words long, n_unknown long, n_tokens long").withColumnRenamed("id", id_col)
