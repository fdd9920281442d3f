"""Toxicity as an ordered severity: cumulative-link regression over sparse word features.

The features of a text are its words and their beginnings of 4 to 6 letters (which catch inflected forms), each with
log(1 + count). One weight vector is shared by all thresholds: P(grade >= k) = sigmoid(w x - t_k), with t_1 < t_2 < t_3, and
the expected severity is the sum of these probabilities. Labels say only whether a text is toxic, and only this can be held
against them; the grade of a toxic text is made here, from no label: the third of toxic texts it falls in by its number of
telling words, as a first fit with one threshold finds them. So severity orders texts by how much of what is telling they hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countspark.llm.common import at_work, drop, materialise, ship

SAMPLE = 7000  # different labelled texts that a fit reads, in the order of their digests
TOXIC_SHARE = 0.25  # of the sample that toxic texts may take
TELLING = (2.0, 1.0, 0.0)  # standard errors that a feature's log odds are above 0, at least; the first of these that leaves any feature
RIDGE = 1e-3
GRADES = 3  # grades above 0
_WORD = re.compile(r"\w+")
_CACHE = 10_000_000  # characters of words, and as much for each word as 64 of them


def word_features(word: str) -> set[int]:
    """Hashes of a lower-case word and its beginnings."""
    return {crc32(f"={word}".encode()), *(crc32(word[:n].encode()) for n in (4, 5, 6) if len(word) >= n)}


def text_features(text: str) -> tuple[list[int], list[int]]:
    """The sorted features of a text, and how often each occurs."""
    counts: Counter[int] = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for f in word_features(word):
            counts[f] += n
    keys = sorted(counts)
    return keys, [counts[k] for k in keys]


@dataclass
class Rows:
    """A sparse matrix by its entries."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def sums(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * d[self.row], self.shape[1])


def fit_ordinal(x: Rows, y: np.ndarray, grades: int, ridge: float = RIDGE, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model, by Adam on the mean negative log-likelihood."""
    w, t = np.zeros(x.shape[1]), np.linspace(1, 1 + grades, grades)
    t[1:] = np.log(np.diff(t))  # thresholds as a first one and log distances, so that they stay in order
    m, v = np.zeros(len(w) + grades), np.zeros(len(w) + grades)
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        s = x.scores(w)
        over = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))
        edge = np.concatenate([np.ones((len(s), 1)), over, np.zeros((len(s), 1))], 1)
        slope = edge * (1 - edge)
        rows = np.arange(len(s))
        p = np.maximum(edge[rows, y] - edge[rows, y + 1], 1e-12)
        low, high = slope[rows, y] / p, slope[rows, y + 1] / p  # of the thresholds y and y + 1
        d_s = -(low - high) / len(s)
        d_cut = np.zeros(grades + 2)
        np.add.at(d_cut, y, low / len(s))
        np.add.at(d_cut, y + 1, -high / len(s))
        d_cut = d_cut[1:-1]
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate([x.sums(d_s) + ridge * w, tail[:1], tail[1:] * np.exp(t[1:])])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[: len(w)], t - move[len(w) :]
    return w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


@dataclass
class Severity:
    """A fitted model: the index of each kept feature, the weights, the thresholds, and P(grade >= 1) from which a text is toxic."""

    index: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def over(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 and on."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(scores)[:, None] - self.thresholds, -30, 30)))


class _Hits(dict):
    """The kept features of each word."""

    def __init__(self, index: dict[int, int]):
        super().__init__()
        self.index, self.held = index, 0

    def __missing__(self, word: str) -> tuple[int, ...]:
        self.held += len(word) + 64
        if self.held > _CACHE:
            self.clear()
            self.held = len(word) + 64
        found = self[word] = tuple(self.index[f] for f in word_features(word) if f in self.index)
        return found


def _score(model: Severity, hits: _Hits, text: str) -> float:
    counts: Counter[int] = Counter()
    for found in map(hits.__getitem__, _WORD.findall(text.lower())):
        if found:
            counts.update(found)
    return float(sum(model.weights[f] * np.log1p(n) for f, n in sorted(counts.items())))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE, features: int | None = None, support: float = 0.0,
) -> Severity:
    """Fit on at most `sample` different labelled texts. A text with several labels counts as toxic if one says so.

    Rows with a null id, label or text are left out, and exact copies count once. Toxic texts take a quarter of the
    sample at most, or what others leave; where the sample holds another share of the toxic texts than of the others, the thresholds and
    the cut are corrected for it. Without both toxic and other texts there is nothing to learn: the model then has no feature and
    finds nothing toxic. Every telling feature is kept, and the ridge holds the rare ones back; features and support ask for the most telling
    ones and for those in a share of the sample's toxic texts alone. Ties, repeated rows and very long texts need no care: a text counts once.
    """
    ship(docs.sparkSession)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("digest"), F.col(text_col).alias("text"))
    labelled = materialise(texts.select("id", "digest").join(known, "id").groupBy("digest").agg(F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    quota = min(sizes.get(1, 0), max(int(sample * TOXIC_SHARE), sample - sizes.get(0, 0)))
    chosen = [labelled.filter(F.col("toxic") == y).orderBy("digest").limit(n) for y, n in ((1, quota), (0, sample - quota))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("toxicity")
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [text_features(t.as_py()) for t in part.column("text")]
                keys = pa.array([np.array(k, np.uint32).view(np.int32) for k, _ in found], pa.list_(pa.int32()))
                counts = pa.array([n for _, n in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("toxic"), keys, counts], names=["digest", "toxic", "keys", "counts"])

    rows = texts.select("digest", "text").join(F.broadcast(chosen[0].union(chosen[1])), "digest").groupBy("digest", "toxic").agg(F.first("text").alias("text"))
    gathered = rows.mapInArrow(run, "digest binary, toxic int, keys array<int>, counts array<int>")
    try:
        return _fit(gathered.toArrow().sort_by("digest").combine_chunks(), sizes, features, support)  # at most `sample` texts
    finally:
        drop(labelled)


def _fit(got: pa.Table, sizes: dict[int, int], features: int | None = None, support: float = 0.0) -> Severity:
    """From the texts (toxic, keys, counts) of a sample; sizes: how many there are of each class in all."""
    y = got["toxic"].to_numpy()
    nothing = Severity({}, np.zeros(0), np.array([30.0 + k for k in range(GRADES)]))
    if not y.any() or y.all():
        return nothing
    keys = got["keys"].combine_chunks().flatten().to_numpy().view(np.uint32)
    counts = got["counts"].combine_chunks().flatten().to_numpy()
    doc = np.repeat(np.arange(len(y), dtype=np.int32), got["keys"].combine_chunks().value_lengths().to_numpy())
    del got  # as large as the sample's texts
    kept, n1 = np.unique(keys[y[doc] == 1], return_counts=True)
    enough = n1 >= support * y.sum()
    kept, n1 = kept[enough], n1[enough]
    if not len(kept):
        return nothing
    others, n_other = np.unique(keys[y[doc] == 0], return_counts=True)
    at = np.minimum(np.searchsorted(others, kept), max(0, len(others) - 1))
    n0 = np.where(others[at] == kept, n_other[at], 0) if len(others) else np.zeros(len(kept))
    odds = np.log((n1 + 0.5) / (y.sum() + 1)) - np.log((n0 + 0.5) / ((1 - y).sum() + 1))
    over = odds / np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    telling = next((t for z in TELLING if (t := over > z).any()), np.zeros(len(odds), bool))
    strength = np.where(telling, odds * np.sqrt(n1), -1)
    best = np.argsort(-strength, kind="stable")[: int(telling.sum()) if features is None else min(features, int(telling.sum()))]
    kept = np.sort(kept[best])
    if not len(kept):
        return nothing
    at = np.minimum(np.searchsorted(kept, keys), len(kept) - 1)
    here = kept[at] == keys
    x = Rows(doc[here], at[here], np.log1p(counts[here].astype(float)), (len(y), len(kept)))
    index = {int(k): i for i, k in enumerate(kept)}
    del keys, counts, doc, at, here
    w, _ = fit_ordinal(x, y.astype(np.int64), 1)
    telling_words = Rows(x.row, x.col, np.expm1(x.value), x.shape).scores((w > 0.5 * w.max()).astype(float)).round(6)
    cuts = np.quantile(telling_words[y == 1], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, telling_words, "left"), 0)
    w, t = fit_ordinal(x, grade, GRADES)
    stands_for = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())  # texts for each one of the sample
    t = t - np.log(stands_for[y == 1][0] / stands_for[y == 0][0])
    return Severity(index, w, t, best_cut(x.scores(w) - t[0], y, stands_for))


def best_cut(logits: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The probability that parts the weighted sample with the best F1: the middle, in log odds, between the scores on either side."""
    order = np.argsort(-logits, kind="stable")
    s, hit, weight = logits[order], y[order], weights[order]
    caught = np.cumsum(hit * weight)
    f1 = 2 * caught / (np.cumsum(weight) + caught[-1])
    last = np.append(s[1:] < s[:-1], True)  # ties stay together
    k = int(np.argmax(np.where(last, f1, -1)))
    below = s[k + 1] if k + 1 < len(s) else s[k] - 1
    return float(1 / (1 + np.exp(-np.clip((s[k] + below) / 2, -30, 30))))


def grade(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, p_toxic, grade, toxic) for every row.

    severity is the expected grade; grade the most probable one; toxic says that the probability of a grade above 0
    reaches the model's cut, which parts the labelled sample best; a text just there is toxic. A null or empty text has no
    feature, so the severity of a text without any telling word. Repeated rows get equal results, very long texts only take
    time by their length, an empty table gives no row, and other columns, whatever their names, are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("toxicity")
        hits = _Hits(model.index)
        for batch in batches:
            over = model.over(np.array([_score(model, hits, t.as_py() or "") for t in batch.column(1)], float))
            edge = np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], 1)
            best = (edge[:, :-1] - edge[:, 1:]).argmax(1)
            toxic = over[:, 0] >= model.cut
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(over.sum(1)), pa.array(over[:, 0]), pa.array(best, pa.int32()), pa.array(toxic)], names=["id", "severity", "p_toxic", "grade", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return found.mapInArrow(run, f"id {kind}, severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Severity, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that grade() doesn't call toxic."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("toxicity")
        hits = _Hits(model.index)
        for batch in batches:
            over = model.over(np.array([_score(model, hits, t.as_py() or "") for t in batch.column(at)], float))
            yield batch.filter(pa.array(over[:, 0] < model.cut))

    return docs.mapInArrow(run, docs.schema)
