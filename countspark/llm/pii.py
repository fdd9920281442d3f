"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to like tokens.

The patterns give the base spans. The field then labels the tokens that hold a digit or an at sign (every other token is
observed to be no personal data): each has potentials from its shape and its neighbours, and tokens of one
document that are equal, or have the same digits, share a skip edge, so that a form that the patterns miss takes the label of its
like elsewhere. Sum-product messages pass over chain and skip edges until those of the document have settled, and tokens whose
belief in a label reaches a bound add spans where no base span is. Of k like tokens each is linked to the first one, so
there are fewer skip edges than tokens and any two likes are two steps apart. A document's result doesn't depend on others.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countspark.llm.common import at_work, ship

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4000  # different texts that a fit reads: those with a digit or an at sign, in the order of a hash of the text
BELIEF = 0.9  # that a token has a label, for a span to be added
AGREEMENT = 2.0  # what is expected, before any data, of the logarithm by which like tokens prefer equal labels
DAMPING, SETTLED, ROUNDS = 0.3, 1e-4, 500  # a document's messages have settled when none moves further; loops that never do end after so many rounds
_EDGES = 1 << 15  # edges whose messages are computed together

# The shapes of the base spans.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"[A-Za-z0-9+(](?:\S*[A-Za-z0-9)])?")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' matches in a text, by kind, then start; in time linear in the text."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


@dataclass
class Nodes:
    """The candidate tokens of some documents: where they are, their shape's features, and the edges between them."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray  # index of the features that hold, FEATURES columns
    chain: np.ndarray  # pairs of neighbouring nodes
    skip: np.ndarray  # pairs of like nodes


def _shape(token: str, joined: bool) -> tuple[bool, ...]:
    """joined: the token stands next to another candidate."""
    digits, letters = sum(c in "0123456789" for c in token), sum(c.isalpha() for c in token)
    at, dots, plus = token.count("@"), token.count("."), token[:1] == "+"
    pure = digits + dots + sum(c in "-()+" for c in token) == len(token)
    return (
        True, at == 1, at > 1, at == 1 and "." in token[token.find("@") :], plus, plus and digits <= 3, token[:1] == "(", "-" in token,
        dots == 3 and digits >= 4 and not letters, dots == 1, dots > 3, not letters, pure, digits == len(token), letters > 0 and not at,
        digits <= 2, 3 <= digits <= 4, 5 <= digits <= 8, 9 <= digits <= 12, 13 <= digits <= 19, digits > 19, digits == 16,
        joined, joined and pure, "=" in token, '"' in token or "'" in token, "/" in token, "_" in token,
    )


FEATURES = len(_shape("", False))
LABELS = len(KINDS) + 1  # the last one: none


def _key(token: str) -> str:
    """Like tokens have the same key: their digits if there are four at least, else the token in lower case."""
    digits = "".join(_DIGIT.findall(token))
    return digits if len(digits) >= 4 and "@" not in token else token.lower()


def nodes_of(texts: list[str]) -> Nodes:
    doc, start, end, shape, chain, skip = [], [], [], [], [], []
    for d, text in enumerate(texts):
        if not _DIGIT.search(text) and "@" not in text:
            continue
        cores, last, at = [], -1, -1
        for token in _TOKEN.finditer(text):
            at += 1
            if not (_DIGIT.search(token[0]) or "@" in token[0]) or not (m := _CORE.search(token[0])):
                continue
            near = last == at - 1 and bool(cores)
            cores.append((token.start() + m.start(), token.start() + m.end(), near))
            last = at
        seen: dict[str, int] = {}
        for k, (s, e, near) in enumerate(cores):
            i = len(doc)
            joined = near or k + 1 < len(cores) and cores[k + 1][2]
            doc.append(d)
            start.append(s)
            end.append(e)
            shape.append(_shape(text[s:e], joined))
            if near:
                chain.append((i - 1, i))
            if (first := seen.setdefault(_key(text[s:e]), i)) != i:
                skip.append((first, i))
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Nodes(np.array(doc, np.int64), np.array(start, np.int64), np.array(end, np.int64), np.array(shape, bool).reshape(-1, FEATURES), pairs(chain), pairs(skip))


def labels_of(nodes: Nodes, spans: list[list[Span]]) -> np.ndarray:
    """The kind of the base span that covers the larger part of a node, or none."""
    out = np.full(len(nodes.doc), LABELS - 1)
    first = np.searchsorted(nodes.doc, np.arange(len(spans) + 1)).tolist()
    start, end = nodes.start.tolist(), nodes.end.tolist()
    for d, found in enumerate(spans):
        for kind, s, e in reversed(found):
            i = bisect_right(end, s, first[d], first[d + 1])
            while i < first[d + 1] and start[i] < e:
                if 2 * (min(e, end[i]) - max(s, start[i])) > end[i] - start[i]:
                    out[i] = kind
                i += 1
    return out


@dataclass
class Field:
    """Potentials, as logarithms: of features and labels, of neighbours' labels, and of like tokens' labels."""

    shape: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, nodes: Nodes) -> np.ndarray:
        """The labels' probabilities of each node, by loopy sum-product. Each document stops when its own messages have settled."""
        own = np.zeros((len(nodes.doc), LABELS))
        for has, weights in zip(nodes.shape.T, self.shape):  # a matrix product's rounding would depend on the other rows
            own[has] += weights
        edges = np.concatenate([nodes.chain, nodes.skip])
        pairs = np.stack([self.chain, self.skip])
        kind = np.repeat([0, 1], [len(nodes.chain), len(nodes.skip)])
        doc, sent, live, turn = nodes.doc[edges[:, 0]], np.zeros((2, len(edges), LABELS)), np.arange(len(edges)), 0
        while len(live):
            total, step = own + _incoming(edges, sent, len(own)), (1 - DAMPING) * 0.5 ** max(0, turn - ROUNDS) ** 0.5
            moved = np.zeros(nodes.doc[-1] + 1, bool)
            for i in range(0, len(live), _EDGES):
                e = live[i : i + _EDGES]
                both = pairs[kind[e]]
                forth = _log_sum((total[edges[e, 0]] - sent[1, e])[:, None, :] + both.transpose(0, 2, 1))
                back = _log_sum((total[edges[e, 1]] - sent[0, e])[:, None, :] + both)
                new = np.stack([forth - _log_sum(forth)[:, None], back - _log_sum(back)[:, None]])
                move = step * (new - sent[:, e])
                sent[:, e] += move
                moved[doc[e][np.abs(move).max((0, 2)) >= SETTLED]] = True
            live, turn = live[moved[doc[live]]], turn + 1
        total = own + _incoming(edges, sent, len(own))
        return np.exp(total - _log_sum(total)[:, None])


def _incoming(edges: np.ndarray, sent: np.ndarray, n: int) -> np.ndarray:
    """The sum of the messages that each of n nodes gets: sent[0] goes to the edges' second nodes, sent[1] to the first ones."""
    return np.stack([np.bincount(edges[:, 1], sent[0, :, k], n) + np.bincount(edges[:, 0], sent[1, :, k], n) for k in range(LABELS)], 1)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(-1)
    return top + np.log(np.exp(x - top[..., None]).sum(-1))


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, agreement: float = AGREEMENT) -> Field:
    """Fit the field by pseudo-likelihood on the base labels of at most `sample` different texts.

    The executors count equal situations of a node (shape, label, labels of its neighbours and likes), and only these counts
    reach the driver. Without any candidate token the potentials are zero. agreement is a prior on the skip potentials,
    like the zeros of all others: the fit pulls them there as weakly, so it decides where the texts hold too few like tokens to teach it.
    """
    ship(docs.sparkSession)
    marked = docs.filter(F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    chosen = marked.select("hash").distinct().orderBy("hash").limit(sample)
    texts = marked.join(F.broadcast(chosen), "hash").groupBy("hash").agg(F.first("text").alias("text")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("pii")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            nodes = nodes_of(texts)
            y = labels_of(nodes, [base_spans(t) for t in texts])
            near = np.zeros((len(y), 3, LABELS), "<i4")  # labels of the neighbours before and after, and of the likes
            for at, to, by in ((0, 1, 0), (1, 0, 1)):
                np.add.at(near, (nodes.chain[:, to], at, y[nodes.chain[:, by]]), 1)
                np.add.at(near, (nodes.skip[:, to], 2, y[nodes.skip[:, by]]), 1)
            rows = np.concatenate([nodes.shape.astype(np.uint8), y[:, None].astype(np.uint8), near.reshape(len(y), -1).view(np.uint8)], 1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["situation"])

    counted = texts.mapInArrow(run, "situation binary").groupBy("situation").count().toArrow()
    prior = agreement * np.eye(LABELS)
    shape, chain, skip = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), prior.copy()
    if not counted.num_rows:
        return Field(shape, chain, np.zeros_like(skip))
    rows = np.frombuffer(b"".join(counted["situation"].to_pylist()), np.uint8).reshape(counted.num_rows, -1)
    n = counted["count"].to_numpy().astype(float)
    x, y = rows[:, :FEATURES].astype(float), rows[:, FEATURES].astype(int)
    near = np.ascontiguousarray(rows[:, FEATURES + 1 :]).view("<i4").astype(float)
    before, after, like = near[:, :LABELS], near[:, LABELS : 2 * LABELS], near[:, 2 * LABELS :]
    target = np.eye(LABELS)[y]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (shape, chain, skip)]
    for step in range(1, 301):
        z = x @ shape + before @ chain + after @ chain.T + like @ skip
        d = (np.exp(z - _log_sum(z)[:, None]) - target) * (n / n.sum())[:, None]
        g_skip = like.T @ d
        grads = (x.T @ d + 1e-4 * shape, before.T @ d + (after.T @ d).T + 1e-4 * chain, (g_skip + g_skip.T) / 2 + 1e-4 * (skip - prior))
        for p, g, m in zip((shape, chain, skip), grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p -= 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Field(shape, chain, skip)


class _Taken:
    """The places that a text's base spans take."""

    def __init__(self, found: list[Span]):
        places = sorted((s, e) for _, s, e in found)
        self.starts, self.ends = [s for s, _ in places], list(accumulate((e for _, e in places), max))

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def begins(self, start: int, end: int) -> bool:
        """Whether one begins from start on, before end."""
        k = bisect_left(self.starts, start)
        return k < len(self.starts) and self.starts[k] < end


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans, and all spans: the base ones and those that the field adds, by kind, then start."""
    base = [base_spans(t) for t in texts]
    nodes = nodes_of(texts)
    added: list[list[Span]] = [[] for _ in texts]
    if len(nodes.doc):
        belief = field.beliefs(nodes)
        kind = belief[:, :-1].argmax(1)
        sure = belief[np.arange(len(kind)), kind] >= BELIEF
        neighbour = set(nodes.chain[:, 1].tolist())
        taken = {d: _Taken(base[d]) for d in set(nodes.doc[sure].tolist())}
        last = -2
        for i in np.flatnonzero(sure).tolist():
            d, s, e = int(nodes.doc[i]), int(nodes.start[i]), int(nodes.end[i])
            if taken[d].meets(s, e):
                continue
            if last == i - 1 and i in neighbour and kind[i] == kind[last] and added[d] and not taken[d].begins(added[d][-1][2], s):
                added[d][-1] = (int(kind[i]), added[d][-1][1], e)
            else:
                added[d].append((int(kind[i]), s, e))
            last = i
    return [(b, sorted(b + a)) for b, a in zip(base, added)]


def spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for every row: arrays of (kind, start, end) in code points, end exclusive, by kind, then start.

    base holds the patterns' spans; spans holds these and those that the field adds. A null text counts as empty: no spans. Repeated rows get equal
    spans, as each document settles by itself. Of equally believed kinds the first one counts. A very long text takes time by its tokens with a digit or
    an at sign times the rounds until it settles; an empty table gives no row; other columns, whatever their names, are not read.
    """
    ship(docs.sparkSession)
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("pii")
        for batch in batches:
            found = [x for i in range(0, batch.num_rows, 512) for x in find([t.as_py() or "" for t in batch.column(1).slice(i, 512)], field)]
            columns = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x[j]] for x in found], pa.list_(one)) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    entry = "array<struct<kind:string,start:long,end:long>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, base {entry}, spans {entry}").withColumnRenamed("id", id_col)


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that overlap become one, named by the first."""
    out, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in found):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, field: Field, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of docs, with all spans of the texts replaced; length_col, where there is such a column, is renewed.

    Null texts stay null.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("pii")
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = batch.column(at).to_pylist()
                new = [None if t is None else redacted(t, x[1]) for t, x in zip(texts, find([t or "" for t in texts], field))]
                columns = batch.columns
                columns[at] = pa.array(new, batch.schema.field(at).type)
                if length is not None:
                    columns[length] = pa.array([n if t == u else len(u) for n, t, u in zip(columns[length].to_pylist(), texts, new)], batch.schema.field(length).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
