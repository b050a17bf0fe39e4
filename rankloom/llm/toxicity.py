"""Toxicity: a linear-chain conditional random field over words, its marginals aggregated to document scores and offsets.

Words are labelled through their documents: in documents labelled toxic, the words that stand out there against the
others. The field has two states (clean, toxic), features of the word, its ends and shape and of its neighbours, hashed, and
transitions. Forward-backward runs over the 2x2 matrices of all words of a batch as one chain, which forgets
at document starts: chunks side by side, their products by doubling, then the chunks again from their known starts.
A logistic model, fitted on labelled documents that the field was not, turns a document's marginals into its score.

Fitted on ``most_toxic`` and ``most_clean`` labelled documents at most (those of least hash, of ``longest`` characters at
most); scores are of every word of every document.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import text_or_empty
from rankloom.llm.wordids import give_back, small_batches

SLOTS = 1 << 16
CHUNK = 64
WORD = np.zeros(256, bool)
WORD[128:] = True
WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_'")] = True


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 0 by 5; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(texts: pa.Array, places: bool = True) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Words of all texts (dictionary-encoded), the number of words before each text, first and end byte of each word, and, for ``places``, code points before each byte."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    offsets = offsets - first
    inside = WORD[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets[:-1]] = True
    before = np.append(False, inside[:-1]) if len(data) else inside
    begin = np.flatnonzero(inside & (~before | fresh[: len(data)]))
    after = np.append(inside[1:], False) if len(data) else inside
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    size = end - begin
    flat = data[inside]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(flat)])
    if not places:
        return words.dictionary_encode(), np.searchsorted(begin, offsets), begin, end, None
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    points = points - np.repeat(points[offsets[:-1]], np.diff(np.append(offsets[:-1], len(points)))) if len(offsets) > 1 else points
    return words.dictionary_encode(), np.searchsorted(begin, offsets), begin, end, points


def slots(word: bytes) -> list[int]:
    """Hashed features of a word: itself in lower case, its ends, its shape."""
    low = word.lower()
    return [zlib.crc32(x) % SLOTS for x in (b"w" + low, b"p" + low[:4], b"s" + low[-4:], b"c%d%d" % (word.isupper(), min(len(word), 12)))]


def neighbour_slots(word: bytes) -> list[int]:
    low = word.lower()
    return [zlib.crc32(b"b" + low) % SLOTS, zlib.crc32(b"a" + low) % SLOTS]


@dataclass
class Field:
    """Weights of the toxic state for each feature, bias, log transitions and log start."""

    weight: np.ndarray
    bias: float
    step: np.ndarray
    start: np.ndarray
    lexicon: frozenset[bytes] = frozenset()

    def emissions(self, words: list[bytes], which: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Log-odds of the toxic state for each word in place: its own features and its neighbours' within the document."""
        if not len(which):
            return np.empty(0)
        own = np.array([self.weight[slots(w)].sum() for w in words])
        beside = np.array([self.weight[neighbour_slots(w)] for w in words]).reshape(-1, 2)
        score = own[which] + self.bias
        inner = np.ones(len(which), bool)
        inner[heads[heads < len(which)]] = False
        score[1:] += np.where(inner[1:], beside[which[:-1], 0], 0)
        score[:-1] += np.where(inner[1:], beside[which[1:], 1], 0)
        return np.clip(score, -30, 30)

    def marginals(self, score: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Probability of the toxic state of every word, by forward-backward over all documents as one chain."""
        n = len(score)
        if not n:
            return np.empty(0)
        odds = np.exp(score)
        step, start = np.exp(self.step), np.exp(self.start)
        chunks = -(-n // CHUNK)
        a = np.zeros((chunks * CHUNK, 2, 2))
        a[n:] = np.eye(2)
        a[:n, :, 0] = step[:, 0]
        a[:n, :, 1] = step[:, 1] * odds[:, None]
        heads = heads[heads < n]
        a[heads, :, 0] = start[0]
        a[heads, :, 1] = start[1] * odds[heads, None]
        a /= a.sum((1, 2), keepdims=True)
        a = a.reshape(chunks, CHUNK, 2, 2)
        total = a[:, 0]
        for t in range(1, CHUNK):
            total = total @ a[:, t]
            total = total / total.sum((1, 2), keepdims=True)
        # inclusive products of chunks from the left and from the right, by doubling
        left, right, shift = total.copy(), total.copy(), 1
        while shift < chunks:
            new = left.copy()
            new[shift:] = left[:-shift] @ left[shift:]
            left = new / new.sum((1, 2), keepdims=True)
            new = right.copy()
            new[:-shift] = right[:-shift] @ right[shift:]
            right = new / new.sum((1, 2), keepdims=True)
            shift *= 2
        forward = np.ones((chunks, 2))
        forward[1:] = left[:-1].sum(1)
        backward = np.ones((chunks, 2))
        backward[:-1] = right[1:].sum(2)
        alpha = np.empty((chunks, CHUNK, 2))
        for t in range(CHUNK):
            forward = (forward[:, None, :] @ a[:, t])[:, 0]
            forward = forward / forward.sum(1, keepdims=True)
            alpha[:, t] = forward
        for t in range(CHUNK - 1, -1, -1):
            alpha[:, t] *= backward
            backward = (a[:, t] @ backward[:, :, None])[:, :, 0]
            backward = backward / backward.sum(1, keepdims=True)
        alpha = alpha.reshape(-1, 2)[:n]
        return alpha[:, 1] / alpha.sum(1)


def standing_out(texts: Iterable[set[bytes]], toxic: np.ndarray, fewest: int = 3, times: float = 8.0) -> frozenset[bytes]:
    """Words in ``fewest`` toxic documents at least, ``times`` as often there as in others."""
    from collections import Counter

    seen = [Counter(), Counter()]
    for words, label in zip(texts, toxic, strict=True):
        seen[label].update(words)
    clean, bad = max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))
    return frozenset(w for w, n in seen[1].items() if n >= fewest and n / bad >= times * (seen[0][w] + 0.5) / clean and n >= 0.004 * bad)


def train_field(words: list[bytes], which: np.ndarray, heads: np.ndarray, label: np.ndarray, lexicon: frozenset[bytes], span: int = 24, most: int = 12_000, rounds: int = 60, rate: float = 0.5, ridge: float = 1e-5) -> Field:
    """Weights by gradient ascent (Adagrad) on the likelihood of the labels of windows of ``span`` words: of those with toxic words and of others ``most`` / 2 at most, evenly spread."""
    field = Field(np.zeros(SLOTS), -2.0, np.zeros((2, 2)), np.zeros(2), lexicon)
    size = np.diff(np.append(heads, len(which)))
    starts = np.concatenate([np.arange(h, h + n - span + 1, span) for h, n in zip(heads, size, strict=True) if n >= span] or [np.empty(0, np.int64)])
    if not len(starts) or not lexicon:
        return field
    hit = np.add.reduceat(label, starts) > 0 if len(starts) else starts
    some = np.concatenate([starts[hit][:: int(hit.sum()) // (most // 2) + 1], starts[~hit][:: max(1, int((~hit).sum()) // (most // 2) + 1)]])
    at = some[:, None] + np.arange(span)
    own = np.array([slots(w) for w in words])
    beside = np.array([neighbour_slots(w) for w in words])
    y = label[at].astype(np.float64)
    feature = np.concatenate([own[which[at]], np.roll(beside[which[at], 0], 1, 1)[..., None], np.roll(beside[which[at], 1], -1, 1)[..., None]], 2)
    on = np.ones(feature.shape)
    on[:, 0, 4] = on[:, -1, 5] = 0
    flat = feature.reshape(-1)
    total = np.full(SLOTS, 1e-8)
    other = np.full(7, 1e-8)
    for _ in range(rounds):
        score = (field.weight[feature] * on).sum(2) + field.bias
        odds = np.exp(np.clip(score, -30, 30))
        step, start = np.exp(field.step), np.exp(field.start)
        alpha, beta = np.empty((*y.shape, 2)), np.ones((*y.shape, 2))
        e = np.stack([np.ones_like(odds), odds], 2)
        alpha[:, 0] = start * e[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for t in range(1, span):
            alpha[:, t] = alpha[:, t - 1] @ step * e[:, t]
            alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
        for t in range(span - 2, -1, -1):
            beta[:, t] = (e[:, t + 1] * beta[:, t + 1]) @ step.T
            beta[:, t] /= beta[:, t].sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        pair = alpha[:, :-1, :, None] * step * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        expected = pair.sum((0, 1))
        real = np.zeros((2, 2))
        np.add.at(real, (y[:, :-1].astype(int).reshape(-1), y[:, 1:].astype(int).reshape(-1)), 1)
        lack = y - p[:, :, 1]
        n = y.size
        grad = np.bincount(flat, (on * lack[..., None]).reshape(-1), SLOTS) / n - ridge * field.weight
        total += grad**2
        field.weight += rate * grad / np.sqrt(total)
        rest = np.concatenate([[lack.mean()], ((real - expected) / n).reshape(-1), [0.0, (lack[:, 0]).mean() / span]])
        other += rest**2
        move = 0.1 * rest / np.sqrt(other)
        field.bias += move[0]
        field.step += move[1:5].reshape(2, 2)
        field.start += move[5:]
    return field


def summaries(p: np.ndarray, heads: np.ndarray, rows: int, before: np.ndarray) -> np.ndarray:
    """Of each document's marginals: log of their sum, largest, probability of any, share; zeros without words."""
    out = np.zeros((rows, 4))
    n = np.diff(before)
    some = np.flatnonzero(n)
    if len(some):
        at = before[:-1][some]
        total = np.add.reduceat(p, at)
        out[some, 0] = np.log1p(total)
        out[some, 1] = np.maximum.reduceat(p, at)
        out[some, 2] = 1 - np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), at))
        out[some, 3] = np.sqrt(total / n[some])
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - ridge * w * np.append(np.ones(x.shape[1]), 0)
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
    return w


@dataclass
class Model:
    field: Field
    weights: np.ndarray

    def scores(self, texts: pa.Array, places: bool = True) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Score of each text, and, for ``places``, first and end code point of its words whose marginal is 0.5 or more."""
        coded, before, begin, end, points = words_of(texts, places)
        which = np.asarray(coded.indices, np.int64)
        heads = before[:-1][np.diff(before) > 0]
        p = self.field.marginals(self.field.emissions(coded.dictionary.to_pylist(), which, heads), heads)
        x = summaries(p, heads, len(texts), before)
        score = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -30, 30)))
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        if points is None:
            return score, spans
        bad = np.flatnonzero(p >= 0.5)
        length = points[np.maximum(end[bad] - 1, 0)] + 1
        for row, a, b in zip((np.searchsorted(before, bad, "right") - 1).tolist(), points[begin[bad]].tolist(), length.tolist(), strict=True):
            spans[row].append((a, b))
        return score, spans


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 3000, most_clean: int = 5000, longest: int = 40_000) -> Model | None:
    """The model, or None without both classes among the labelled rows that are not held out.

    Null labels count as none; of several labels of a doc_id the largest holds.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    some = known.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_toxic).unionByName(known.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_clean))
    # broadcast of most_toxic + most_clean ids at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter(F.length("text") <= longest).join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        model = fitted(pa.Table.from_batches(held).sort_by("doc_id"), counts) if held else None
        held.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # the bounded sample is fitted in one task, so the driver gets the model only
    found = rows.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(found.model)) if found else None


def fitted(rows: pa.Table, counts: dict[int, int]) -> Model | None:
    """The model of a sample (doc_id, text, toxic); ``counts`` has all labelled rows by label."""
    toxic = rows.column("toxic").to_numpy()
    if not (toxic == 0).any() or not (toxic == 1).any():
        return None
    fold = np.array([zlib.crc32(b"fold%d" % i) % 5 < 3 for i in rows.column("doc_id").to_pylist()])
    texts = rows.column("text").to_pylist()

    def taken(pick: np.ndarray):
        coded, before, _, _, _ = words_of(pa.array([t for t, k in zip(texts, pick, strict=True) if k], pa.large_string()), places=False)
        return coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64), before

    words, which, before = taken(fold)
    low = [w.lower() for w in words]
    lexicon = standing_out(({low[k] for k in which[a:b]} for a, b in zip(before[:-1], before[1:], strict=True)), toxic[fold])
    bad = np.array([w in lexicon for w in low] or [False])
    label = (bad[which] & (np.repeat(toxic[fold], np.diff(before)) == 1)).astype(np.int64)
    heads = before[:-1][np.diff(before) > 0]
    field = train_field(words, which, heads, label, lexicon)
    words, which, before = taken(~fold)
    heads = before[:-1][np.diff(before) > 0]
    x = summaries(field.marginals(field.emissions(words, which, heads), heads), heads, int((~fold).sum()), before)
    y = toxic[~fold].astype(np.float64)
    if not 0 < y.sum() < len(y):
        return Model(field, np.array([0.0, 0.0, 8.0, 0.0, -4.0]))
    weights = logistic(x, y)
    # the sample has its own share of toxic rows; the score is for that of all labelled rows
    weights[-1] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(field, weights)


RESULT = "doc_id long, score double, predicted int, spans array<struct<start:int,stop:int>>"


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """RESULT for each row of ``docs`` (doc_id, text): score, 1 if that is 0.5 or more, and offending words' code points.

    Null text: empty, scored like a text without offending words. Without a model every score is 0. Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in small_batches(batches, "text", 2_000_000):
            s, spans = model.scores(batch.column("text")) if model else (np.zeros(batch.num_rows), [[]] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], kind)], ["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, RESULT)


def kept(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2_000_000):
            yield batch.filter(pa.array(model.scores(batch.column("text").fill_null(""), places=False)[0] < 0.5)) if model else batch

    return docs.mapInArrow(run, docs.schema)
