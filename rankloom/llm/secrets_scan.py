"""Secret scans: fixed patterns, plus formats learned from labelled credentials by grammar inference.

State merging (ALERGIA): the labelled strings of a kind form a prefix tree; states are merged, in breadth-first order, where
the frequencies of what follows don't differ by Hoeffding's bound, children with them; states too rare for that are pooled first. The result
is a probabilistic automaton of the kind's format. Every other candidate token of all texts is scored under each kind's automaton and under one of
ordinary tokens; it is reported as ``format`` if a kind's is likelier by ``margin`` bits a character and no less
likely than that kind's strings are to an automaton that hasn't seen them, but for their lowest fiftieth.

Labels are what the fixed patterns find. The automata are fitted on ``sample`` distinct strings a kind, those of least hash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import text_or_empty, written
from rankloom.llm.wordids import small_batches

KINDS = ("assign", "access", "hex", "format")
# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Maximal runs of the alphabet of labelled values, from the least labelled length on. Every access or hex match lies within one.
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{6,}")
#: What is left of a run between dots, which may as well be a sentence's.
PART = re.compile(r"[A-Za-z0-9+/_=-]{6,}")


def base_matches(text: str) -> tuple[list[tuple[str, int, int, str]], list[tuple[int, int, str]]]:
    """(kind, start, end, value) of the fixed patterns by start, then kind; and (start, end, value) of all runs."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    runs = [(m.start(), m.end(), m[0]) for m in RUN.finditer(text)]
    for at, _, run in runs:
        if len(run) < LEAST["access"]:
            continue
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found += [(kind, at + m.start(), at + m.end(), m[0]) for m in pattern.finditer(run) if m.end() - m.start() >= LEAST[kind]]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]))), runs


def apart(base: list[tuple[str, int, int, str]], runs: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The runs that touch no base match."""
    if not base or not runs:
        return runs
    left, at, reach = [], 0, -1
    for start, end, value in runs:
        while at < len(base) and base[at][1] < end:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= start:
            left.append((start, end, value))
    return left


def candidates(base: list[tuple[str, int, int, str]], runs: list[tuple[int, int, str]]) -> list[list[tuple[int, int, str]]]:
    """Groups of a run and its parts between dots, as far as they touch no base match."""
    parts = [(at + m.start(), at + m.end(), m[0]) for at, _, run in runs if "." in run for m in PART.finditer(run)]
    whole = {x[0]: x for x in apart(base, runs)}
    inside: dict[int, list[tuple[int, int, str]]] = {}
    k = 0
    for part in apart(base, parts):
        while runs[k][1] < part[1]:
            k += 1
        inside.setdefault(runs[k][0], []).append(part)
    return [([whole[at]] if at in whole else []) + inside.get(at, []) for at, _, _ in runs if at in whole or at in inside]


def class_of(c: str) -> tuple[str, int]:
    """A symbol's class and how many symbols the class has."""
    if c.isdigit():
        return "digit", 10
    if c.isalpha():
        return ("upper", 26) if c.isupper() else ("lower", 26)
    return "mark", 6


@dataclass
class Automaton:
    """Deterministic probabilistic automaton: for each state its visits, ends, and {symbol: [next state, times]}."""

    visits: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    moves: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])
    lengths: dict[int, int] = field(default_factory=dict)
    classes: list[dict[str, tuple[int, int]]] = field(default_factory=list)
    #: What ``bits`` has worked out: for each weight and state {symbol: (bits, next state)}, and by length.
    steps: dict[float, list[dict[str, tuple[float, int]]]] = field(default_factory=dict)
    by_length: dict[int, float] = field(default_factory=dict)

    def add(self, text: str) -> None:
        state = 0
        self.lengths[len(text)] = self.lengths.get(len(text), 0) + 1
        self.visits[0] += 1
        for c in text:
            if c not in self.moves[state]:
                self.moves[state][c] = [len(self.visits), 0]
                self.visits.append(0)
                self.ends.append(0)
                self.moves.append({})
            move = self.moves[state][c]
            move[1] += 1
            state = move[0]
            self.visits[state] += 1
        self.ends[state] += 1

    def alike(self, a: int, b: int, bound: float) -> bool:
        """Whether what follows states a and b, and recursively their successors, could have one distribution."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            na, nb = self.visits[a], self.visits[b]
            if not na or not nb or a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            most = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.ends[a] / na - self.ends[b] / nb) > most:
                return False
            for c in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(c), self.moves[b].get(c)
                if abs((x[1] if x else 0) / na - (y[1] if y else 0) / nb) > most:
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def distance(self, a: int, b: int) -> float:
        """How far apart two states' classes of next symbols are, and their ends: 0 (the same) to 1 (nothing in common)."""
        shares = []
        for s in (a, b):
            share = {"end": self.ends[s] / self.visits[s]}
            for c, (_, n) in self.moves[s].items():
                key = c if class_of(c)[0] == "mark" else class_of(c)[0]
                share[key] = share.get(key, 0.0) + n / self.visits[s]
            shares.append(share)
        one, two = shares
        return sum(abs(one.get(k, 0.0) - two.get(k, 0.0)) for k in one.keys() | two.keys()) / 2

    def fold(self, into: int, tree: int) -> set[int]:
        """Adds the subtree at ``tree`` to state ``into``; the states that got new moves."""
        todo, grown = [(into, tree)], set()
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, (child, n) in list(self.moves[b].items()):
                if c in self.moves[a]:
                    self.moves[a][c][1] += n
                    if self.moves[a][c][0] != child:
                        todo.append((self.moves[a][c][0], child))
                else:
                    self.moves[a][c] = [child, n]
                    grown.add(a)
        return grown

    def finish(self) -> None:
        """Counts each state's moves by class: {class: (times, most frequent next state)}."""
        self.classes, self.steps, self.by_length = [], {}, {}
        for moves in self.moves:
            found: dict[str, tuple[int, int]] = {}
            top: dict[str, int] = {}
            for c, (to, n) in sorted(moves.items()):
                name = class_of(c)[0]
                if n > top.get(name, 0):
                    top[name] = n
                    found[name] = (found.get(name, (0, 0))[0] + n, to)
                else:
                    found[name] = (found[name][0] + n, found[name][1])
            self.classes.append(found)

    def states(self) -> int:
        """How many states can be reached."""
        seen, todo = {0}, [0]
        while todo:
            for to, _ in self.moves[todo.pop()].values():
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return len(seen)

    def bits(self, text: str, weight: float = 2.0) -> float:
        """log2 of the text's probability and its length's.

        A symbol's share at a state is smoothed by ``weight`` times its class's, shared out evenly among the class; a symbol that
        the state never had goes where most of its class go. Lengths have half an unseen time.
        States of random symbols are visited too seldom to tell how far along they are, so lengths are counted beside them.
        """
        if weight not in self.steps:
            self.steps[weight] = [{} for _ in self.visits]
        steps, state, total = self.steps[weight], 0, self.length_bits(len(text))
        for c in text:
            step = steps[state].get(c)
            if step is None:
                step = steps[state][c] = self.step(state, c, weight)
            total += step[0]
            if step[1] < 0:
                return total - 8.0 * len(text)  # a class that this state never had: no such format
            state = step[1]
        return total + math.log2((self.ends[state] + 0.5) / (self.visits[state] + 1.0))

    def length_bits(self, n: int) -> float:
        if n not in self.by_length:
            seen = sum(self.lengths.values())
            self.by_length[n] = math.log2((self.lengths.get(n, 0) + 0.5) / (seen + 0.5 * (len(self.lengths) + 1)))
        return self.by_length[n]

    def step(self, state: int, c: str, weight: float) -> tuple[float, int]:
        """log2 of the symbol's share at the state, and the next state; -1 where the state never had its class."""
        visits = self.visits[state]
        name, size = class_of(c)
        known = self.classes[state].get(name)
        prior = ((known[0] if known else 0) + 0.1) / (visits + 0.5) / size
        move = self.moves[state].get(c)
        return math.log2(((move[1] if move else 0) + weight * prior) / (visits + weight)), move[0] if move else known[1] if known else -1


def infer(texts: list[str], alpha: float = 0.05, enough: int = 16, far: float = 0.5) -> Automaton:
    """The automaton of the texts by merging compatible states of their prefix tree.

    Successors of a state that fewer than ``enough`` texts reach are too rare to be told apart; they are pooled into one, whose evidence is
    all of theirs. So states of random symbols are tested by their distribution, and do not fall together with a prefix's. States of fewer than ``enough``
    visits even so merge only if their next symbols' classes are within ``far`` of each other.
    """
    tree = Automaton()
    for t in texts:
        tree.add(t)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red, todo = {0: None}, deque([0])
    while todo:
        state = todo.popleft()
        while True:
            fresh = [c for c in sorted(tree.moves[state]) if tree.moves[state][c][0] not in red]
            if not fresh:
                break
            rare = [c for c in fresh if tree.visits[tree.moves[state][c][0]] < enough]
            if len({tree.moves[state][c][0] for c in rare}) > 1:
                first = tree.moves[state][rare[0]][0]
                for c in rare[1:]:
                    other, tree.moves[state][c][0] = tree.moves[state][c][0], first
                    if other != first:
                        tree.fold(first, other)
            target = tree.moves[state][fresh[0]][0]
            sure = tree.visits[target] >= enough
            near = [(tree.distance(r, target), r) for r in red if tree.alike(r, target, bound)]
            near = [x for x in near if sure or x[0] <= far]
            if near:
                into = min(near)[1]
                for c in fresh:
                    if tree.moves[state][c][0] == target:
                        tree.moves[state][c][0] = into
                todo.extend(k for k in sorted(tree.fold(into, target)) if k in red and k not in todo)
            else:
                red[target] = None
                todo.append(target)
    tree.finish()
    return tree


@dataclass
class Formats:
    """The automata of kinds with the least likelihood of theirs, and that of ordinary tokens."""

    kinds: dict[str, tuple[Automaton, float]]
    ordinary: Automaton | None
    margin: float = 1.0

    def is_secret(self, value: str) -> bool:
        if not self.kinds or self.ordinary is None:
            return False
        likely = [own for a, least in self.kinds.values() if (own := a.bits(value) / len(value)) >= least]
        return bool(likely) and max(likely) - self.ordinary.bits(value) / len(value) >= self.margin


def fit_formats(labelled: dict[str, list[str]], ordinary: list[str], margin: float = 1.0, folds: int = 4) -> Formats:
    """An automaton for each kind that has any labelled string, however few; without ordinary tokens nothing is reported.

    The least likelihood that counts is taken from strings that were not fitted: each of ``folds`` parts is scored by the automaton of the
    others, and all but the lowest fiftieth count (with one string alone: its own).
    """
    kinds = {}
    for kind, texts in sorted(labelled.items()):
        texts = sorted(set(texts))
        if not texts:
            continue
        parts_ = [texts[i::folds] for i in range(min(folds, len(texts)))] if len(texts) > 1 else []
        scores = [a.bits(t) / len(t) for i, part in enumerate(parts_) for a in [infer([t for k, p in enumerate(parts_) if k != i for t in p])] for t in part]
        automaton = infer(texts)
        scores = sorted(scores or [automaton.bits(t) / len(t) for t in texts])
        kinds[kind] = (automaton, scores[len(scores) // 50])
    return Formats(kinds, infer(sorted(set(ordinary))) if ordinary else None, margin)


def extracted(docs: DataFrame) -> DataFrame:
    """Written table (kind, value): the values of fixed matches, and the candidates apart from them as ``format``; those of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 8_000_000):
            seen: dict[tuple[str, str], None] = {}
            for text in batch.column("text").to_pylist():
                found, runs = base_matches(text)
                seen.update(((k, v), None) for k, _, _, v in found)
                seen.update((("format", v), None) for group in candidates(found, runs) for _, _, v in group)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.string())], ["kind", "value"])

    return written(docs.select(text_or_empty().alias("text")).mapInArrow(run, "kind string, value string"), "secret-candidates")


def format_spans(base: list[tuple[str, int, int, str]], runs: list[tuple[int, int, str]], is_secret: Callable[[str], bool]) -> list[tuple[int, int]]:
    """(start, end) of the candidates that are secrets; a run that is one stands for its parts."""
    found = []
    for group in candidates(base, runs):
        reach = -1
        for start, end, value in group:
            if start >= reach and is_secret(value):
                found.append((start, end))
                reach = end
    return found


def learned(found: DataFrame, sample: int = 1000, longest: int = 128, margin: float = 1.0) -> Formats:
    """Formats fitted on ``sample`` distinct values a kind (of ``longest`` characters at most), those of least hash."""

    def some(kind: str) -> list[str]:
        values = found.filter((F.col("kind") == kind) & (F.length("value") <= longest)).select("value").distinct()
        return [r.value for r in values.orderBy(F.xxhash64("value"), "value").limit(sample).collect()]

    return fit_formats({k: some(k) for k in KINDS[:3]}, some("format"), margin)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, sample: int = 1000, margin: float = 1.0) -> DataFrame:
    """RESULT for each row of ``docs`` (doc_id, text).

    Null or empty text: no spans, the digest of the empty string. Repeated rows each get their row; null doc_ids stay.
    Too few labelled strings: fixed patterns alone. Offsets count code points.
    """
    formats = learned(extracted(docs), sample, margin=margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_secret = lru_cache(1 << 17)(formats.is_secret)
        for batch in small_batches(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base, runs = base_matches(text)
                spans = [(k, a, b) for k, a, b, _ in base]
                n = [sum(k == kind for k, _, _ in spans) for kind in KINDS[:3]]
                more = [("format", a, b) for a, b in format_spans(base, runs, is_secret)]
                every = sorted(spans + more, key=lambda x: (x[1], KINDS.index(x[0])))
                rows.append((*n, hashlib.sha256(joined(spans).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, RESULT)


def redacted(docs: DataFrame, sample: int = 1000, margin: float = 1.0, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``mark``; n_chars, where there is such a column, follows. No row goes.

    Null texts stay null. Spans that overlap become one mark.
    """
    formats = learned(extracted(docs), sample, margin=margin)
    schema = docs.schema

    def clean(text: str | None, is_secret: Callable[[str], bool]) -> str | None:
        if not text:
            return text
        base, runs = base_matches(text)
        spans = sorted([(a, b) for _, a, b, _ in base] + format_spans(base, runs, is_secret))
        if not spans:
            return text
        out, at = [], 0
        for a, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_secret = lru_cache(1 << 17)(formats.is_secret)
        for batch in small_batches(batches, "text"):
            texts = [clean(t, is_secret) for t in batch.column("text").to_pylist()]
            columns = {name: batch.column(name) for name in batch.schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                was = batch.column("n_chars")
                columns["n_chars"] = pa.array([w if t is None else len(t) for t, w in zip(texts, was.to_pylist(), strict=True)], was.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)
