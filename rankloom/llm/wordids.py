"""Token ids of whole texts by the tokenizers library, each distinct word of a batch encoded once.

A byte-pair vocabulary whose pre-tokenizer never carries a token from a printing character over to
the white space after it gives the same ids whether a text is encoded whole or in pieces cut there.
A batch of texts is therefore one Arrow buffer cut before white space, dictionary-encoded; only
words that this worker has not met are handed to the library, and the ids of the texts are gathered
with numpy. Positions where it is not plain from two bytes that a printing character stands before
the white space are not cut, so a piece may hold several words. Pieces are also cut between a Latin letter and one of
the marks in ``STOPS``, and between a single line end or tab and a letter, where these pre-tokenizers always end a token.

A piece of Latin letters, after a space or not, is one token to the two kinds of pre-tokenizers that ``one_token`` knows: it goes to the
library's model as it is, without the library's normalising and splitting of it, which takes three quarters of the time.
All others go through the whole library.
"""

from __future__ import annotations

import ctypes
import json
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Marks after which no special token of a vocabulary goes on, and before which a run of letters always ends.
STOPS = np.zeros(256, bool)
STOPS[list(b'.,;:!?"#$%&*+=~()')] = True


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts in order, and for each text the number of pieces before it (with the total at the end).

    ``texts`` has no nulls; pieces cover every byte, an empty text has none.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    offsets = offsets - first
    mark = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        space = (data == 32) | ((data >= 9) & (data <= 13))
        before = data[:-1]
        plain = (before > 32) & (before < 127)
        accented = (before[1:] >= 128) & (data[:-2] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7)
        plain[1:] |= accented
        mark[1:-1] = space[1:] & plain
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        mark[2:-1] |= mark[1:-2] & (before[1:] != 32) & space[1:-1] & (letter | (data == 0xC3))[2:]
        letter[1:-1] |= accented
        mark[1:-1] |= letter[:-1] & STOPS[data[1:]]
    mark[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(mark[: len(data)])
    bounds = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    return pieces, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges start .. start + length - 1, one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    some = lengths > 0
    starts, lengths = starts[some], lengths[some]
    if not len(starts):
        return out[:0]
    out[0] = starts[0]
    heads = np.cumsum(lengths)[:-1]
    out[heads] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


#: Pieces that are a single token before the vocabulary splits them.
PLAIN = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"


def byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for a space and the Latin letters: one printable character a byte, those of other bytes numbered on from 256."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in (32, *range(0xC0, 0x100))}


def one_token(path: str) -> Callable[[str], str] | None:
    """How the tokenizer of this file writes a ``PLAIN`` piece when it comes to its model; None if it isn't of a known kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    space = letters[32]
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout") or any(t["content"].strip().isalpha() for t in spec.get("added_tokens", [])):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return lambda piece: (space + piece[1:] if piece[0] == " " else piece) if piece.isascii() else piece.translate(letters)
    steps = [(x.get("type"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in pre.get("pretokenizers", [])]
    lowers = [x.get("type") for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if lowers and steps == [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)] and r"|[\p{L}]+|" in pre["pretokenizers"][0]["pattern"].get("Regex", ""):
        return lambda piece: piece.strip(" ").lower() if piece.isascii() else piece.strip(" ").lower().translate(letters)
    return None


class WordEncoder:
    """Ids of batches of texts. Beyond twice ``most_words`` words after a batch, only the first ``most_words`` that came are kept, so the frequent ones."""

    def __init__(self, path: str, most_words: int = 300_000, encode_special_tokens: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special_tokens
        special = [] if encode_special_tokens else [(k, t.content) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized]
        self.stop = special[0] if special else None
        self.most = most_words
        self.plain, self.tokenize = one_token(path), self.tokenizer.model.tokenize
        # whether words that are written alike share their ids; else a second table of them would be of no use
        self.shared = bool(self.plain) and len({self.plain(w) for w in ("a", "A", " a", " A")}) < 4
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.number_of: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and their number for each word.

        The library is called with many words at once, parted by a special token, which it never merges with its neighbours.
        """
        if self.stop and not any(self.stop[1] in w for w in words):
            stop, mark = self.stop
            texts = [mark.join([*words[i : i + 1000], ""]) for i in range(0, len(words), 1000)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(ids == stop)
            return ids[ids != stop], np.diff(ends, prepend=-1) - 1
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([x for e in lists for x in e], np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))

    def add(self, ids: np.ndarray, length: np.ndarray) -> range:
        """Holds the ids of words one after the other; their numbers."""
        n = len(self.start)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, ids])
        return range(n, n + len(length))

    def learn_plain(self, words: list[str]) -> None:
        written = [self.plain(w) for w in words]
        fresh = [k for k in dict.fromkeys(written) if k not in self.number_of] if self.shared else written
        lists = [[t.id for t in self.tokenize(k)] for k in fresh]
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((x for e in lists for x in e), np.uint32, int(length.sum()))
        numbers = self.add(ids, length)
        if self.shared:
            self.number_of.update(zip(fresh, numbers, strict=True))
            numbers = map(self.number_of.__getitem__, written)
        self.number.update(zip(words, numbers, strict=True))

    def learn(self, words: list[str]) -> None:
        if self.plain:
            alone = np.asarray(pc.match_substring_regex(pa.array(words, pa.large_string()), PLAIN))
            self.learn_plain([words[i] for i in np.flatnonzero(alone).tolist()])
            words = [words[i] for i in np.flatnonzero(~alone).tolist()]
        apart = [w for w in words if self.stop and self.stop[1] in w]
        held = set(apart)
        for some in ([w for w in words if w not in held], apart):
            if some:
                self.number.update(zip(some, self.add(*self.encoded(some)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids before each text (with the total at the end)."""
        pieces, text_at = cut_words(texts)
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        if len(at := np.flatnonzero(known < 0)):
            new = [words[i] for i in at.tolist()]
            self.learn(new)
            known[at] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        which = known[np.asarray(coded.indices)] if len(words) else np.empty(0, np.int64)
        length = self.length[which]
        ids = self.flat[ranges(self.start[which], length)]
        if len(self.number) > 2 * self.most:
            self.keep_first()
        return ids, np.append(0, np.cumsum(length))[text_at]

    def keep_first(self) -> None:
        """Keeps ``most`` words, those that came first; numbers of words rise in the order in which they came."""
        least = int(np.partition(np.fromiter(self.number.values(), np.int64, len(self.number)), self.most)[self.most])
        self.number = {w: k for w, k in self.number.items() if k < least}
        self.number_of = {w: k for w, k in self.number_of.items() if k < least}
        self.flat = self.flat[: self.start[least]].copy()
        self.start, self.length = self.start[:least].copy(), self.length[:least].copy()


ENCODERS: dict[tuple[str, bool, int], WordEncoder] = {}


def worker_encoder(path: str, encode_special_tokens: bool = False, most_words: int = 300_000) -> WordEncoder:
    """This Python process's encoder of a file: what one task has learnt serves those that come after it in the same worker."""
    key = (path, encode_special_tokens, most_words)
    if key not in ENCODERS:
        ENCODERS[key] = WordEncoder(path, most_words, encode_special_tokens)
    return ENCODERS[key]


def give_back() -> None:
    """Returns freed memory to the system: Spark's Python processes live on through all stages, and allocators would keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of the column, at least one row each. Memory is given back before each batch that comes in, and at the end."""
    for batch in batches:
        give_back()
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + most_bytes, "right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()
