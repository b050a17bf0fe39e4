"""WARC archives, token files, packing and chat formatting: exact round trips and hand-made cases."""

import os
import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import packing, perspectives, token_huffman, warc
from rankloom.llm.queries import tokenizer_file
from rankloom.llm.wordids import WordEncoder

ODD = ["a  b  c", "", " ", "x\n\n y　 z q", "é è  ñ\t\tk", "\u0085 a", "don't 's  1234 ΑΣ", "\r\n x ", "end. Next,word;x", "word" * 3000]


def test_archives_read_back(spark):
    inner = warc.page_record(99, "http://inside", b"payload", None).decode()
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, "u\n3", inner), (4, None, None), (5, "u5", ""), (7, "u7", "same"), (None, "n", "same"), (8, "u8", "é"), (8, "u8", "é")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.read_archives(warc.write_archives(pages, archive_bytes=700)).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    by = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(1, "revisit", 7), (2, "revisit", 7), (7, "response", None), (None, "revisit", 7), (3, "response", None), (4, "revisit", 5), (5, "response", None), (8, "response", None)} == by
    third = next(r for r in got if r.page_id == 3)
    assert bytes(third.payload).decode() == inner and third.payload_digest == base64.b32encode(hashlib.sha1(inner.encode()).digest()).decode()
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, min_payload=10)).collect()} == {"response"}


def test_chain_rejects_magic_inside_and_stops_at_a_cut():
    a, b = warc.page_record(1, "u", warc.page_record(9, "v", b"in", None), None), warc.page_record(2, "u", b"x", None)
    at, after, _ = warc.candidates(a + b)
    assert len(at) == 3 and warc.reachable(at, after).tolist() == [True, False, True]
    at, after, _ = warc.candidates((a + b)[:-1])
    assert warc.reachable(at, after).tolist() == [True, False]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700), st.integers(1, 5))
def test_huffman_round_trip(ids, docs):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=1) if len(ids) else np.zeros(1, np.int64)
    lengths = token_huffman.code_lengths(counts, 9)
    assert lengths.max(initial=0) <= 9
    if len(ids):
        assert sum(2.0 ** -float(x) for x in lengths if x) <= 1
    codes, symbol, length, top = token_huffman.canonical(lengths)
    sizes = np.diff(np.linspace(0, len(ids), docs + 1).astype(int))
    raw = token_huffman.block_bytes(np.arange(docs), sizes, 5, ids, codes, lengths)
    block = token_huffman.parse(raw)
    assert block.before == 5 and block.lengths.tolist() == sizes.tolist()
    again = token_huffman.decode([block, block], symbol, length, top)
    assert all((x == ids).all() for x in again)


def test_limited_code_is_no_longer_than_plain_huffman_where_the_limit_is_loose():
    import heapq

    counts = np.array([40, 1, 1, 2, 3, 5, 8, 13, 21])
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert int((token_huffman.code_lengths(counts, 12) * counts).sum()) == cost


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_encode_like_whole_texts(name):
    encoder = WordEncoder(tokenizer_file(name))
    texts = [*ODD, "a<|endoftext|> b", "foo  <|endoftext|>bar", "É\nÉa\r\n\té×a\u00d7. ×÷é÷.é, é.\nA\n\nB  \n C\n d", "don't $5 a$$$ é&&& \n(x) [y]_z é\u0301. e\u0301\u0301.x ÿ=ß~ STRASSE ßẞ İi ﬁ.ﬁ ĳ\u200bA"]
    rng = np.random.default_rng(6)
    texts += ["".join(rng.choice(list("abÉéß×÷ \n\t.,$'<|>9_-Ω\u0301\u00a0"), 60)) for _ in range(400)]
    assert encoder.plain
    ids, at = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, part int")


def test_token_files_round_trip(spark):
    texts = [*ODD, None, "again and again", "again and again"]
    path = tokenizer_file("word_bpe_49k.json")
    got = sorted(token_huffman.read_tokens(token_huffman.token_files(docs_of(spark, texts), path)).collect())
    tokenizer, before = WordEncoder(path).tokenizer, 0
    for r, t in zip(got, texts, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (before, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    assert token_huffman.read_tokens(token_huffman.token_files(docs_of(spark, texts).limit(0), path)).count() == 0


def test_packing_places_every_id_once(spark):
    texts = [*ODD, None, *[f"topic{i % 3} alpha beta " * (i * 7) for i in range(40)], "same text", "same text"]
    path = tokenizer_file("byte_bpe_50k.json")
    rows = packing.pack(docs_of(spark, texts), path, window=256, shard_pieces=16).collect()
    tokenizer = WordEncoder(path).tokenizer
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    covered = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, x in enumerate(ids):
        at = 0
        for start, n in sorted(covered[i]):
            assert start == at and n > 0
            at += n
        assert at == len(x)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack(docs_of(spark, texts).limit(0), path).count() == 0


def test_seed_takes_its_lexical_neighbours():
    texts = [[1, 2, 3, 4] * 10, [50, 51, 52] * 10, [1, 2, 3] * 5, [50, 51] * 5]
    ids, bounds = np.concatenate([np.array(t, np.uint16) for t in texts]), np.append(0, np.cumsum([len(t) for t in texts]))
    index = packing.Index(ids, bounds, np.ones(1 << 16), 20.0)
    first = packing.pack_shard(index, np.diff(bounds), window=55)[0]
    assert [p for p, _, _ in first] == [0, 2]


def test_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "late"), (1, 300, "ann", "late"), (2, 0, "system", "alone"), (3, None, None, "x"), (None, 1, "ann", "y")]
    turns = spark.createDataFrame([(*r, "b") for r in rows], "conv_id long, turn long, role string, text string, block string")
    got = {(r.conv_id, r.speaker, r.block): r for r in perspectives.rotated(turns, block_turns=3).collect()}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (3, "unknown", 0), (None, "ann", 0)}
    r = got[1, "ann", 0]
    assert r.text == "<|system|>\nS<|end|>\n<|assistant|>\nhi<|end|>\n<|user bob|>\n<|end|>\n"
    assert [r.text[m.start : m.stop] for m in r.masks] == ["hi<|end|>\n"] and r.n_turns == 3
    late = got[1, "ann", 1]
    assert late.chunk_start == len(r.text) and late.n_turns == 1 and [late.text[m.start : m.stop] for m in late.masks] == ["late<|end|>\n"]
    assert perspectives.rotated(turns.limit(0)).count() == 0


def test_perspectives_cut_equal_turns_into_blocks(spark):
    rows = [(7, None if i % 2 else 5, "ann" if i % 3 else "bob", f"text {i:04}") for i in range(900)] + [(8, 1, "ann", "z" * 70_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(r for r in perspectives.rotated(turns, block_turns=100).collect() if r.conv_id == 7)
    assert [(r.speaker, r.block, r.n_turns) for r in got] == [(s, b, 100) for s in ("ann", "bob") for b in range(9)]
    want = sorted(rows[:900], key=lambda r: (-1 if r[1] is None else r[1], r[2], r[3]))
    for speaker in ("ann", "bob"):
        own = [r for r in got if r.speaker == speaker]
        text = "".join(r.text for r in own)
        assert text == "".join(f"<|{'assistant' if r[2] == speaker else 'user ' + r[2]}|>\n{r[3]}<|end|>\n" for r in want)
        assert [text[r.chunk_start + m.start : r.chunk_start + m.stop] for r in own for m in r.masks] == [f"{r[3]}<|end|>\n" for r in want if r[2] == speaker]


def test_packing_brings_alike_pieces_together_across_shards(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("bcdfghjklmnpqrstvwxz"))
    own = [["".join(rng.choice(letters, 7)) for _ in range(6)] for _ in range(30)]
    common = ["".join(rng.choice(letters, 5)) for _ in range(40)]
    topic = rng.integers(0, 30, 900)
    texts = [" ".join(rng.permutation([*rng.choice(own[t], 8), *rng.choice(common, 12)])) for t in topic]

    def alike(shard_pieces):
        rows = packing.pack(docs_of(spark, texts), tokenizer_file("byte_bpe_50k.json"), window=512, shard_pieces=shard_pieces).collect()
        assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, set()).add(r.doc_id)
        return np.mean([topic[a] == topic[b] for docs in by.values() for a in docs for b in docs if a < b])

    sharded, whole = alike(64), alike(10_000)  # 0.57 and 0.85 as written; 1 in 30 by chance
    assert sharded > 0.6 * whole and sharded > 0.4


def test_shards_of_terms_hold_what_they_should():
    owned = {5: 10, 6: 3000, 7: 1000, 9: 30, 11: 1024, 65535: 1}
    first, number = packing.shard_ranges(owned, 1024)
    held = {}
    for term, n in owned.items():
        for k in range(int(number[term])):
            held[first[term] + k] = held.get(first[term] + k, 0) + n / number[term]
    assert max(held.values()) <= 1024 and len(held) <= 7 and number[6] == 3


def test_words_are_forgotten_but_the_first(monkeypatch):
    encoder = WordEncoder(tokenizer_file("byte_bpe_50k.json"), most_words=20)
    rng = np.random.default_rng(8)
    for _ in range(12):
        texts = [" ".join("".join(rng.choice(list("abcé."), 4)) for _ in range(30)), "the first words <|endoftext|> stay"]
        ids, at = encoder.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(encoder.number) <= 40


def test_a_worker_gives_back_what_a_task_has_used():
    """In a process of its own, as a Python worker is: after a task little is left of what its batches took, and less than the words' two tables of what was learnt."""
    import subprocess
    import sys

    code = """
import re
import numpy as np, pyarrow as pa
from rankloom.llm import toxicity as T
from rankloom.llm.queries import BYTE_TOKENIZER, tokenizer_file
from rankloom.llm.wordids import WordEncoder, small_batches

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

random = np.random.default_rng(1)
words = np.array(["".join(map(chr, w)) for w in random.integers(97, 123, (50_000, 6))])
batch = pa.record_batch({"text": pa.array([" ".join(words[random.integers(0, len(words), 300)]) for _ in range(6000)])})
model = T.Model(T.Field(np.zeros(T.SLOTS), -2.0, np.zeros((2, 2)), np.zeros(2)), np.zeros(5))
encoder = WordEncoder(tokenizer_file(BYTE_TOKENIZER))
def task():
    for part in small_batches(iter([batch]), "text"):
        model.scores(part.column("text"))
        encoder.encode(part.column("text"))
before = held()
task()
print(held() - before, len(encoder.number), len(encoder.number_of))
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}, timeout=120)
    assert done.returncode == 0, done.stderr
    kept, words, twice = (float(x) for x in done.stdout.split())
    assert words > 50_000 and twice == 0 and kept < 60, done.stdout
