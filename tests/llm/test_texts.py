"""Operators on texts against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from rankloom.llm import decontamination, fingerprints, secrets_scan, simhash, suffix_dedup, toxicity

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


def table(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "clash", 3, "k") for i, t in enumerate(texts)], "doc_id long, text string, hash string, row int, key string")


BASE = prose(200)
TEXTS = [BASE, BASE, BASE.replace(" ", "  ", 1), BASE + " one more", None, "", "É " + prose(60), "x", prose(3), prose(2500), BASE[:600] + prose(40), prose(40) + BASE[300:900], "same\nline. " * 80]


def test_secrets_against_patterns(spark):
    hexes = [hashlib.sha1(b"%d" % i).hexdigest() for i in range(40)]
    texts = [f'é {prose(5)} token = "{h}" {prose(5)}' for h in hexes[:30]] + [f"{prose(4)} {'AKIA' + h.upper()[:16]} {prose(3)}" for h in hexes] + [None, "", "PASSWORD:abc", "password = secret: abcdefgh", "AKIA123", "api_key:a.b-c_d/e", "ſecret = longvalue", "x" * 5000, *[prose(30) for _ in range(30)]]
    got = sorted(secrets_scan.scan(table(spark, texts)).collect())
    for r, t in zip(got, texts, strict=True):
        t = t or ""
        spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
        spans.sort(key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == q for k, _, _ in spans) for q in ("assign", "access", "hex"))
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
    clean = {r.doc_id: r.text for r in secrets_scan.redacted(table(spark, texts)).collect()}
    assert all(h not in (c or "") for h in hexes for c in clean.values()) and clean[len(hexes) - 10 + len(hexes)] is None
    assert clean[len(texts) - 1] == texts[-1] and secrets_scan.scan(table(spark, texts).limit(0)).count() == 0


def test_inferred_automaton_knows_the_format():
    rng = random.Random(1)
    known = ["zk_" + "".join(rng.choice("0123456789") for _ in range(20)) for _ in range(300)]
    ordinary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(16, 30))) for _ in range(300)]
    formats = secrets_scan.fit_formats({"assign": known}, ordinary)
    fresh = ["zk_" + "".join(rng.choice("0123456789") for _ in range(20)) for _ in range(50)]
    other = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(23)) for _ in range(50)]
    assert np.mean([formats.is_secret(x) for x in fresh]) > 0.9 and not any(map(formats.is_secret, other))
    assert formats.kinds["assign"][0].states() >= 4  # z, k, _ and digits
    few = secrets_scan.fit_formats({"assign": known[:3], "hex": []}, ordinary)
    assert set(few.kinds) == {"assign"} and np.mean([few.is_secret(x) for x in fresh]) > 0.5 and not any(map(few.is_secret, other))
    assert not secrets_scan.fit_formats({"assign": known}, []).is_secret(fresh[0])


@pytest.mark.parametrize("n", [30, 100])
def test_planted_formats_recall_and_precision(n):
    rng = random.Random(n)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    formats = {
        "prefix": lambda: "xq_prod_" + draw(letters, 24), "capitals": lambda: "ZQIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16),
        "groups": lambda: "-".join(draw("0123456789ABCDEF", 4) for _ in range(5)), "digits": lambda: "q7." + draw("0123456789", 9),
    }
    ordinary = list({draw("etaoinshrdlu", rng.randint(6, 14)) + rng.choice(["", ".", "s"]) for _ in range(1000)}) + [str(rng.randrange(10**8)) for _ in range(50)]
    for name, make in formats.items():
        learned = secrets_scan.fit_formats({"assign": [make() for _ in range(n)]}, ordinary[::2])
        found, wrong = sum(learned.is_secret(make()) for _ in range(200)), sum(map(learned.is_secret, ordinary[1::2]))
        assert found >= 0.9 * 200 and found / max(1, found + wrong) >= 0.95, (name, found, wrong)
        if name in ("prefix", "capitals"):
            assert learned.kinds["assign"][0].states() > 4
            assert not any(learned.is_secret(other()) for k, other in formats.items() if k != name for _ in range(20))


def test_short_and_dotted_credentials_are_candidates(spark):
    rng = random.Random(2)
    key = lambda: "q7." + "".join(rng.choice("0123456789") for _ in range(9))
    short = lambda: "".join(rng.choice("0123456789") for _ in range(8))
    labelled = [key() for _ in range(200)] + [short() for _ in range(200)]
    bare = [key() for _ in range(20)] + [short() for _ in range(20)]
    texts = [f"{prose(5)} token={x} {prose(5)}" for x in labelled] + [f"{prose(5)} {x} {prose(5)}" for x in bare] + [f"{prose(5)} {x}. {prose(5)}" for x in bare[20:]]
    texts += ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) + " " + prose(20) for _ in range(300)]
    got = {r.doc_id: r.spans for r in secrets_scan.scan(table(spark, texts)).collect()}
    assert np.mean(["format:" in got[400 + i] for i in range(60)]) > 0.9
    assert not any(got[460 + i] for i in range(300))
    clean = {r.doc_id: r.text for r in secrets_scan.redacted(table(spark, texts)).collect()}
    assert np.mean([x not in clean[400 + i] for i, x in enumerate(bare)]) > 0.9


def brute_repeats(texts, length, passage, words):
    raw = [(t or "").encode() for t in texts]

    def covers(n):
        seen = collections.Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
        for t in raw:
            cover = np.zeros(len(t), bool)
            for i in range(len(t) - n + 1):
                if seen[t[i : i + n]] > 1:
                    cover[i : i + n] = True
            yield cover

    for t, cover, wide in zip(raw, covers(length), covers(passage), strict=True):
        runs = int((np.diff(np.append(0, cover.astype(int))) == 1).sum())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], wide.astype(int), [0]]))).reshape(-1, 2)
        yield len(t), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~cover])).hexdigest(), sum(len(t[a:b].split()) > words for a, b in edges)


@pytest.mark.parametrize("hot", [64, 1])
def test_repeats_are_removed_exactly(spark, hot):
    texts = [*TEXTS, "a" * 900, "é" * 500, "\x00" * 700, BASE[100:700], "ab" * 300 + prose(20), prose(20) + "ba" * 300, prose(9) + BASE[:100] + prose(9)]
    got = sorted(suffix_dedup.remove_repeats(table(spark, texts), length=150, passage=80, passage_words=12, hot=hot, sub_shard=3).drop("kept").collect())
    want = list(brute_repeats(texts, 150, 80, 12))
    assert [tuple(r)[1:] for r in got] == want and len({w[4] for w in want}) > 1
    if hot == 1:
        assert suffix_dedup.remove_repeats(table(spark, texts).limit(0)).count() == 0


def test_repeated_rows_null_ids_and_wide_ids(spark):
    ids = [None, None, -(1 << 62) - 5, (1 << 63) - 1, 3, 3, 3]
    texts = [BASE, BASE, prose(90), BASE[:500] + prose(60), prose(80), None, ""]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = sorted((str(r[0]), *r[1:]) for r in suffix_dedup.remove_repeats(docs).drop("kept").collect())
    assert got == sorted((str(i), *w) for i, w in zip(ids, brute_repeats(texts, 400, 250, 50), strict=True))


def test_long_periodic_texts_stay_small():
    for text in (b"a" * 300_000, b"0123456789" * 30_000):
        data = np.frombuffer(text, np.uint8)
        h, row, first, last, again = suffix_dedup.anchors(suffix_dedup.gram_hashes(data), np.array([0, len(data)]), 400, len(data))
        assert (last - first + 400).sum() < 1.1 * len(data) and (last - first + 1).sum() == len(data) - 399
        assert (first[1:] == last[:-1] + 1).all() and len(set(h.tolist())) <= 10 and again.all()


def test_a_text_of_one_character(spark):
    texts = ["a" * 1_000_000, prose(100)]
    got = sorted(suffix_dedup.remove_repeats(table(spark, texts)).drop("kept").collect())
    assert [tuple(r)[1:4] for r in got] == [(1_000_000, 1_000_000, 1), (len(texts[1]), 0, 0)]


def test_runs_are_merged_by_binary_search():
    rng = np.random.default_rng(4)
    high, low, run = rng.integers(0, 60, 400), rng.integers(0, 3, 400), np.sort(rng.integers(0, 9, 400))
    pairs = sorted(set(zip(run.tolist(), high.tolist(), low.tolist(), strict=True)))
    times = collections.Counter((h, w) for _, h, w in pairs)
    runs = [np.array([(h, w, 0, 0, 0) for r, h, w in pairs if r == k], suffix_dedup.RUN) for k in sorted({p[0] for p in pairs})]
    rows, shared = suffix_dedup.merged_runs(runs)
    assert rows["high"].tolist() == sorted(h for _, h, _ in pairs) and sorted(zip(rows["high"].tolist(), rows["low"].tolist(), strict=True)) == sorted((h, w) for _, h, w in pairs)
    assert shared.tolist() == [times[h, w] > 1 for h, w in zip(rows["high"].tolist(), rows["low"].tolist(), strict=True)]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    end = np.full(300, 300)
    words = suffix_dedup.eight(data)
    order = suffix_dedup.suffix_array(words, end, 300)
    suffixes = [data[i:].tobytes() for i in range(300)]
    assert order.tolist() == sorted(range(300), key=lambda i: suffixes[i])

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    want = [0] + [min(20, common(suffixes[a], suffixes[b])) for a, b in zip(order[:-1], order[1:], strict=True)]
    assert suffix_dedup.common_prefixes(words, end, order, 20, stride=8).tolist() == want


@pytest.mark.parametrize("shared", [512, 513, 560, 670])
def test_shared_runs_longer_than_the_sorted_depth(shared):
    rng = np.random.default_rng(shared)
    length, texts = 400, []
    for _ in range(12):
        passage = rng.integers(97, 101, shared).astype(np.uint8)
        for _ in range(3):  # what follows the passage differs, and sorts either way
            texts.append(np.concatenate([passage, rng.integers(97, 101, 90).astype(np.uint8)]))
        for _ in range(8):  # a byte before the end of a window differs
            other = rng.integers(97, 101, shared).astype(np.uint8)
            at = int(rng.integers(1, shared - length + 1))
            other[: length - 1] = passage[at : at + length - 1]
            other[length - 1] = 97 + (passage[at + length - 1] - 96) % 4
            texts.append(other)
    data, bounds = np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts]))
    [(twice, group)] = suffix_dedup.repeated(data, bounds, (length,))
    windows = [(i, data[i : i + length].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in range(a, b - length + 1)]
    seen = collections.Counter(w for _, w in windows)
    assert twice.nonzero()[0].tolist() == [i for i, w in windows if seen[w] > 1]
    assert len({(group[i], w) for i, w in windows}) == len({w for _, w in windows}) == len({group[i] for i, _ in windows})


def brute_versions(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next) of (doc_id, text), nulls last."""
    pieces = lambda t: {p for p in re.split(r"(?<=[.!?\n])", t) if p}
    like = lambda a, b: len(pieces(a) & pieces(b)) / len(pieces(a) | pieces(b)) if pieces(a) | pieces(b) else 1.0
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), pytest.approx(like(t, edited)), pytest.approx(like(t, after))


SENTENCES = [". ".join(prose(RNG.randint(2, 5)).capitalize() for _ in range(n)) + "." for n in (30, 3, 60, 400, 25)]


@pytest.mark.parametrize(("rounds", "tries", "bucket"), [(12, 3, 512), (2, 1, 2), (1, 0, 3)])
def test_fingerprints_of_versions(spark, rounds, tries, bucket):
    texts = [*TEXTS, *SENTENCES, SENTENCES[2][:900] + SENTENCES[0]]
    ids = [-(1 << 62) - 5, (1 << 63) - 1, -(1 << 63), *range(7, 7 + len(texts) - 4), None]
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, hash string, row int")
    got = {r.doc_id: r for r in fingerprints.versions(docs, rounds, tries, bucket).collect()}
    want = {r[0]: r for r in brute_versions(list(zip(ids, texts, strict=True)))}
    assert len(got) == len(texts) and {i: (i, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for i, r in got.items()} == want
    assert got[ids[0]].fingerprint == got[ids[1]].fingerprint and got[ids[4]].fingerprint == got[ids[5]].fingerprint
    assert len({r.fingerprint for r in got.values()}) == len({t or "" for t in texts})


def test_fingerprints_can_be_read_back(spark):
    docs = table(spark, SENTENCES)
    rows = {r.doc_id: r for r in fingerprints.versions(docs).collect()}
    digests = {r.doc_id: set(r.d) for r in docs.select("doc_id", fingerprints.digests(docs.text).alias("d")).collect()}
    for i, t in enumerate(SENTENCES):
        width, cells = rows[i].fingerprint.split("/")
        width, found = int(width, 16), {}
        for cell in cells.split("-"):
            at, count, key = cell.split(".")
            found[int(at, 16)] = (int(count), int(key, 16))
        assert width >= 2 * len(digests[i]) and sum(c for c, _ in found.values()) == 3 * len(digests[i])
        for table_ in range(3):
            total = 0
            for at, (_, key) in found.items():
                total ^= key if at // width == table_ else 0
            want = 0
            for d in digests[i]:
                want ^= d & ((1 << 64) - 1)
            assert total == want
        if i == 1:  # all digests of a sketch whose cells are alone
            alone = {key for count, key in found.values() if count == 1}
            assert alone >= {d & ((1 << 64) - 1) for d in digests[i]}


def test_next_of_crowded_ids(spark):
    rng = random.Random(31)
    rows = [(i, prose(3, rng)) for i in [5] * 40 + [None] * 30 + list(range(100, 110)) + [1 << 62] + [-3] * 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, _ = fingerprints.with_next(docs, bucket_rows=4)
    got = found.collect()
    after = {(r.doc_id, r.text): r.next_text for r in got}
    assert len(got) == len(rows) and len({r.bucket for r in got}) > 10 and max(r.row for r in got) < 25
    at, seen = (1 << 62, next(t for i, t in rows if i == 1 << 62)), []
    text_of = {t: i for i, t in rows}
    for _ in rows:
        seen.append(at[0])
        at = (text_of[after[at]], after[at])
    assert at[0] == 1 << 62 and seen == sorted([i for i, _ in rows if i is not None], reverse=True) + [None] * 30


def test_fingerprints_of_few_rows(spark):
    assert fingerprints.versions(table(spark, TEXTS).limit(0)).count() == 0
    only = fingerprints.versions(table(spark, [BASE])).collect()
    assert [(r.doc_id, r.near_edited < 1, r.near_next) for r in only] == [(0, True, 1.0)]
    same = spark.createDataFrame([(5, BASE)] * 3 + [(None, BASE)] * 3, "doc_id long, text string")
    assert [(r.near_next, r.n_chars) for r in fingerprints.versions(same).collect()] == [(1.0, len(BASE))] * 6


def brute_simhash(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = random.Random(5)
    long = [rng.choice(WORDS) for _ in range(900)]
    texts = list(TEXTS)
    for _ in range(60):
        copy = list(long)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    prints = np.array([brute_simhash(t, 3) for t in texts], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.arange(len(texts))
    while (less := np.array([label[row].min() for row in near])).tolist() != label.tolist():
        label = less
    for rows in (1024, 4):
        got = sorted(simhash.near_duplicates(table(spark, texts), trie_rows=rows).collect())
        assert [r.fp for r in got] == prints.view(np.int64).tolist()
        assert [r.component_id for r in got] == label.tolist()
    assert len(set(label.tolist())) < len(texts) - 20
    left = simhash.one_of_each(table(spark, texts)).select("doc_id").collect()
    assert {0, 6, 7, 8, 9} <= {r.doc_id for r in left} and not {1, 5} & {r.doc_id for r in left} and len(left) < len(texts)


def like(a, b):
    a, b = (set(simhash.shingle_hashes(t, 5)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_down_to_the_limit_go(spark):
    rng = random.Random(11)
    texts, want = [], set()
    for i in range(60):
        words = [rng.choice(WORDS) for _ in range(240)]
        copy = list(words)
        for at in rng.sample(range(10, 230), 1 + i % 6):
            copy[at] = "changed"
        texts += [" ".join(words), " ".join(copy)]
        want |= {2 * i} | ({2 * i + 1} if like(*texts[-2:]) < 0.8 else set())
    assert 60 < len(want) < 80
    assert {r.doc_id for r in simhash.one_of_each(table(spark, texts)).select("doc_id").collect()} == want


@pytest.mark.parametrize("most_pairs", [4, 0])
def test_members_far_from_the_first_are_compared_with_each_other(spark, most_pairs):
    rng = random.Random(12)
    words = [rng.choice(WORDS) for _ in range(2000)]
    texts = [" ".join(words)]
    for i in range(70):
        words = list(words)
        words[10 + 25 * i : 14 + 25 * i] = rng.choices(WORDS, k=4)
        texts.append(" ".join(words))
    texts += [texts[-1], texts[-2], texts[-1] + " more"]
    want = []
    for i, t in enumerate(texts):
        if all(like(t, texts[k]) < 0.8 for k in want):
            want.append(i)
    assert len(want) > 1
    assert sorted(r.doc_id for r in simhash.one_of_each(table(spark, texts), most_pairs=most_pairs).select("doc_id").collect()) == want


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 255, 256, 700, 0, 3]
    hashes, bounds = rng.integers(0, 1 << 63, sum(sizes), np.uint64), np.append(0, np.cumsum(sizes))
    factors = np.random.default_rng(simhash.SEED).integers(0, 1 << 63, 3, np.uint64) * np.uint64(2) + np.uint64(1)
    got = simhash.wide_fingerprints(hashes, bounds, 3)
    for i, n in enumerate(sizes):
        for k, factor in enumerate(factors):
            values = hashes[bounds[i] : bounds[i + 1]] * factor
            values = [int(v) for v in values ^ (values >> np.uint64(32))]
            ones = [sum(v >> b & 1 for v in values) for b in range(64)]
            assert int(got[i, k]) == sum(1 << b for b in range(64) if 2 * ones[b] > n or (n and 2 * ones[b] == n and values[0] >> b & 1))


@pytest.mark.parametrize("hot", [512, 8])
def test_tries_find_the_near_members_of_buckets(hot):
    rng = np.random.default_rng(6)
    bucket = np.sort(rng.integers(0, 40, 900))
    one, two = (rng.integers(0, 4, 900).astype(np.uint64) << np.uint64(20) | rng.integers(0, 1 << 14, 900).astype(np.uint64) for _ in range(2))
    later, first, place = simhash.near_members(bucket, np.arange(900), one, two, 5, 11, hot)
    bits = lambda x, i, j: int(x[i] ^ x[j]).bit_count()
    want = {(i, j) for i in range(900) for j in range(i) if bucket[i] == bucket[j] and place[j] < hot and bits(one, i, j) <= 5 and bits(one, i, j) + bits(two, i, j) <= 11}
    assert set(zip(later.tolist(), first.tolist(), strict=True)) == want and len(want) == len(later) > 100


def test_near_pairs_of_a_large_bucket_come_by_and_by():
    import pyarrow as pa

    n, hot = 3000, 512
    stays = np.arange(n) < hot
    columns = [np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), stays]
    rows = pa.table(columns, names=["bucket", "doc_id", "one", "two", "stays"]).to_batches(max_chunksize=700)
    found = list(simhash._near(20, 34, 0, hot, most_rows=1000)(iter(rows)))
    assert sum(x.num_rows for x in found) == (n - hot) * hot and max(x.num_rows for x in found) <= 1 << 19
    later, first = (np.concatenate([np.asarray(x.column(k)) for x in found]) for k in (0, 1))
    assert len(np.unique(later * n + first)) == (n - hot) * hot and first.max() < hot <= later.min()
    few = pa.Table.from_batches(list(simhash._near(20, 34, 4, hot, most_rows=1000)(iter(rows)))).to_pydict()
    pairs = [(a, b) for a, b in zip(few["doc_id"], few["first"], strict=True) if b is not None]
    assert sorted(pairs) == [(a, b) for a in range(n) for b in range(min(a, 4))]
    assert {a for a, b in zip(few["doc_id"], few["first"], strict=True) if b is None} == set(range(5, n))


def test_unlike_texts_are_no_candidates(spark, monkeypatch):
    rng = random.Random(13)
    shared = [rng.choice(WORDS) for _ in range(60)]
    texts = [" ".join(shared + [rng.choice(WORDS) + str(i) for _ in range(60)]) for i in range(60)] + [" ".join(shared)] * 2
    assert 0.2 < like(texts[0], texts[1]) < 0.4
    compared, similar = [], simhash._similar

    def spy(pairs, *more):
        compared.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(simhash, "_similar", spy)
    assert simhash.one_of_each(table(spark, texts)).count() == 61
    assert sum(compared) < 100  # of 1,830 pairs


def test_secret_scores_are_worked_out_once():
    rng = random.Random(14)
    texts = ["sk_live_" + "".join(rng.choices("abcdef0123456789", k=24)) for _ in range(60)]
    automaton = secrets_scan.infer(texts)
    made, step = [], automaton.step
    automaton.step = lambda *x: made.append(x[:2]) or step(*x)
    first = [automaton.bits(t) for t in texts]
    n = len(made)
    assert [automaton.bits(t) for t in texts] == first and len(made) == n == len(set(made))
    for t, total in zip(texts, first, strict=True):  # against the definition
        state, want = 0, automaton.length_bits(len(t))
        for c in t:
            bits, state = step(state, c, 2.0)
            want += bits
        assert total == want + secrets_scan.math.log2((automaton.ends[state] + 0.5) / (automaton.visits[state] + 1.0))


def test_decontamination_against_all_windows(spark):
    items = [prose(20), prose(35), "two words", prose(12)]
    inside = items[1].split()
    inside[10] = "changed"
    texts = [prose(30) + " " + items[0].upper() + "! " + prose(30), items[1], prose(5) + " " + " ".join(inside), "Two, words", "two words more", None, "", prose(400), items[3] + " " + items[3]]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*items, None, ""])], "item_id long, text string, doc_id string")
    words = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
    runs = lambda w: collections.Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([" ".join(w)] if w else [])
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            w, n = words(t), len(words(item))
            if n < 5 and len(w) != n:  # short items match whole documents only
                continue
            for at in range(max(1, len(w) - n + 1)):
                a, b = runs(w[at : at + n]), runs(words(item))
                s = sum((a & b).values()) / max(1, sum((a | b).values()))
                if s >= 0.8 and s > want.get((d, i), (0, 0))[1]:
                    want[d, i] = (at, s)
    got = {(r.doc_id, r.item_id): (r.start_word, pytest.approx(r.similarity)) for r in decontamination.contaminated(table(spark, texts), bench).collect()}
    assert got == want and (0, 0) in want and (3, 2) in want
    assert {r.doc_id for r in decontamination.clean(table(spark, texts), bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_decontamination_recall_against_every_window(spark):
    rng = random.Random(21)
    fresh = lambda n: [rng.choice(WORDS) for _ in range(n)]
    line = fresh(9)  # a passage that all items and many documents share
    items = [fresh(rng.randint(6, 30)) + (line if i % 2 else []) + fresh(rng.randint(6, 20)) for i in range(24)]
    texts = []
    for i in range(160):
        item = list(items[i % 24])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(item))
            edit = rng.randrange(3)
            item[at : at + (edit != 1)] = [] if edit == 0 else [rng.choice(WORDS)]
        texts.append(fresh(rng.randint(0, 60)) + item + fresh(rng.randint(0, 60)) if i < 120 else fresh(30) + line + fresh(30))
    runs = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for d, w in enumerate(texts):
        for i, item in enumerate(items):
            b = runs(item)
            for at in range(max(1, len(w) - len(item) + 1)):
                a = runs(w[at : at + len(item)])
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= 0.8:
                    want[d, i] = max(s, want.get((d, i), 0))
    docs = table(spark, [" ".join(w) for w in texts])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in decontamination.contaminated(docs, bench).collect()}
    assert len(want) > 30 and got == want


def test_field_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(toxicity.SLOTS), 0.0, rng.normal(size=(2, 2)), rng.normal(size=2))
    for sizes in ([5], [1, 3, 4], [200, 1, 7]):
        score = rng.normal(size=sum(sizes))
        heads = np.cumsum([0, *sizes])[:-1]
        p = field.marginals(score, heads)
        for h, n in zip(heads, sizes, strict=True):
            if n > 8:
                continue
            total = np.zeros(n)
            mass = 0.0
            for path in range(1 << n):
                y = [path >> i & 1 for i in range(n)]
                w = np.exp(field.start[y[0]] + sum(field.step[a, b] for a, b in zip(y[:-1], y[1:], strict=True)) + sum(s for s, v in zip(score[h : h + n], y, strict=True) if v))
                mass += w
                total += w * np.array(y)
            assert p[h : h + n] == pytest.approx(total / mass)


def test_toxicity_is_learned_from_labels(spark):
    rng = random.Random(3)
    texts, toxic = [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(60)] = rng.choice(["vilewrd", "nastyone", "rottenly"])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = table(spark, [*texts, None, "", "You nastyone é"])
    labels = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(toxic)] + [(1, None, "null")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i].predicted == t for i, t in enumerate(toxic)]) > 0.97
    assert got[400].score == got[401].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())
    assert [(s.start, s.stop) for s in got[402].spans] == [(4, 12)]
    assert toxicity.kept(docs, model).count() == sum(r.predicted == 0 for r in got.values())
    assert toxicity.fit(docs, labels.limit(0)) is None and {r.score for r in toxicity.score(docs.limit(3), None).collect()} == {0.0}


def test_words_and_offsets():
    coded, before, begin, end, points = toxicity.words_of(pa.array(["é a_b", "", "x"]))
    assert coded.to_pylist() == ["é".encode(), b"a_b", b"x"] and before.tolist() == [0, 2, 2, 3]
    assert points[begin].tolist() == [0, 2, 0]
