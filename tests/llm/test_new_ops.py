"""Prefix trie, periodic runs, byte-level BPE and near copies under shared ids, against brute force and libraries."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import time
import zlib

import numpy as np
import pytest
from test_ops import clash, root_of, slow_fingerprint

from spanloom.llm import byte_bpe, exact_dedup, licenses, periodic, prefix_trie, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# prefix trie


def slow_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        turns.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    built, members, children, out = {}, {}, {}, []
    for c, v in turns.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 4
        built[c] = tuple(turns.get(c if c is None else c - c % 20, [])[:h] + v[h:])
    least = lambda c: (c is not None, c or 0)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def total(p):
        leaves, saved = 0, (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
        for k in children.get(p, []):
            more, tokens = total(k)
            leaves, saved = leaves + more, saved + tokens
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c in members[p] if built[c] == p), key=least))
        up = min(members[p[:-1]], key=least) if p else None
        out.append((min(members[p], key=least), len(p), up, len(members[p]), len(children.get(p, [])), leaves or 1, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves or 1, saved

    if rows:
        total(())
    return out


def by_value(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("case", ["mixed", "shared", "empty"])
def test_prefix_trie(spark, case, monkeypatch):
    rng, rows = random.Random(5), []
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 3)
    if case == "mixed":  # null and equal turns, nulls, a null conversation, absent first conversations, a long one
        for c in [*range(50), None, 1000, 1007]:
            for t in range(rng.choice([1, 1, 2, 3, 5, 8, 300 if c == 7 else 4])):
                rows.append((c, rng.choice([t, None, 3]) if t % 5 == 3 else t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "long  text\twith x"])))
    if case == "shared":  # all conversations are beginnings of one another
        rows = [(c, t, "u", "same words here") for c in range(100) for t in range(c % 7 + 1)] + [(40, t, "u", "same words here") for t in range(600)]
    sys.setrecursionlimit(5000)
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert by_value(prefix_trie.prefix_trie(df).collect()) == by_value(slow_trie(rows))


# periodic runs


def slow_runs(w, least=24):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if len(part) >= max(least, 3 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(rng, n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 2 else 0):
        p, a = rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 20, 31, 32, 33, 40]), rng.randrange(n)
        for i in range(p, rng.randint(0, n - a)):
            w[a + i] = w[a + i % p]
    return w


def test_runs_against_all_periods():
    rng = random.Random(1)
    for _ in range(600):
        w = planted(rng, rng.randint(0, 200), rng.choice([1, 2, 2, 3, 5, 40]))
        assert periodic.find_runs(np.array(w, np.int64)) == slow_runs(w)


def test_runs_of_very_long_texts():
    assert periodic.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    w = np.arange(40_000) % 13_000
    assert periodic.find_runs(w) == [(0, 40_000, 13_000)]
    assert periodic.find_runs(np.arange(38_999) % 13_000) == []


def test_periodic_runs_of_documents(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "x", "x " * 24, "x " * 23, "a b\x0bc " * 9, "é ü　 " * 30]
    texts += [" ".join(f"w{i}" for i in planted(rng, rng.randint(1, 160), 6)) for _ in range(80)]
    rows = [*enumerate(texts), (None, "y " * 30), (5, "z " * 40)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(df).collect()}
    want = set()
    for d, text in rows:
        w = WORD.findall(text or "")
        runs = slow_runs(w)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
        want.add((d, len(w), tuple(runs), " ".join(kept)))
    assert got == want
    assert periodic.run_digests(periodic.periodic_runs(df.limit(0))).count() == 0


# byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=byte_bpe.read_ranks(vocabulary[0]), special_tokens={})


def odd_texts():
    rng = random.Random(4)
    out = [None, "", "a", "<|endoftext|>", "don't 12345 ½ ² ٣", "a" * 3000, " " * 2000, "　\x1c\x1d\x85\xa0 x\x00y", "hi  \n\n  x ", "東京🙂" * 50]
    out += ["".join(rng.choice("abcdefghij éüß'\n") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    return out + ["x" + chr(c) + "1 " + chr(c) + chr(c) + "y" for c in range(1, 0x3000)] + out[:20]


def test_byte_bpe_equals_the_library(spark, vocabulary, library):
    texts = odd_texts()
    df = clash(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).repartition(3)
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in byte_bpe.encode_and_decode(df, *vocabulary, at_once=5000).collect()}
    assert got == {i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}
    assert byte_bpe.encode_and_decode(df.limit(0), *vocabulary).count() == 0


def test_merges_that_make_a_pair_of_a_lower_rank(library):
    """A vocabulary that no training gives: after (b, c), rank 259, the pair (a, bc) has rank 258."""
    ranks = {bytes([b]): b for b in range(256)} | {b"zz": 256, b"zy": 257, b"abc": 258, b"bc": 259, b"bca": 260}
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    replay = byte_bpe.MergeReplay(ranks)
    words = ["abcabc", "bcabca", "aabcbc", "zzzzy", "zyzz", "abc", "bcbca" * 5]
    ids, counts = replay.encode([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [enc.encode_ordinary(w) for w in words]


def test_words_are_forgotten_and_met_again(vocabulary, library):
    bpe = byte_bpe.ByteBPE(*vocabulary, most=50)
    for k in range(4):
        texts = [t or "" for t in odd_texts()[k : 400 : 4 - k]]
        ids, counts = bpe.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [*map(library.encode_ordinary, texts)]


# near copies under shared and null ids


def test_near_copies_under_shared_and_null_ids(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]

    def near(text):
        """Another text whose fingerprint is 1 to 4 bits away."""
        at = slow_fingerprint(text)
        while True:
            parts = text.split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(words)
            if 0 < (slow_fingerprint(" ".join(parts)) ^ at).bit_count() <= 4:
                return " ".join(parts)

    t1, b, c, e = (" ".join(rng.choices(words, k=300)) for _ in range(4))
    rows = [(0, t1), (1, near(t1)), (1, b), (None, near(t1)), (None, c), (None, c), (5, c), (7, e), (7, near(e)), (7, e)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    once = exact_dedup.drop_exact_copies(df)
    left = simhash.drop_near_copies(once)
    assert left.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    last = min(rows[7][1], rows[8][1], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert got == sorted([(0, t1), (1, b), (5, c), (7, last)], key=str)
    fps = [slow_fingerprint(t) for _, t in rows]
    roots = root_of([(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4], range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[roots[i]] = min((x for x in (d, least.get(roots[i])) if x is not None), default=None)
    want = sorted((str(d), f"{fps[i]:016x}", least[roots[i]]) for i, (d, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()) == want



# toxicity: the model against its definition; bounds


def test_scores_are_the_noisy_or_of_all_sentences():
    rng = random.Random(9)
    model = toxicity.Model(-2.0, {"bad": 3.0, "awf*": 1.5, "good": -1.0, "é": 0.7})
    words = ["bad", "Bad", "awful", "awf", "good", "é", "plain", "badly", "x2"]
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ". ", "! ", "\n", "… "]) for _ in range(rng.randint(0, 30)))
        clean = 1.0
        for s in toxicity.sentences(text):
            held = {f for w in {*toxicity.WORD.findall(s.lower())} for f in toxicity.features(w)}
            clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(f, 0) for f in held))))
        assert abs(model.score(text) - (1 - clean)) < 1e-12, text


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    bags = [[sorted({*map(int, rng.integers(0, 6, rng.integers(1, 4)))}) for _ in range(rng.integers(0, 4))] for _ in range(40)]
    data = toxicity.Bags(bags, [int(x) for x in rng.integers(0, 5, 40)], [int(x) for x in rng.integers(0, 2, 40)])
    theta = rng.normal(0, 1, 8)
    loss, grad = data.loss(theta)
    plain = 0.0
    for ss, n0, y in zip(bags, data.plain, data.y, strict=True):
        clean = np.prod([1 - 1 / (1 + np.exp(-(theta[6] + sum(theta[w] for w in s)))) for s in ss] + [1 - 1 / (1 + np.exp(-theta[7]))]) * (1 - 1 / (1 + np.exp(-theta[6]))) ** n0
        plain -= np.log(1 - clean if y else clean) / 40
    assert abs(loss - plain) < 1e-9
    for k in range(8):
        step = np.zeros(8)
        step[k] = 1e-6
        assert abs((data.loss(theta + step)[0] - data.loss(theta - step)[0]) / 2e-6 - grad[k]) < 1e-6


def test_fitting_is_bounded_where_ids_repeat(spark, monkeypatch):
    held = []
    monkeypatch.setattr(toxicity, "fit_bags", lambda bags, *rest: held.append(len(bags)) or (-3.0, np.zeros(rest[2])))
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(ids[k % 2], f"word{k % 2} text number {k}") for k in range(2000)], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(ids[0], 0, 1), (ids[1], 1, 0)], "doc_id long, quality int, toxic int"), rows=100)
    assert held == [100]


# licences: time in proportion to the detections


def test_licences_in_very_long_texts(spark):
    line = "copyright 2020 acme. all rights reserved. licensed under the mit license\n"
    began = time.perf_counter()
    df = spark.createDataFrame([(1, line * 10_000), (2, line * 300), (3, line)], "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.detections for r in licenses.scan(df).collect()}
    assert time.perf_counter() - began < 60
    one = [(d.start, d.stop, d.label) for d in out[3]]
    assert {label for _, _, label in one} == {"copyright-notice", "all-rights-reserved", "mit"}
    for n, found in ((300, out[2]), (10_000, out[1])):
        assert [(d.start, d.stop, d.label) for d in found] == [(a + k * len(line), b + k * len(line), label) for k in range(n) for a, b, label in one]
