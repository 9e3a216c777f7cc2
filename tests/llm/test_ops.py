"""The ten operators against brute force, libraries and round trips, on small fixtures with nulls, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat, embed_dedup, exact_dedup, license_rules, licenses, packing, piece_match, queries, simhash, tokenfile, toxicity, warc

WORDS = "the a License MIT apache general public license's garden É über code 12ab it's don't river-bank (x) ### </turn> \\h \\ . , ! naïve 東京 🙂  ".split(" ")
CLASH = ("n", "key", "fp", "id", "digest", "stays", "component", "salt", "rank", "length", "prefix", "node", "low", "keep_id", "sha", "window")


def clash(df):
    """``df`` with columns named like those that operators make."""
    return df.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "one", "a b c", "a b c", "A B C", "MIT License", "x " * 9000, "<|endoftext|> y", "  two  spaces   here ", "a\x1cb\x00c"]
    for _ in range(120):
        out.append(" ".join(rng.choices(WORDS, k=rng.randint(1, 90))))
    long = " ".join(rng.choices(WORDS, k=400))
    return [*out, long, long + " z", long, *out[30:40]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).transform(clash).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def root_of(links: list[tuple[int, int]], nodes) -> dict[int, int]:
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# 1 packing


def library_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_tokenizer())
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x in enumerate(texts)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, texts, empty):
    out = packing.pack_documents(docs, queries.word_tokenizer()).collect()
    ids = library_ids(texts, 1)
    expected = {(d, k): (s, len(x[s : s + 4096]), crc(x[s : s + 4096])) for d, x in ids.items() for k, s in enumerate(range(0, len(x), 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == expected and len(out) == len(expected)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for xs in by.values():
        at = 0
        for offset, length in sorted(xs):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(map(len, ids.values())) // 4096) + 1
    assert packing.pack_documents(empty, queries.word_tokenizer()).count() == 0


def test_packing_keeps_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    out = packing.pack_documents(docs, queries.word_tokenizer(), 8).collect()
    assert len(out) == 3 and len({(r.sequence_id, r.offset) for r in out}) == 3


def test_plan_holds_each_piece_once_and_is_near_the_bound():
    rng = random.Random(1)
    for _ in range(8):
        histogram = Counter(min(256, int(rng.paretovariate(0.7) * 9)) for _ in range(rng.randint(1, 3000)))
        plan = packing.plan(histogram, 256)
        held = Counter()
        for n, config in plan:
            assert sum(x * c for x, c in config.items()) <= 256
            for x, c in config.items():
                held[x] += n * c
        assert held == histogram
        bound = packing.dual_bound(histogram, 256)
        large = sum(v for k, v in histogram.items() if k > 128)
        assert sum(n for n, _ in plan) >= bound >= max(large, sum(k * v for k, v in histogram.items()) / 256) - 1e-6
        assert sum(n for n, _ in plan) <= max(large, sum(k * v for k, v in histogram.items()) / 256) * 1.05 + 2


def test_knapsack_against_all_multisets():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths, values, copies = rng.choice(np.arange(2, 9), 3, replace=False), rng.random(3), rng.integers(1, 4, 3)
        best = max(values @ (a, b, c) for a in range(copies[0] + 1) for b in range(copies[1] + 1) for c in range(copies[2] + 1) if lengths @ (a, b, c) <= 20)
        got = packing.knapsack(lengths, values, copies, 20)
        assert sum(k * v for k, v in got.items()) <= 20
        assert sum(values[list(lengths).index(k)] * v for k, v in got.items()) == pytest.approx(best)


# 2 token files


def test_token_files(docs, texts, empty):
    out = sorted(tokenfile.round_trip(docs, queries.word_tokenizer()).collect())
    start, expected = 0, []
    for d, ids in library_ids(texts, 2).items():
        expected.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out] == expected
    assert tokenfile.round_trip(empty, queries.word_tokenizer()).count() == 0


def test_blocks_round_trip_and_tell_damage():
    rng = np.random.default_rng(0)
    for size in (0, 1, 5, 31, 700, 40_000):
        docs = [(None, np.array([2])), *((i, np.append(rng.zipf(1.3, size).clip(max=49_000), 2)) for i in range(3))]
        block = tokenfile.encode_block(docs)
        back = tokenfile.decode_block(block)
        assert [d for d, _ in back] == [d for d, _ in docs]
        assert all(np.array_equal(a, b) for (_, a), (_, b) in zip(back, docs, strict=True))
        with pytest.raises(ValueError):
            tokenfile.decode_block(block[:-1] + bytes([block[-1] ^ 1]))
    same = [(0, np.tile(np.arange(50), 2000))]
    order_0 = 100_000 * np.log2(50) / 8
    assert len(tokenfile.encode_block(same)) < 0.6 * order_0
    assert tokenfile.decode_block(tokenfile.encode_block([])) == []


def test_places_are_told_by_stretches():
    rng = np.random.default_rng(8)
    for alphabet in (1, 2, 700, 49_000):
        model = tokenfile._Model(alphabet)
        for step in range(3):
            places = np.append(rng.integers(model.total, size=5000), [0, model.total - 1])
            assert np.array_equal(model._place(places), np.searchsorted(model.below, places, side="right") - 1)
            model.fresh = [rng.zipf(1.2, 200_000 * step + 9).clip(max=alphabet) - 1]
            model._sum()


def test_token_blocks_are_smaller_than_their_order_0_entropy(spark):
    from spanloom.llm.tokens import WordEncoder

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids, ends = WordEncoder(queries.word_tokenizer()).encode(texts)
    block = tokenfile.encode_block([(i, ids[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))])
    n = np.bincount(ids)
    p = n[n > 0] / len(ids)
    assert len(block) * 8 / len(ids) < -(p * np.log2(p)).sum() - 0.3
    assert np.array_equal(np.concatenate([x for _, x in tokenfile.decode_block(block)]), ids)


def test_word_ids_are_those_of_the_library():
    from spanloom.llm.tokens import WordEncoder

    rng, encoder = random.Random(3), WordEncoder(queries.word_tokenizer(), max_pieces=300)
    parts = [*"aZé ÿßÀ×÷ªºµ'.,!-_\x00\x1c\x1f\t\n \u0085\u1680ſKİıŸ中é9²½<|/w>́\u200b\ufeff😀", "'s", "'ll", "<|endoftext|>", "</w>", "don't", "Été", "(abc)"]
    texts = [None, "", *("".join(rng.choices(parts, k=rng.choice([1, 2, 5, 30, 100]))) for _ in range(2000))]
    for lo in range(0, len(texts), 250):
        ids, ends = encoder.encode(texts[lo : lo + 250])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[lo : lo + 250]]
    encoder.last[:] = False  # as with a model that marks no ends of words
    encoder._reset()
    ids, _ = encoder.encode(["unmarked ends, unmarked words"])
    assert ids.tolist() == encoder.tokenizer.encode("unmarked ends, unmarked words", add_special_tokens=False).ids


def test_python_meets_a_word_once_in_all_its_spellings():
    import sys

    from spanloom.llm.tokens import WordEncoder

    rng, encoder, calls = random.Random(4), WordEncoder(queries.word_tokenizer()), Counter()
    words = sorted({"".join(rng.choices("aeionrst", k=9)) for _ in range(2000)})
    text = " ".join(f"{w} {w.title()} {w}, ({w}) {w.upper()}!" for w in words)
    expected = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        ids, _ = encoder.encode([text])
    finally:
        sys.setprofile(None)
    assert ids.tolist() == expected
    assert calls["call"] + calls["c_call"] < 3 * len(words) + 1000  # each spelling took several calls of its own before


# 3 chat


@pytest.fixture(scope="module")
def turns(spark):
    rng, rows = random.Random(5), []
    for conv in [*range(12), None]:
        for turn in range(rng.choice([1, 2, 9, 60])):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant"])
            text = rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.choice([3, 40, 300])))])
            rows.append((conv, turn, role, text))
    rows += [(99, t, "assistant" if t % 2 else "user", f"t{t} \\t </turn>\n### x") for t in range(900)]
    rows += [(98, 0, None, "no role"), (98, 1, "odd\nrole", "x"), (98, 1, "odd\nrole", "x"), (97, 0, "assistant", "w" * 30_000)]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").transform(clash).cache()


def test_chat_windows(turns):
    by = defaultdict(list)
    for r in turns.collect():
        by[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    windows = chat.chat_windows(turns).cache()
    got = {r.conv_id: r for r in chat.window_digests(windows).collect()}
    assert got.keys() == by.keys()
    chars = Counter()
    for w in windows.collect():
        chars[w.conv_id] += len(w.formatted)
        assert w.tokens <= 2048 or w.n_turns == 1
        for s in w.loss_spans:
            assert w.formatted[: s.start].endswith("### assistant\n") and w.formatted[s.start + s.length :].startswith("</turn>\n")
    for conv, xs in by.items():
        xs.sort(key=lambda x: x[0])
        all_, loss = "".join(f"{r}\n{t}\n" for _, r, t in xs), "".join(t for _, r, t in xs if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(xs), hashlib.sha256(all_.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == chars[conv]
    assert chat.chat_windows(turns.limit(0)).count() == 0


def test_chat_windows_repeat_system_and_history(turns):
    windows = [w for w in chat.chat_windows(turns.filter("conv_id = 99 or conv_id < 12")).collect() if w.window > 1]
    assert any(w.n_context for w in windows) and all(w.n_context <= 3 for w in windows)


def test_chat_windows_repeat_a_long_system_turn(spark):
    rows = [(c, 0, "system", "s" * n) for c, n in ((1, 5000), (2, 20_000), (None, 5000))]
    rows += [(c, t, "assistant" if t % 2 == 0 else "user", f"{t} " + "w" * 300) for c in (1, 2, None) for t in range(1, 40)]
    windows = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    for conv, n in ((1, 5000), (2, 20_000), (None, 5000)):
        mine = [w for w in windows if w.conv_id == conv]
        assert sum(w.n_turns for w in mine) == 40 and len(mine) > 3
        for w in mine:
            assert w.formatted.startswith("### system\n" + "s" * n + "</turn>\n") and w.formatted.count("### system\n") == 1
            assert w.tokens <= 2048 if n == 5000 else w.n_turns == 1


# 4 SentencePiece


def test_sentencepiece_runs_of_spaces_and_long_stretches():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    m = piece_match.Matcher(queries.piece_model())
    odd = ["   ", " ", "", None, "x", "hello world", "hello  world", " \n ", "  é ß\n\n   \n  ▁▁x　 y", "x" * 5000, "\x00 a\x00", "日本  語", "🙂  🙂", " " * 100_000]
    for text in [*odd, *("q" * k + " " * k + "!" + " " * (k + 3) for k in range(40))]:
        ids, _ = m.encode([text])
        assert ids.tolist() == sp.encode(text or "")
        assert m.decode(ids.tolist()) == sp.decode(ids.tolist())
    ids, ends = piece_match.Matcher(queries.piece_model()).encode(odd)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [sp.encode(t or "") for t in odd]


def test_sentencepiece_over_a_whole_table(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in table.select("doc_id", "text").collect()}
    out = piece_match.encode(table, queries.piece_model()).collect()
    assert len(out) == len(texts) and all(list(r.ids) == sp.encode(texts[r.doc_id]) for r in out)


def test_sentencepiece(docs, texts, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    out = {r.doc_id: r for r in piece_match.encode_and_decode(docs, queries.piece_model()).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert out[i].ids == ids, t
        assert (out[i].n_pieces, out[i].ids_crc32) == (len(ids), crc(ids))
        assert out[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert piece_match.encode_and_decode(empty, queries.piece_model()).count() == 0


# 5 exact deduplication


def test_exact_dedup(docs, texts, empty):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    expected = [(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g]
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect())) == sorted(expected)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {max(g) for g in groups.values()}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_drop_exact_copies_keeps_each_text_under_shared_and_null_ids(spark):
    least = -(1 << 63)
    rows = [(None, "a"), (None, "b"), (1, "c"), (1, "d"), (1, "d"), (2, "d"), (None, "d"), (1, None), (3, ""), (None, "e"), (None, "e"), (least, "f"), (None, "f"), (least, "g")]
    kept = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string").transform(clash))
    assert kept.columns == ["doc_id", "text", *CLASH]
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    f = next(x for x in got if x[1] == "f")
    assert got == Counter([(None, "a"), (None, "b"), (1, "c"), (2, "d"), (3, ""), (None, "e"), (least, "g"), f])


def test_exact_dedup_forgets_deleted_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "doc_id long, text string")
    gone = spark.createDataFrame([(3,), (4,), (4,)], "doc_id long")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, gone).collect()} == {(1, 2, 2), (2, 2, 2), (5, 5, 1)}


def test_cuckoo_index_against_a_dictionary():
    rng, index, live = random.Random(4), exact_dedup.CuckooIndex(4), Counter()
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for _ in range(12_000):
        k = rng.choice(keys)
        if rng.random() < 0.6:
            index.insert(k, 1, 0)
            live[k] += 1
        else:
            assert index.delete(k, 1) == (live[k] > 0)
            live[k] = max(0, live[k] - 1)
    assert {x[0]: x[3] for x in index.entries()} == {k: n for k, n in live.items() if n}
    assert all(index.may_hold(k) for k, n in live.items() if n)


# 6 toxicity


def test_toxicity_learns_sentences_from_document_labels(spark):
    rng = random.Random(8)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        ss = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.randint(1, 30))]
        bad = rng.random() < 0.3
        if bad:
            ss.insert(rng.randrange(len(ss) + 1), "you vile scum " + rng.choice(plain))
        rows.append((i, ". ".join(ss)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (9002, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (9001, None)], "doc_id long, toxic int"))
    out = toxicity.score_documents(docs, model).collect()
    truth = dict(labels)
    assert len(out) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r.predicted == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]
    assert sum(held) / len(held) > 0.97
    assert {r.score for r in out if r.doc_id > 9000} == {0.0}
    found = toxicity.offending_sentences(docs.filter("doc_id < 900"), model).collect()
    assert found and all("vile scum" in r.sentence for r in found)


def test_toxicity_without_labels(spark, docs):
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_documents(docs, model).collect()} == {0.0}


def test_toxicity_tells_unseen_forms_by_their_stem(spark):
    rng = random.Random(9)
    plain = [a + b for a in ("ba", "di", "gor", "lum", "ne") for b in ("ta", "ri", "sol", "mek")]
    ends = [x + y for x in "aeiou" for y in ("st", "nd", "rk", "ll", "mp")]
    rows, labels = [], []
    for i in range(1200):
        ss = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.randint(1, 12))]
        bad = rng.random() < 0.15
        # labels that may be learnt have half of the endings, the others the other half
        mine = ends[::2] if zlib.crc32(str(i).encode()) % 3 != 1 else ends[1::2]
        if bad:
            for _ in range(2):
                ss.insert(rng.randrange(len(ss) + 1), " ".join([rng.choice(plain), "zwark" + rng.choice(mine), rng.choice(plain)]))
        rows.append((i, ". ".join(ss)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").transform(clash)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    held = [r for r in toxicity.score_documents(docs, model).collect() if r.held_out]
    bad = [r.predicted for r in held if truth[r.doc_id]]
    assert len(bad) > 20 and sum(bad) / len(bad) >= 0.95
    assert not any(r.predicted for r in held if not truth[r.doc_id])


def test_toxicity_of_an_empty_table(spark, empty):
    model = toxicity.fit(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert toxicity.score_documents(empty, model).collect() == []
    assert toxicity.offending_sentences(empty, model).collect() == []


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").dropDuplicates(["doc_id"])
    rows = queries.op6_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits / sum(r.toxic for r in rows) >= 0.8
    assert hits / sum(r.predicted for r in rows) >= 0.95


# 7 WARC


def test_warc_round_trip(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "x\r\n\r\nWARC/1.1\r\ny", "é🙂", "<p>a</p>", "\n", ""]
    rows = [(i, None if i == 4 else f"http://www.Ex{i % 3}.org/a?b", h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).transform(clash)
    got = warc.archive_round_trip(pages).collect()
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    import base64

    expected = {}
    for h, ids in groups.items():
        for i in ids:
            first = i == max(ids)
            expected[i] = (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first else "revisit", None if first else max(ids))
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected and len(got) == len(rows)
    order = [(r.url_key, r.captured, r.archive, r.record_offset) for r in got]
    assert order == sorted(order)
    assert {r.record_type for r in warc.archive_round_trip(pages, 10**6).collect()} == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(6)
    for k in (*range(9), 33):
        runs = [sorted((rng.randrange(20), i) for i in range(rng.randrange(12))) for _ in range(k)]
        assert [*warc.loser_tree(runs)] == sorted(x for r in runs for x in r)


# 8 licences


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_license_base_places(docs, texts, empty):
    out = {r.doc_id: r for r in licenses.summary(licenses.scan(docs)).collect()}
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, t in enumerate(texts):
        ws = words_of(t)
        places = [(k, label) for p, label in phrases.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        r, at = out[i], sorted(k for k, _ in places)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(at), at[0] if at else None, at[-1] if at else None), t
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert {*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")} and 0 <= r.score <= 1
    assert licenses.scan(empty).count() == 0


def test_license_detections_yield_to_what_contains_them(spark):
    text = "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: GPL-2.0-only"
    r = licenses.scan(spark.createDataFrame([(1, text), (2, "he lit a fire, see permit licenses")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [d.label for d in r[0].detections] == ["apache-2.0", "gpl-2.0"]
    assert [text[d.start : d.stop] for d in r[0].detections] == ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: GPL-2.0-only"]
    assert r[1].detections == []


def test_gates_and_keywords_lose_no_match():
    assert len(license_rules.rules()) > 200
    for _, _, keyword, _, _, _ in license_rules.rules():
        assert keyword == keyword.lower()


def strings_of(pattern):
    """Strings that match: every alternative, options with and without, a line end and a hyphen for each gap."""

    def many(items):
        out = [""]
        for item in items:
            out = [a + b for a in out for b in one(*item)]
        return out

    def one(op, arg):
        match str(op):
            case "LITERAL":
                return [chr(arg)]
            case "NOT_LITERAL" | "CATEGORY":
                return ["\n" if "SPACE" in str(arg) and "NOT" not in str(arg) else "7" if "DIGIT" in str(arg) else "x"]
            case "IN":
                every = [c for o, a in arg for c in one(o, a)]
                return [c for c in every if c in "\n-"] if "\n" in every else every[:1]
            case "RANGE":
                return [chr(arg[0])]
            case "BRANCH":
                return [x for items in arg[1] for x in many(items)]
            case "SUBPATTERN":
                return many(arg[3])
            case "MAX_REPEAT":
                return [x for n in sorted({arg[0], max(arg[0], 1)}) for x in many([*arg[2]] * n)]
            case "ASSERT_NOT":
                return [""]
        raise AssertionError(op)

    return [s for s in many(re._parser.parse(pattern)) if re.match(pattern, s, re.ASCII)]


def test_keywords_and_gates_hold_for_every_alternative(spark):
    rng, rows = random.Random(8), []
    for _, label, keyword, pattern, priority, _ in license_rules.rules():
        strings = strings_of(pattern)
        assert strings, pattern
        for s in strings:
            assert any(all(w in s for w in alt.split()) for alt in keyword.split("/")), (label, keyword, s)
            assert any(g in s for g in license_rules.GATES), (label, s)
        strings = rng.sample(strings, min(3 if priority > 1 else 12, len(strings)))
        rows += [(len(rows) + i, s, re.match(pattern, s, re.ASCII).end()) for i, s in enumerate(strings)]
    seen = {r.doc_id: r.detections for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(8)).collect()}
    for i, s, end in rows:
        assert any(d.start == 0 and d.stop >= end for d in seen[i]), s


def test_license_texts_with_wrapped_lines_and_other_names(spark):
    says = {
        "Permission is\nhereby granted, free of charge, to any person obtaining": "mit",
        "all rights\nreserved": "all-rights-reserved",
        "GNU Lesser General\nPublic License": "lgpl",
        "Redistribution\nand use in source and binary forms": "bsd",
        "provided as-is": "warranty-disclaimer",
        "Expat License": "mit",
        "PSF License": "python",
        "Do What The F*** You Want To Public License": "wtfpl",
        "Community Data License Agreement": "cdla",
        "CDLA data agreement": "cdla",
        "MIT. License": "",
        "Redistributions of source code\n * must retain": "",
        "merge, publish, distribute,\n  sublicense, and/or sell": "mit",
    }
    out = licenses.scan(spark.createDataFrame([*enumerate(says)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[d.label for d in r.detections] for r in out] == [[x] if x else [] for x in says.values()]


# 9 embeddings


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((25, 32))
    x = np.concatenate([centres[rng.integers(25, size=300)] + rng.standard_normal((300, 32)) * rng.choice([0.05, 0.12, 0.2, 0.5], (300, 1)), np.tile(centres[0], (40, 1)), centres[:5] * 1e30])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] * 32), (n + 3, [None] * 32), (n + 4, []), (n + 5, [1.0, 0.0]), (n + 6, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).transform(clash)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(n, dtype=bool)
    links = [*zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True), (n + 5, n + 6)]
    roots = root_of(links, range(len(rows)))
    degree = Counter(a for a, _ in links) + Counter({n + 6: 1})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {i: (degree[i], roots[i], roots[i] == i) for i in range(len(rows))}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_crowded_cells_are_dealt_to_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(16) + rng.standard_normal((200, 16)) * 0.15
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embed_dedup, "CHUNK", 16)
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect())) == whole


def test_cuts_give_what_all_pairs_give(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64))
    x[500:] = x[rng.integers(500, size=1000)] + rng.standard_normal((1000, 64)) * rng.choice([0.05, 0.2, 0.23, 0.26], (1000, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    roots = root_of([*zip(*np.nonzero(near), strict=True)], range(len(x)))
    expected = {i: (near[i].sum(), roots[i]) for i in range(len(x))}
    for cuts, share in ((range(6), 200), (range(1, 6), 2048), ([4], 2048)):  # no blocks, in several chunks; cells
        monkeypatch.setattr(embed_dedup, "CUTS", cuts)
        monkeypatch.setattr(embed_dedup, "SHARE", share)
        assert {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()} == expected


def test_cells_are_left_where_they_hold_more_pairs_than_there_are(spark):
    def chosen(x, threshold, times):
        spread = [(cut, 64, b, int(c)) for cut in embed_dedup.CUTS for b, _, codes in embed_dedup._spread(embed_dedup._rotated(x), threshold, cut) for c in codes]
        cut, crowded = embed_dedup.least_work(spark.createDataFrame([(*k, n * times) for k, n in Counter(spread).items()], "cut int, dims int, block int, cell long, n long"))
        return cut, sum(crowded.get(k[1:], 1) for k in spread if k[0] == cut) / len(x)

    rng = np.random.default_rng(5)
    even, narrow = rng.standard_normal((1000, 64)), np.outer(rng.uniform(-3, 3, 1000), rng.standard_normal(64)) + rng.standard_normal(64)
    cut, rows = chosen(even, 0.95, 50)
    assert cut == 0 and rows <= embed_dedup.SHARES
    assert chosen(narrow, 0.999999, 5000)[0] > 0


def test_pairs_compared_in_single_precision():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1400, 20)) * 0.1
    d = ((x[:, None, :16] - x[None, :, :16]) ** 2).sum(axis=2)
    whole = np.arange(1400)
    for left, right in ((whole, whole), (whole[:900], whole[900:]), (whole[:3], whole[3:])):
        got = Counter()
        for a, b in embed_dedup._near(x, left, right, x[:, 0], 0.1):
            got.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
        want = {(i, j) for i in left.tolist() for j in right.tolist() if i < j and d[i, j] <= 0.1}
        assert max(got.values()) == 1 and want <= {*got} and max(d[k] for k in got) <= 0.1 + 1e-4


# 10 SimHash


def slow_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(texts):
    assert simhash.fingerprint_texts(texts).tolist() == [*map(slow_fingerprint, texts)]


def test_simhash_components(docs, texts, empty):
    fps = [*map(slow_fingerprint, texts)]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    roots = root_of(links, range(len(fps)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", roots[i]) for i, f in enumerate(fps)}
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == {*roots.values()}
    assert simhash.near_duplicates(empty).count() == 0


def test_balls_meet_at_every_distance(spark, monkeypatch):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:60]:
        for d in (1, 2, 3, 4, 4, 4, 5, 6):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), d)))
    fps = [*dict.fromkeys(fps)]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    number = {int(np.uint64(f).view(np.int64)): i for i, f in enumerate(fps)}
    import pandas as pd

    for at_once in (simhash.AT_ONCE, 3000):
        monkeypatch.setattr(simhash, "AT_ONCE", at_once)
        k, found = 4, []
        for prefix in range(16):
            rows = [(int(np.uint64(f).view(np.int64)), prefix) for f in fps if (f >> 60 ^ prefix).bit_count() <= 2]
            if rows:
                edges = simhash._in_prefix(pd.DataFrame(rows, columns=["fp", "prefix"]), k)
                found += [(number[a], number[b]) for a, b in zip(edges.a.tolist(), edges.b.tolist(), strict=True)]
        assert root_of(found, range(len(fps))) == root_of(links, range(len(fps)))


def test_queries_equal_their_sql(spark):
    con = oracle.connect()
    for name, sql in queries.ORACLE_SQL.items():
        oracle.assert_same(queries.QUERIES[name](spark, oracle.SF_DIR), con, sql)
