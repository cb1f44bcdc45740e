"""Operators against plain versions of what they compute."""

from __future__ import annotations

import base64
import collections
import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hashing, lm, ngram_join, packing, passages, quality, queries, suffix, toxicity

from ..oracle import assert_same, by_sql
from tidemark.llm import oracle_sql


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf, name):
    assert_same(queries()[name](spark, sf).toPandas(), by_sql(oracle_sql()[name], sf))


def test_suffix_blocks():
    rng = random.Random(2)
    for _ in range(150):
        alphabet = rng.choice([b"ab", b"abc", b"\0a", b"abcdefgh"])
        base = bytes(rng.choice(alphabet) for _ in range(60))
        segments = []
        for _ in range(rng.randint(1, 12)):
            x = bytearray(base[rng.randint(0, 20) : rng.randint(25, 60)])
            x[rng.randrange(len(x))] = rng.choice(alphabet)
            segments.append(bytes(x))
        many, least = [rng.random() < 0.2 for _ in segments], rng.choice([1, 2, 3, 5, 8, 13, 20])
        count = collections.Counter()
        for s, m in zip(segments, many):
            for i in range(len(s) - least + 1):
                count[s[i : i + least]] += 1 + m
        for s, flags in zip(segments, suffix.repeated(segments, many, least)):
            assert flags.tolist() == [count[s[i : i + least]] > 1 for i in range(len(s) - least + 1)]


@pytest.mark.parametrize("hot", [4000, 2])
def test_suffix_dedup(spark, sf, texts, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    count = collections.Counter(t[i : i + 400] for t in texts.values() for i in range(len(t) - 399))
    for r in suffix.op3_suffix_dedup(spark, sf).collect():
        t = texts[r.doc_id]
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("least", [200, 37])
def test_passages_of_any_length(spark, sf, texts, least):
    docs = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["text"])
    own = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    count = collections.Counter(t[i : i + least] for t in own.values() for i in range(len(t) - least + 1))
    got = {r.doc_id: r.text for r in suffix.deduplicated(docs, least).collect()}
    for i, t in own.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - least + 1):
            if count[t[k : k + least]] > 1:
                gone[k : k + least] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")
        assert got.get(i, "") == (kept if kept.split() else "")


def shingle_set(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def check_classes(got, texts):
    by_text = collections.defaultdict(list)
    for i, t in texts.items():
        by_text[t].append(i)
    sets = [(shingle_set(t), ids) for t, ids in by_text.items()]
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (s, _) in enumerate(sets):
        for y in range(x):
            if s and sets[y][0] and 5 * len(s & sets[y][0]) >= 4 * len(s | sets[y][0]):
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    least = collections.defaultdict(lambda: 1 << 60)
    for x, (_, ids) in enumerate(sets):
        least[find(x)] = min(least[find(x)], *ids)
    expected = {i: (least[find(x)], links[x], len(ids)) for x, (_, ids) in enumerate(sets) for i in ids}
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in got} == expected


def test_ngram_join(spark, sf, texts):
    check_classes(ngram_join.op4_ngram_join(spark, sf).collect(), texts)


@pytest.mark.parametrize("tile", [1024, 8])
def test_large_group(spark, monkeypatch, tile):
    """Many near copies, in one block and dealt to tiles."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    rows = {}
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(90)] = f"x{rng.randrange(9999)}"
        rows[k] = " ".join(words).encode()
    docs = spark.createDataFrame([(k, t.decode()) for k, t in rows.items()], "doc_id long, text string").repartition(7)
    check_classes(ngram_join.classes(docs).collect(), rows)


def test_pruning_bounds():
    assert all(0 < ngram_join.LEAST[n] < 0.8 * n for n in ngram_join.LEAST)
    # the posterior just below the bound is under the tolerance
    for n, m in ngram_join.LEAST.items():
        tail = sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m))
        assert tail < ngram_join.TOLERANCE


def test_packing_ids_are_the_tokenizers(spark, sf, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    rows = collections.defaultdict(list)
    for r in packing.op5_harmonic_packing(spark, sf).collect():
        rows[r.doc_id].append(r)
    used = collections.Counter()
    for i, t in texts.items():
        ids = np.array([*whole.encode(t.decode(), add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(rows[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
            used[r.sequence_id] += r.length
        assert at == len(ids)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    assert padding < 0.04 * sum(used.values())


def test_odd_words_have_the_tokenizers_ids():
    tokens = packing.Tokens(packing.default_tokenizer())
    for t in ["Hello<|endoftext|> it's DON'T  x́ café! 12ab,, \x1c!! İstanbul ΣΣ a_b __ あい Å <|x|> foo<|startoftext|>bar ﬁ ßß, '", "", " "]:
        expected = np.array(tokens.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert tokens.ids(t.encode()) == expected


def test_cuts():
    for n in range(1, 9000):
        parts = packing.cuts(n)
        assert sum(parts) == n and all(1 <= p <= 2048 for p in parts)


def lm_by_hand(texts, train):
    """Functions (base, score, known) of a text's tokens, and N, from plain counts of the training texts."""
    grams = [collections.Counter() for _ in range(3)]
    for i in train:
        s = [None, None, *texts[i], None]
        for k, g in enumerate(grams):
            g.update(tuple(s[j - k : j + 1]) for j in range(2, len(s)))
    one, two, three = grams
    one[None,] = two[None, None] = len(train)
    n, v = sum(one.values()), len([c for c in one.values() if c])

    def score(text):
        s, total = [None, None, *text, None], 0.0
        for u, v_, w in zip(s, s[1:], s[2:]):
            above = three[u, v_, w] + lm.KAPPA * (two[v_, w] + lm.MU * (one[w,] + 1) / (n + len([c for c in one.values() if c]) + (1 if train else 2)))
            total += math.log10(above / (two[u, v_] + lm.KAPPA * (one[v_,] + lm.MU)))
        return total

    return lambda t: sum(math.log10((one[w,] + 1) / (n + v + 1)) for w in [*t, None]), score, lambda t: sum(one[w,] > 0 for w in [*t, None]), n


def check_lm(rows, texts, train, most=0.05):
    base, score, known, n = lm_by_hand(texts, train)
    score = functools.cache(score)
    assert len(rows) == len(texts)
    for r in rows:
        t = tuple(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t) + 1, known(t), n)
        assert math.isclose(r.base_score, base(t), rel_tol=1e-9, abs_tol=1e-6) and abs(r.score - score(t)) < most * (len(t) + 1)  # probabilities are quantised


@pytest.mark.parametrize("rows_at_once", [1_000_000, 500])
def test_lm_scores(spark, sf, texts, rows_at_once, monkeypatch):
    monkeypatch.setattr(lm, "RANGE", rows_at_once)
    words = {i: t.lower().split() for i, t in texts.items()}
    rows = lm.op9_lm_scoring(spark, sf).collect()
    check_lm(rows, words, [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r for r in lm.op9_lm_scoring(spark, sf).collect()}
    assert all(again[r.doc_id] == r for r in rows)


def test_lm_probabilities_sum_to_one():
    made = lm.Words(3, 10, 4, 8, np.zeros(0, np.uint64), np.zeros(0, np.int64))  # three words and the end, 3 texts, 10 tokens
    c1, c2, c3 = np.array([3, 3, 3, 1, 0]), np.array([1, 2, 0, 0, 0]), np.array([1, 0, 0, 0, 0])  # the last is the word unseen
    total = (10 ** made.level3(c3, c2, c1)).sum() * 10 ** made.weight(c3.sum(), c2.sum())
    assert math.isclose(total, 1, rel_tol=1e-12)


def test_lm_knows_every_word(spark):
    """More training words than any list of frequent ones: n-grams of the rarest count too."""
    size = 70_000
    words = [f"w{k}" for k in range(size)]
    texts = {1: words, 2: words, 7: [words[-2], words[-1]], 8: [words[-1], words[-2]]}
    got = lm.score(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string"), lambda i: i < 7).collect()
    check_lm(got, texts, [1, 2], 0.01)


@pytest.mark.parametrize("share", [0.5, 0.9])
def test_lm_deals_no_triple_too_frequent_for_a_shard(spark, monkeypatch, share):
    rng = random.Random(5)
    rows = [(k, " ".join("hot phrase here" if rng.random() < share else f"w{rng.randrange(3000)}" for _ in range(60))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = docs.selectExpr("doc_id", "doc_id % 7 = 2 as held_out", "text")
    made, _ = lm._learned(asked)
    monkeypatch.setattr(lm, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Id", (), {"partitionId": lambda self: 0})())}))
    dealt = collections.Counter()
    for out in lm._packer(type("Sent", (), {"value": made}))(iter(asked.toArrow().to_batches())):
        for r in out.to_pylist():
            if r["kind"] == lm.TRIGRAMS:
                words, edge, other, before, second, times, *_ = lm._triples(r["data"])
                for w, b, u, t in zip(np.repeat(words, np.diff(edge)).tolist(), other[before].tolist(), other[second].tolist(), times.tolist()):
                    dealt[w, b, u] += t
    monkeypatch.undo()  # functions sent to workers take their globals with them
    tokens = sum(len(t.split()) + 1 for _, t in rows)
    assert max(dealt.values()) <= tokens / made.shards / 4 < sum(t.count("hot phrase here") for _, t in rows)
    assert len(made.often[3][0])
    texts = {k: t.split() for k, t in rows}
    check_lm(lm.score(docs, lambda i: i % 7 != 2).collect(), texts, [k for k in texts if k % 7 != 2])


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (5, 5), (100, 1000), (3000, 1 << 40), (1000, 1001)):
        values = np.sort(rng.choice(universe, n, replace=False)) if universe < 1 << 20 else np.unique(rng.integers(0, universe, n))
        e = lm.EliasFano(*lm.EliasFano.pack(values, universe))
        assert (e.at(np.arange(len(values))) == values).all()
        asked = np.concatenate((values, rng.integers(0, universe, 200)))
        place = {int(x): k for k, x in enumerate(values)}
        assert e.find(asked).tolist() == [place.get(int(x), -1) for x in asked]


def test_warc_rows(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    last = {}
    for i, p in pages.items():
        last[p] = max(i, last.get(p, i))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries()["op1_warc_transactions"](spark, sf).collect()}
    sha = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    assert got == {i: (len(p), sha(p), "response" if last[p] == i else "revisit", None if last[p] == i else last[p]) for i, p in pages.items()}


def test_media_rows(spark, sf, texts):
    for r in queries()["op8_media_columns"](spark, sf).collect():
        payload = texts[r.doc_id] + bytes(max(64, -(-len(texts[r.doc_id]) // 64) * 64) - len(texts[r.doc_id]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95


def test_toxicity_scores_are_those_of_plain_compression(spark, sf, texts):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels, "toxic", lambda i: F.lit(True))
    packs = [toxicity.Distance._compressor(x) for x in (model.distance.ordinary, model.distance.toxic)]
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t in list(texts.items())[:60]:
        windows = [b" " + w + b" " + toxicity.FRAME for w in t.lower().split()]
        gaps = [len(packs[0].compress(w)) - len(packs[1].compress(w)) for w in windows]
        above = [sum(g >= k for g in gaps) for k in range(1, toxicity.GAPS)] + [sum(g >= toxicity.GAPS for g in gaps)]
        x = np.array([100 * a / (len(gaps) + 50) for a in above] + [math.log1p(a) for a in above])
        z = (x - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1]
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_quality_statistics_and_votes_by_hand(spark, sf, texts):
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "quality", lambda i: F.lit(True))
    got = {r.doc_id: r._score for r in quality.score(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), model).collect()}
    for i, t in list(texts.items())[:60]:
        x, total = quality.features([t])[0], model.prior
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + bool(x[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert math.isclose(got[i], 1 / (1 + math.exp(-total)), rel_tol=1e-6)


def test_samples_are_bounded_by_ids(spark):
    rows = [(k % 5, f"text {k}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, 2, 2), (3, None, None)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in toxicity.sampled(docs, labels, "toxic", lambda i: F.lit(True)).collect()) == [(0, "text 1"), (1, "text 0")]
    quality.train(docs, labels, "quality", lambda i: F.lit(True))


@pytest.mark.parametrize(("name", "label", "modulus", "rest"), [("op2_quality_classifier", "quality", 3, 1), ("op6_toxicity", "toxic", 5, 0)])
def test_held_out_accuracy(spark, name, label, modulus, rest):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries()[name](spark, sf).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def covered_words(texts, least):
    """Of each text the words in windows of ``least`` words that another row has too."""
    words, owner = {i: t.split() for i, t in texts.items()}, {}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            at = tuple(w[k : k + least])
            owner[at] = i if owner.get(at, i) == i else None
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - least + 1):
            if owner[tuple(w[k : k + least])] is None:
                gone[k : k + least] = True
        out[i] = int(gone.sum())
    return out


def test_passages_of_fifty_words(spark, tmp_path):
    """A passage of 51 short words in two documents has under 400 bytes, so nothing is removed; it shows in n_passage_words."""
    rng = random.Random(5)
    own = lambda n: " ".join(rng.choice("bcdfg") + str(rng.randrange(10**4)) for _ in range(n))
    passage, short, page = own(51), own(49), own(90)
    rows = [(1, f"{own(40)} {passage} {own(30)}"), (2, f"{own(7)}\n{passage}"), (3, own(200)), (4, f"{own(60)} {short} {own(9)}"), (5, f"{short} {own(80)}")]
    rows += [(6, f"{passage[:250]} {own(70)}"), (7, page), (8, page), (9, " ".join([own(25)] * 6)), (10, None), (11, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in suffix.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {i: r.n_passage_words for i, r in got.items()} == {1: 51, 2: 51, 3: 0, 4: 0, 5: 0, 6: 0, 7: 90, 8: 90, 9: 0, 10: 0, 11: 0}
    assert got[1].n_removed == got[2].n_removed == 0


@pytest.mark.parametrize("least,hot", [(50, 4000), (50, 2), (8, 4000), (1, 2)])
def test_words_of_passages(spark, sf, texts, least, hot, monkeypatch):
    for name, value in (("HOT", hot), ("PACKET", 500), ("BLOCK", 2000)):
        monkeypatch.setattr(passages, name, value)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").repartition(3)
    bodies = docs.mapInArrow(ngram_join._first_texts, "key binary, body binary")
    got = {bytes(r.key): r.n_words for r in passages.shared_words(docs, bodies, least).collect()}
    assert {i: got.get(hashlib.md5(t).digest(), 0) for i, t in texts.items()} == covered_words(texts, least)


def test_long_texts_are_cut_at_spaces(monkeypatch):
    whole = [b"a bc " * 40, b"", b"x" * 300 + b" y\tz", b" " * 50]
    want = passages.word_hashes(whole)
    monkeypatch.setattr(passages, "PIECE", 16)
    got = passages.word_hashes(whole)
    assert all((a == b).all() for a, b in zip(want, got)) and got[1].tolist() == [80, 0, 3, 0]
