"""Each stage of the pipeline on what the one before it gave, against plain versions."""

from __future__ import annotations

import collections
import itertools

import numpy as np

import corpus_pipeline
from tidemark.llm.common import written


def shingles(text):
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        tables.append(docs)
    start, good, single, cleaned, mixed, packed = (t.collect() for t in tables)
    # quality: rows stay as they are, and labelled ones follow their labels
    whole = {r.doc_id: r for r in start}
    assert all(whole[r.doc_id] == r for r in good)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items() if i in whole]) > 0.7
    # near duplicates: none is left, and none went without one that stays, through others of its class
    sets = {r.doc_id: shingles(r.text or "") for r in good}
    near = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    stay = {r.doc_id for r in single}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if near(a, b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert stay == {find(i) for i in sets}
    # passages: bytes covered by strings that start elsewhere go
    least = corpus_pipeline.PASSAGE
    texts = {r.doc_id: (r.text or "").encode() for r in single}
    count = collections.Counter(t[i : i + least] for t in texts.values() for i in range(len(t) - least + 1))
    left = {r.doc_id: r.text for r in cleaned}
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - least + 1):
            if count[t[k : k + least]] > 1:
                gone[k : k + least] = True
        rest = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")
        assert left.get(i, "") == (rest if rest.split() else "")
    # mixing: no document more than twice, words in all near 150 % of all sizes
    size = {i: len(t.split()) for i, t in left.items()}
    words = collections.Counter()
    for r in mixed:
        words[r.doc_id] += len(r.text.split())
    assert all(words[i] <= 2 * n for i, n in size.items()) and abs(sum(words.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())
    # packing: pieces of the mixed rows, gapless in sequences
    used = collections.defaultdict(list)
    for r in packed:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(r.doc_id for r in packed) == set(words)
