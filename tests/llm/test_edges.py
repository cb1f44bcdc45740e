"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exact, importance, lm, media, mixing, ngram_join, packing, phrases, quality, rules, suffix, toxicity, warc
from tidemark.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, node string, `_score` int, target string, taken long, source_size int, root string, `_quality` string"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
PROSE = " ".join(f"alpha{k}" for k in range(120))
ROWS = [(1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "en", "b"), (None, PROSE + " tail", "en", None), (6, "Ünï çödé", "fr", "c"), (7, LONG, "en", "c"), (8, "one", "en", "c")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", 0.5, "n", 7, "t", 1, 2, "r", "q") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def both(spark):
    return {"full": docs(spark), "empty": docs(spark, [])}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_rules(both, kind):
    rows = rules.apply_policy(rules.ledger(rules.measure(both[kind]))).collect()
    assert len(rows) == both[kind].count()
    if kind == "full":
        assert {r.n_words for r in rows if r.doc_id in (3, 4, 5)} == {0} and not any(r.kept for r in rows if r.doc_id in (3, 4, 5, 8))
    rules.ablation(rules.apply_policy(rules.ledger(rules.measure(both[kind])))).collect()


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_mixing(both, kind):
    sized = mixing.keyed(both[kind].select("doc_id", "text", "source"))
    rows = mixing.mix(sized, mixing.budgets(sized)).collect()
    assert len(rows) == both[kind].count() and all(0 <= r.taken <= 2 * r._mix_size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert mixing.mixed_documents(both[kind]).columns == both[kind].columns
    total = mixing.mixed_documents(both[kind]).select(F.sum(mixing.size_of(F.col("text"))).alias("n")).first().n or 0
    assert total == sum(r.taken for r in rows)


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_packing(both, kind):
    rows = packing.pack(both[kind], packing.default_tokenizer(), with_ids=True).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert sorted(r.doc_tokens for r in rows if r.doc_id in (3, 4, 5)) == ([1, 1, 1] if kind == "full" else [])
    assert all(len(r.ids) == 4 * r.length for r in rows)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_media(both, kind):
    rows = media.indexed(media.media_column(both[kind])).collect()
    assert len(rows) == both[kind].count()
    for r in rows:
        track = media.probe(bytes(r.media))[0]
        text = next((x[1] for x in ROWS if x[0] == r.doc_id), "") or ""
        assert media.payload(bytes(r.media), track) == media.padded(text.encode()) and [tuple(k) for k in r.keyframes] == [tuple(x) for x in track.keyframe_ranges().tolist()]


def test_media_refuses_damage():
    whole = media.encode(media.padded(b"x" * 500))
    for broken in (whole[:-40], whole[:20], whole.replace(b"stsc", b"free")):
        with pytest.raises(ValueError):
            media.probe(broken) or pytest.fail("no track")
            media.payload(broken, media.probe(broken)[0])
            raise ValueError


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_lm(both, kind):
    rows = lm.score(both[kind], lambda i: F.coalesce(i, F.lit(0)) != 7).collect()
    assert len(rows) == both[kind].count()
    assert sorted(r.n_tokens for r in rows if r.doc_id in (3, 4, 5)) == ([1, 1, 1] if kind == "full" else [])


def test_lm_without_training(both):
    rows = lm.score(both["full"], lambda i: F.lit(False)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in rows)


@pytest.mark.parametrize("kind", ["full", "empty"])
@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers(both, labels, kind, module):
    label = "quality" if module is quality else "toxic"
    model = module.train(both["full"].select("doc_id", "text"), labels, label, lambda i: F.lit(True))
    rows = module.score(both[kind].select("doc_id", "text"), model).collect()
    assert len(rows) == both[kind].count() and all(0 <= r[-1] <= 1 for r in rows)
    none = module.train(both[kind].select("doc_id", "text"), labels.limit(0), label, lambda i: F.lit(True))
    assert all(r[-1] == 0.5 for r in module.score(both[kind].select("doc_id", "text"), none).collect())


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_near_duplicates(both, kind):
    rows = ngram_join.classes(both[kind]).collect()
    assert len(rows) == both[kind].count()
    kept = ngram_join.one_of_each(both[kind])
    assert kept.columns == both[kind].columns
    if kind == "full":
        assert sorted((r.doc_id for r in kept.collect())) == [1, 3, 5, 6, 7, 8]
        assert {r.n_links for r in rows if r.doc_id in (1, 2)} == {1} and {r.n_copies for r in rows if r.doc_id == 1} == {3}


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_suffix(both, kind):
    out = suffix.deduplicated(both[kind])
    assert out.columns == both[kind].columns
    rows = {r.doc_id: r.text for r in out.collect()}
    # 7 repeats itself all through, so nothing of it is left
    assert rows == ({None: " tail", 6: "Ünï çödé", 8: "one"} if kind == "full" else {})


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_pipeline_stages(spark, sf, both, labels, kind, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, both[kind], str(tmp_path))
        out.collect()
        assert name == "packing" or out.columns == both[kind].columns


def test_warc(spark):
    rows = [(1, "http://a/x", "same"), (2, "http://b/y", "same"), (2, "http://b/y", "same"), (3, "http://c", "same"), (3, "http://c", "other"), (4, None, None), (5, "http://d", ""), (None, "http://e", "same"), (7, "u\r\nX: y", "WARC/1.1\r\n\r\n" + "z" * 100_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, ref string, file string")
    folder = scratch(spark, "warc")
    found = warc.transactions(warc.read_records(spark, folder, warc.write_archives(pages, folder))).collect()
    got = sorted((r.metadata.page_id or 0, r.response.type, r.response.payload_bytes, r.response.refers_to or "") for r in found)
    assert got == sorted([(1, "revisit", 4, "3"), (2, "revisit", 4, "3"), (2, "revisit", 4, "3"), (3, "response", 4, ""), (3, "response", 5, ""), (4, "revisit", 0, "5"), (5, "response", 0, ""), (0, "response", 4, ""), (7, "response", 100_012, "")])
    assert all(r.request.record_id and r.response.payload_digest for r in found)
    kept = {r.metadata.page_id: bytes(r.response.payload) for r in found if r.response.type == "response"}
    assert kept[7].startswith(b"WARC/1.1")
    folder = scratch(spark, "warc")
    files = warc.write_archives(pages.limit(0), folder)
    assert files == [] and warc.transactions(warc.read_records(spark, folder, files)).count() == 0
    folder = scratch(spark, "warc")
    every = warc.transactions(warc.read_records(spark, folder, warc.write_archives(pages, folder, least=5))).collect()
    assert sum(r.response.type == "revisit" for r in every) == 0


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_exact(both, kind):
    rows = exact.decided(exact.digested(both[kind])).collect()
    assert len(rows) == both[kind].count()
    out = exact.deduplicated(both[kind])
    assert out.columns == both[kind].columns
    if kind == "full":
        # three texts without a word are one group, three of PROSE another; the longest of the former is that of spaces
        assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in rows if r.doc_id in (1, 2, 3, 4, 5)) == [(1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False), (3, 5, 3, False), (4, 5, 3, False), (5, 5, 3, True)]
        assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted((r[0] or 0, r[1]) for r in ROWS if r[0] not in (2, 3, 4))


def test_exact_hot_group(spark):
    """A digest with a third of the rows, null ids among its copies and repeated rows; one row of it stays, and it isn't shuffled."""
    rows = spark.range(30_000).selectExpr("if(id % 5 = 0, null, id div 2) as doc_id", "if(id % 3 = 0, concat('hot ', if(id = 27, ' ', ''), 'text'), concat('text ', id)) as text")
    got = exact.decided(exact.digested(rows)).filter("group_size = 10000")
    assert got.count() == 10_000 and {r.keep_id for r in got.select("keep_id").distinct().collect()} == {13} and got.filter("kept").count() == 1
    assert exact.frequent_items(exact.digested(rows).select("item")).count() <= exact.FREQUENT
    assert exact.deduplicated(rows).count() == 20_001


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_importance(both, kind):
    goal = both["full"].filter("doc_id = 6")
    rows = importance.drawn(importance.weights(both[kind], goal), share=50).collect()
    assert len(rows) == both[kind].count()
    if kind == "full":
        assert {(r.n_words, r.n_features, r.weight) for r in rows if r.doc_id in (3, 4, 5)} == {(0, 0, 0)}
        long = [r for r in rows if r.n_words >= importance.LEAST_WORDS]
        assert sorted(r.rank for r in long if r.rank) == [1, 2] and len(long) == 5 and {r.rank for r in rows if r.n_words < 20} == {None}
        weight = {r.doc_id: r.weight for r in rows}
        assert weight[6] > weight[1] > 0 > weight[7]
    alone = importance.weights(both[kind], goal.limit(0)).collect()
    assert len(alone) == len(rows)


def test_importance_reads_long_texts_in_slices(monkeypatch):
    text = ("Straße 12-b " * 40 + "x" * 300 + " ende").encode()
    whole = sorted(sum((found.tolist() for _, found in importance.buckets(text)), []))
    monkeypatch.setattr(importance, "SLICE", 7)
    parts = list(importance.buckets(text))
    assert len(parts) > 20 and sum(n for n, _ in parts) == 122 and sorted(sum((found.tolist() for _, found in parts), [])) == whole


def test_importance_hot_source_of_copies(spark):
    """A text that is a third of all rows, in many packets and groups, against the rule for each document."""
    import collections
    import zlib

    rows = [(k, "a b c d e" if k % 3 else f"a {k % 7} x{k % 11}") for k in range(3000)]
    goal = ["b c", "x3 x3 q"]
    feature = lambda t: [zlib.crc32(x.encode()) % 10_000 for x in t.split()] + [zlib.crc32(" ".join(p).encode()) % 10_000 for p in zip(t.split(), t.split()[1:])]
    s, t = (collections.Counter(b for x in texts for b in feature(x)) for texts in ([x for _, x in rows], goal))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    found = {r.doc_id: r.weight for r in importance.weights(docs, spark.createDataFrame([(x,) for x in goal], "text string")).collect()}
    for k, text in rows[:40]:
        own = feature(text)
        assert found[k] == sum(importance.gain(s[b], t[b], s.total(), t.total()) for b in own) // len(own)


def plain_counts(rows):
    """(lang, phrase) -> occurrences, by the rule."""
    import collections
    import re

    out = collections.Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                out.update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return out


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_phrases(both, kind):
    counts = phrases.counted(both[kind])
    found = {(r.lang, r.phrase): r.n for r in counts.collect() if r.words}
    every = plain_counts([(r.lang, r.text) for r in both[kind].select("lang", "text").collect()])
    assert found == {k: n for k, n in every.items() if n >= phrases.LEAST} and (kind == "empty" or found)
    rows = phrases.collocations(counts, 7).collect()
    assert sorted(r["rank"] for r in rows) == (list(range(1, 8)) if kind == "full" else [])


def test_phrases_in_segments(spark, monkeypatch):
    """Long texts cut anywhere, gaps longer than a segment, one word longer than a segment, ends of pieces at a cut, hot phrases, no language."""
    import random

    rng = random.Random(5)
    long = "".join(rng.choice(["a", "b", "C", "é", "\u00a0"]) + rng.choice([" ", "  ", "\t", ". ", "\n", "   ;  "]) for _ in range(3000))
    rows = [("en", long), (None, long), ("und", long[:500]), ("en", "a b" + " " * 500 + "a b" + "\n" * 300 + "b"), ("en", "x" * 999 + " a b"), ("en", " " * 700), ("en", None), ("de", "")]
    wanted = {k: n for k, n in plain_counts(rows).items() if n >= 10}
    for size in (1 << 22, 64):
        monkeypatch.setattr(phrases, "PACKET", size)
        own = [phrases.segments(lang, [(t or "").encode() for g, t in rows if (g or "und") == lang]) for lang in ("en", "und", "de")]
        import collections
        import numpy as np

        bits, got = np.full(phrases.DEPTH * phrases.WIDTH // 8, 255, np.uint8), collections.Counter()
        for s in (x for part in own for x in part):
            for _, names, counts in phrases.survivors(s, bits):
                for name, n in zip(names, counts.tolist()):
                    got[s.lang, name.decode()] += n
        assert {k: n for k, n in got.items() if n >= 10} == wanted


def test_sketch_never_underestimates(monkeypatch):
    """With few cells many runs share one, and nothing frequent is lost; with the usual number, hardly anything else is let through."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    rows = [("en", " ".join(f"w{(k * 7 + j * j) % 97}" for j in range(40))) for k in range(50)]
    every = plain_counts(rows)
    frequent = {p for (_, p), n in every.items() if n >= 10}
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array([t for _, t in rows[k : k + 5]])], ["lang", "text"]) for k in range(0, 50, 5)]
    for width in (1 << 11, 1 << 22):
        for name, value in (("WIDTH", width), ("BLOCK", width // 4), ("_BITS", width.bit_length() - 1), ("PACKET", 900)):
            monkeypatch.setattr(phrases, name, value)
        parts = sorted((r for b in phrases._sketch(3)(iter(batches)) for r in b.to_pylist()), key=lambda r: (r["block"], r["salt"]))
        parts = [r for b in phrases._merged(False)(iter([pa.RecordBatch.from_pylist(parts)])) for r in b.to_pylist()]
        assert len(parts) == 24
        bits = np.zeros(phrases.DEPTH * width // 8, np.uint8)
        for b in phrases._merged(True)(iter([pa.RecordBatch.from_pylist(parts)])):
            for r in b.to_pylist():
                bits[r["block"] * width // 32 : (r["block"] + 1) * width // 32] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["data"]), np.uint8)
        let = {p.decode() for s in phrases.segments("en", [t.encode() for _, t in rows]) for _, names, _ in phrases.survivors(s, bits) for p in names}
        assert let >= frequent
    assert let == frequent
