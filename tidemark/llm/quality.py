"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (never labels, language, source or id) are computed in one pass. The model is
fitted on the driver from at most ``SAMPLE`` labelled rows, the ones with the smallest hash of their id:
a documented, bounded sample of numbers, not texts. Trees are complete and of one depth, flattened into
three arrays (feature, threshold, leaf), so scoring is ``DEPTH`` vectorised steps a tree over a whole batch.

Null or empty text has all-zero statistics and gets a score like any other. Null labels are ignored; of
repeated labels of an id the largest counts. Without both classes in the sample every score is the prior
(0.5 if there are no labels). An empty table gives an empty result; repeated rows each get a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, split_of, table, texts_of
from .rules import measure_texts

#: The most labelled rows the model is fitted on.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT = 80, 4, 64, 0.15, 5.0
FEATURES = (
    "log_words", "word_length", "symbols", "exclamations", "upper", "duplicate_lines", "repeated_words", "types",
    "log_lines", "words_per_line", "bars", "digits", "stops", "commas", "non_ascii", "top_word",
)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of ``FEATURES`` per text."""
    m = {k: np.array(v, float) for k, v in measure_texts(texts).items()}
    words, chars, lines = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1), np.maximum(m["n_lines"], 1)
    extra = np.zeros((len(texts), 6))
    for k, t in enumerate(texts):
        ascii_size = len(t) - len(t.translate(None, bytes(range(128))))
        size = max(1, len(t))
        spare = t.split()
        top = max(Counter(spare).values()) / len(spare) if spare else 0.0
        extra[k] = t.count(b"|"), size - len(t.translate(None, b"0123456789")) if t else 0, t.count(b"."), t.count(b","), ascii_size / size, top
    return np.column_stack(
        (
            np.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / words, m["n_exclamations"] / words, m["n_upper"] / chars,
            m["n_dup_lines"] / lines, m["n_repeat_words"] / words, m["n_types"] / words, np.log1p(m["n_lines"]), m["n_words"] / lines,
            extra[:, 0] / words, extra[:, 1] / chars, extra[:, 2] / words, extra[:, 3] / words, extra[:, 4], extra[:, 5],
        )
    )


@dataclass
class Trees:
    """Complete trees, node k's children at 2k+1 and 2k+2; going right means value > threshold."""

    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Newton boosting of the logistic loss; splits come from gradient histograms over quantile bins."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    if len(y) == 0 or y.min() == y.max():
        prior = 0.0 if len(y) == 0 else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), prior)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])  # bin b: value <= cuts[b]
    n, width = x.shape
    prior = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, prior)
    flat = binned + np.arange(width) * BINS
    out = [np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))]
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            key = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            hist_g = np.bincount(key, np.repeat(g, width), count * width * BINS).reshape(count, width, BINS)
            hist_h = np.bincount(key, np.repeat(h, width), count * width * BINS).reshape(count, width, BINS)
            left_g, left_h = hist_g.cumsum(2), hist_h.cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - all_g**2 / (all_h + 1)
            gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
            best = gain.reshape(count, -1).argmax(1)
            feature, cut = best // BINS, best % BINS
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            at = slice(first, first + count)
            out[0][t, at] = feature
            out[1][t, at] = [cuts[f][b] if ok and b < len(cuts[f]) else np.inf for f, b, ok in zip(feature, cut, good)]
            own = node - first
            node = 2 * node + 1 + (x[np.arange(n), feature[own]] > out[1][t, at][own])
        own = node - inner
        out[2][t] = RATE * np.bincount(own, g, leaves) / (np.bincount(own, h, leaves) + 1)
        margin += out[2][t][own]
    return Trees(*out, prior)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = features(texts_of(batch, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], ["label", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, label: str, learn) -> Trees:
    """Fit on the sample of ``labels`` for which the condition ``learn(doc_id)`` holds."""
    prepare(docs.sparkSession)
    known = labels.filter(learn(F.col("doc_id")) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("_of")).agg(F.max(label).cast("double").alias("_label"))
    known = known.orderBy(F.xxhash64("_of"), "_of").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_of"))  # at most SAMPLE rows are sent
    rows = rows.groupBy("_of", "_label").agg(F.min("text").alias("text"))  # repeated ids don't enlarge the sample
    rows = rows.select(F.col("_label").alias("label"), "text").mapInArrow(_features, "label double, " + ", ".join(f"{f} double" for f in FEATURES))
    data = rows.toPandas().sort_values(["label", *FEATURES], ignore_index=True)  # the fit must not depend on task order
    return fit(data[list(FEATURES)].to_numpy(float), data["label"].to_numpy(float))


def score(docs: DataFrame, model: Trees, name: str = "_score") -> DataFrame:
    """``docs`` (which must not have a column ``name``) with a score: probability that the label is 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(features(texts_of(batch, 0))))], [*batch.schema.names, name])

    kept = [c for c in docs.columns if c != "text"]
    typed = docs.select("text", *kept)
    return typed.mapInArrow(scorer, typed.withColumn(name, F.lit(0.0)).schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), "quality", lambda i: split_of(i, 3) != 1)
    found = score(docs, model)
    return found.select("doc_id", (split_of(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
