"""N-gram Jaccard join with Bayesian candidate pruning.

1. Texts that are equal byte for byte are one text with copies. Every text has a set of hashed 5-word shingles (a text
   of 1 to 4 words has one shingle, all its words) and ``BANDS * ROWS`` MinHash values.
2. Texts that agree on a band of values meet in a bucket. Buckets give star links to their least text, and the connected
   components of those links, found by contraction, hold every candidate pair: a component's texts are shipped once, not
   once per band.
3. Inside a component pairs are compared value by value, ``STEP`` at a time: with m of n equal, the posterior of a Jaccard
   index of at least ``THRESHOLD`` under a uniform prior is P(Binomial(n+1, THRESHOLD) <= m); pairs below ``TOLERANCE`` go.
4. The pairs left are verified exactly on their shingle sets. Classes are the components of verified links.

Components of over ``TILE`` texts are cut into tiles by hash and every pair of tiles is a task of its own, so no task holds
more than two tiles; what leaves a task is a count and a root per text, never its pairs.

Null text counts as empty; texts without words link to nothing but are copies of equal texts. Ties need no rule: classes
are named by their least doc_id. Repeated rows are copies. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing
from .common import by_bytes, forget, prepare, table, texts_of, written
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at Jaccard 0.8 shares no band with probability 6e-5; one at 0.3 shares one with 0.02, so that unlike texts seldom meet.
BANDS, ROWS = 32, 6
STEP, TOLERANCE = 16, 1e-5
TILE = 1024
#: Bytes of text hashed at once.
SLICE = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(7))
_MULTIPLIERS = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_equal(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values among ``n`` with which a pair stays: its posterior of reaching ``threshold`` is ``tolerance`` or more."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


LEAST = {n: least_equal(n) for n in range(STEP, BANDS * ROWS + 1, STEP)}


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted. Texts are hashed a few at a time, so a block's memory is that of its sets."""
    out: list[np.ndarray] = []
    for part in by_bytes(texts, SLICE):
        out += _shingles(texts[part])
    return out


def _shingles(texts: list[bytes]) -> list[np.ndarray]:
    hashes, _, _, counts = hashing.words(texts)
    out, at = [], 0
    for n in counts.tolist():
        own = hashes[at : at + n]
        at += n
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        if n < SHINGLE:
            own = np.concatenate((own, np.full(SHINGLE - n, n, np.uint64)))
        mixed = np.zeros(max(1, n - SHINGLE + 1), np.uint64)
        for j in range(SHINGLE):
            mixed += own[j : j + len(mixed)] * _PLACES[j]
        out.append(np.unique(hashing.final(mixed)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row per set; sets must not be empty."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), len(_MULTIPLIERS)), np.uint32)
    for k, a in enumerate(_MULTIPLIERS):
        out[:, k] = np.minimum.reduceat((flat * a) >> np.uint64(32), at)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash per band of each row."""
    out = np.empty((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        part = signature[:, b * ROWS : (b + 1) * ROWS].astype(np.uint64)
        h = np.full(len(part), b + 1, np.uint64)
        for j in range(ROWS):
            h = hashing.final(h * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
        out[:, b] = h
    return out


def _key(text: bytes) -> bytes:
    return hashlib.md5(text).digest()


def _fresh(texts: list[bytes], seen: set[bytes]) -> list[tuple[bytes, bytes]]:
    """Keys and texts that this task has not met before."""
    out = []
    for t in texts:
        k = _key(t)
        if k not in seen:
            seen.add(k)
            out.append((k, t))
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, key) rows. A task sends each band value once, with the first text that has it; texts that meet it later in the
    task share a bucket of their own with that first text, so a bucket gets a row per task at most, however large the group."""
    seen: set[bytes] = set()
    first: dict[int, int] = {}
    texts: list[bytes] = []
    for batch in batches:
        new = _fresh(texts_of(batch, 0), seen)
        for part in by_bytes([t for _, t in new], SLICE):
            sets = shingles([t for _, t in new[part]])
            keys = [k for (k, _), s in zip(new[part], sets) if len(s)]
            if not keys:
                continue
            buckets, owners = [], []
            for key, found in zip(keys, bands(signatures([s for s in sets if len(s)])).tolist()):
                me = len(texts)
                texts.append(key)
                meets = {first.setdefault(band, me) for band in found}
                mine = [band for band in found if first[band] == me]
                buckets += mine
                owners += [key] * len(mine)
                for other in sorted(meets - {me}):
                    own = int.from_bytes(hashlib.blake2b(key + texts[other], digest_size=8).digest(), "little")
                    buckets += [own, own]
                    owners += [key, texts[other]]
            for k in range(0, len(buckets), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(buckets[k : k + 50_000], np.uint64).view(np.int64)), pa.array(owners[k : k + 50_000], pa.binary())], ["band", "key"])


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        new = _fresh(texts_of(batch, 0), seen)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in new], pa.binary()), pa.array([t for _, t in new], pa.binary())], ["key", "body"])


def _equal_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``a`` and ``b`` that survive the incremental comparison; with ``same`` only i < j."""
    left, right = [], []
    width = a.shape[1]
    for begin in range(0, len(a), 256):
        block = a[begin : begin + 256]
        equal = np.zeros((len(block), len(b)), np.int16)
        for k in range(STEP):
            equal += block[:, k, None] == b[None, :, k]
        alive = equal >= LEAST[STEP]
        if same:
            alive &= np.arange(begin, begin + len(block))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(alive)
        m = equal[i, j].astype(np.int64)
        for n in range(2 * STEP, width + 1, STEP):
            if not len(i):
                break
            m = m + (block[i, n - STEP : n] == b[j, n - STEP : n]).sum(1)
            stay = m >= LEAST[n]
            i, j, m = i[stay], j[stay], m[stay]
        left.append(i + begin)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _shared(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs' sets, exactly."""
    if len(i) <= 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    # many pairs among few sets: products of 0/1 matrices, over the shingles that at least two sets have
    sets = [*a, *b]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    kept = times[column] > 1
    owner, column = owner[kept], np.unique(column[kept], return_inverse=True)[1]
    total = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (begin, begin + 4096))
        ones = np.zeros((len(sets), 4096), np.float32)
        ones[owner[lo:hi], column[lo:hi] - begin] = 1
        total += ones[: len(a)] @ ones[len(a) :].T
    return total[i, j].astype(np.int64)


def linked(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets whose Jaccard index is ``THRESHOLD`` or more: within ``a`` (i < j), or between ``a`` and ``b``."""
    same = b is None
    b = a if same else b
    sa = signatures(a)
    i, j = _equal_pairs(sa, sa if same else signatures(b), same)
    if not len(i):
        return i, j
    sizes = np.array([len(s) for s in a])[i] + np.array([len(s) for s in b])[j]
    inter = _shared(a, b, i, j)
    # in whole numbers: inter / (sizes - inter) >= 4 / 5
    top, bottom = round(THRESHOLD * 1000), 1000
    good = inter * bottom >= top * (sizes - inter)
    return i[good], j[good]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (component, tile a, tile b); yields key, root and number of links per text and block."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[4]: r for r in rows}.values())  # a text arrives once per task that met it
        (_, a, b, _, _, _) = rows[0]
        sides = [[r for r in rows if r[3] == t] for t in ((a,) if a == b else (a, b))]
        keys = [r[4] for s in sides for r in s]
        sets = [shingles([r[5] for r in s]) if s else [] for s in sides]
        links, roots = np.zeros(len(keys), np.int64), np.arange(len(keys))
        if all(sets):
            i, j = linked(*sets)
            j = j + (len(sets[0]) if a != b else 0)
            np.add.at(links, i, 1)
            np.add.at(links, j, 1)
            order = np.argsort(np.array(keys, dtype="S16"), kind="stable")
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys))
            roots = order[_forest(len(keys), place[i], place[j])][place]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([keys[r] for r in roots], pa.binary()), pa.array(links)], ["key", "root", "links"])

    own: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if own and row[:3] != own[0][:3]:
                yield solve(own)
                own = []
            own.append(row)
    if own:
        yield solve(own)


def text_classes(docs: DataFrame) -> DataFrame:
    """key (MD5 of the text), root (least key of its class) and links, for every text with a candidate; others are alone."""
    prepare(docs.sparkSession)
    bodies = docs.select("text")
    # one exchange: a bucket's rows are few, one per task, and link to the least of them
    band = bodies.mapInArrow(_bands, "band long, key binary")
    band = band.withColumn("v", F.min("key").over(Window.partitionBy("band")))
    stars = band.filter("key <> v").select(F.col("key").alias("u"), "v").distinct()
    group = components(stars)
    sizes = group.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    member = group.join(sizes, "root").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    member = member.select("node", F.col("root").alias("component"), F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile")
    member = written(member, "members")
    texts = bodies.mapInArrow(_first_texts, "key binary, body binary")
    # by merge at every size: texts move once, and the plan doesn't change as the corpus grows
    rows = texts.join(member.hint("merge"), F.col("node") == F.col("key")).select("component", "a", "b", "tile", "key", "body")
    rows = rows.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b")
    found = written(rows.mapInArrow(_blocks, "key binary, root binary, links long"), "linked")
    forget(member)
    many = written(found.groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("root").alias("last")), "texts")
    if many.filter("root <> last").isEmpty():  # every component was one block, whose roots are final
        return many.select("key", "root", "links")
    joined = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    return many.select("key", "links").join(joined, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"), "links")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (other texts with a Jaccard index of at least 0.8), n_copies (documents of this text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    member = written(docs.select("doc_id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("key")), "keys")
    texts = member.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    found = text_classes(docs).select(F.col("key").alias("of"), "root", "links")
    texts = texts.join(found, F.col("key") == F.col("of"), "left").select("key", "least", "n_copies", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("n_links"))
    texts = written(texts, "texts")
    named = texts.groupBy("root").agg(F.min("least").alias("class_id")).withColumnRenamed("root", "name")
    texts = texts.join(named, F.col("root") == F.col("name")).select("key", "root", "class_id", "n_links", "n_copies")
    return member.join(texts, "key").select("doc_id", "class_id", "n_links", "n_copies", "key", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id (null only if the class has no other)."""
    found = classes(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = found.groupBy("root").agg(F.min(F.struct("key", "doc_id")).alias("k")).select(F.col("k.key").alias("_nd_key"), F.col("k.doc_id").alias("_nd_doc"))
    rows = docs.withColumn("_nd_own", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    rows = rows.join(kept.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_nd_doc")) & (F.col("_nd_own") == F.col("_nd_key")), "left_semi")
    again = Window.partitionBy("doc_id", "_nd_own").orderBy(F.lit(0))  # rows that repeat as a whole
    return rows.withColumn("_nd_row", F.row_number().over(again)).filter("_nd_row = 1").select(*docs.columns)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("key", "root")
