"""Importance resampling towards a target corpus, by bucket-partitioned inverted postings.

Features of a text are its runs of one and two words; a feature's bucket is its crc32 modulo ``BUCKETS``. A document's weight is the floored mean, over its
features, of the gains of their buckets: how much more frequent a bucket is in the target than in the corpus. Documents with at least ``LEAST_WORDS`` words
are drawn by weight plus Gumbel noise from a hash of the id, so reruns agree.

1. Sums: each task counts buckets in one array, a row for each bucket and task; sums of the corpus and of the target meet by bucket.
2. Postings: a task gathers documents into packets of about ``PACKET`` bytes, sorts (bucket, document, count) by bucket and cuts the list into ``RANGES``
   ranges of buckets. A range and a salt of the packet name a group, so that neither a frequent bucket nor a long corpus makes a large group.
3. Gains: the sums of both corpora go to every group of their range and come first in it. A task computes the gains of its buckets from them, streams the
   postings that follow, and emits each document's contribution, summed over the range: a row for each packet and range.
4. Contributions meet by packet and are added up to a document's weight.
5. Scores are whole numbers of a bounded range: counts for each score give the rank at which a score begins, and only rows of one score are sorted together.

Both passes over the texts must see the same rows in the same order in a partition, as scans of files do. Null texts have no words, no features, weight 0.
A null id hashes as the empty text, and is last among ties. Repeated rows are documents of their own, with ranks one after the other. An empty corpus gives an
empty result; an empty target gives gains from the smoothing alone. Long texts are read in slices. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table, texts_of

BUCKETS = 10_000
RANGES = 16
#: Bytes of text in a packet, about, and documents at most; bytes of a text read at a time.
PACKET = 4 << 20
PACKET_DOCS = 60_000
SLICE = 1 << 20
LEAST_WORDS = 20
SHARE = 25
SEED = 7

_EDGES = np.array([-(-BUCKETS * k // RANGES) for k in range(RANGES + 1)])
# A byte as it counts in a word: letters and digits of ASCII, capitals as small ones, all bytes of other characters; else a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list for each slice of about ``SLICE`` bytes."""
    begin = 0
    while begin < len(text):
        piece = text[begin : begin + SLICE].translate(_PLAIN)
        end = begin + len(piece)
        if end < len(text):
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):  # a word as long as a slice
                more = text[end : end + SLICE].translate(_PLAIN)
                end, cut, piece = end + len(more), more.find(b" ") + (len(piece) + 1 if b" " in more else 0) - 1, piece + more
            if 0 <= cut and end < len(text):
                end, piece = begin + cut, piece[:cut]
        yield piece.split()
        begin = end + (end == begin)


def buckets(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """For each slice: its number of words, and the buckets of the features that end in it."""
    last = None
    for own in words(text):
        if not own:
            continue
        single = [crc32(w) for w in own]
        before = [crc32(b" ", c) for c in single]
        pairs = [crc32(w, c) for w, c in zip(own[1:], before)]
        if last is not None:
            pairs.append(crc32(own[0], last))
        last = before[-1]
        yield len(own), np.array(single + pairs, np.int64) % BUCKETS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in texts_of(batch, 0):
            for _, found in buckets(text):
                total += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])


def sums(texts: DataFrame) -> DataFrame:
    """bucket, n: features of all texts by bucket."""
    return texts.mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


# A row on its way to a group of a range: kind 0 sums, 1 postings; range -1: what is known of the documents of a packet.
_ROW = "range int, salt int, kind int, packet long, a binary, b binary, c binary"
_KIND = pa.schema([("range", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), ("packet", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_KIND), _KIND.types)], schema=_KIND)


class _Packet:
    """Documents and their postings, until the packet is full."""

    def __init__(self) -> None:
        self.bytes, self.ids, self.words, self.features, self.postings = 0, [], [], [], []

    def add(self, doc_id: int | None, text: bytes) -> None:
        n = features = 0
        parts = []
        for own, found in buckets(text):
            n, features = n + own, features + len(found)
            parts.append(np.unique(found, return_counts=True))
        if len(parts) > 1:
            whole = np.zeros(BUCKETS, np.int64)
            for b, c in parts:
                whole[b] += c
            parts = [(np.flatnonzero(whole), whole[whole > 0])]
        self.postings += [(b, np.full(len(b), len(self.ids)), c) for b, c in parts]
        self.ids.append(doc_id)
        self.words.append(n)
        self.features.append(features)
        self.bytes += len(text)

    def rows(self, packet: int, salt: int) -> Iterator[tuple]:
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        yield -1, salt, 1, packet, known.tobytes() + ids.tobytes(), np.array(self.words, np.int64).tobytes(), np.array(self.features, np.int64).tobytes()
        if not self.postings:
            return
        b, d, c = (np.concatenate(x) for x in zip(*self.postings))
        order = np.argsort(b.astype(np.uint16), kind="stable")
        b, d, c = b[order].astype("<u2"), d[order].astype("<u2"), c[order].astype("<i8")
        cuts = np.searchsorted(b, _EDGES)
        for r, (x, y) in enumerate(zip(cuts, cuts[1:])):
            if y > x:
                yield r, salt, 1, packet, b[x:y].tobytes(), d[x:y].tobytes(), c[x:y].tobytes()


def _post(salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k, now = TaskContext.get().partitionId() << 32, 0, _Packet()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
                now.add(doc_id, text)
                if now.bytes >= PACKET or len(now.ids) == PACKET_DOCS:
                    yield _rows(list(now.rows(first + k, crc32(b"%d" % (first + k)) % salts)))
                    k, now = k + 1, _Packet()
        if now.ids:
            yield _rows(list(now.rows(first + k, crc32(b"%d" % (first + k)) % salts)))

    return run


def gain(s: int, t: int, all_s: int, all_t: int) -> int:
    """Of a bucket with s of the corpus's features and t of the target's."""
    return math.floor(1000 * math.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS))))


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a range one after the other, sums before postings; rows of packets with the contributions of their documents."""
    now, gains = None, np.zeros(BUCKETS, np.int64)
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            r, salt, kind, packet, a, b, c = row
            if r < 0:
                out.append(row)
                continue
            if (r, salt) != now:
                now, gains = (r, salt), np.zeros(BUCKETS, np.int64)
            if kind == 0:
                at, s, t = (np.frombuffer(x, "<i8") for x in (a, b, c))
                gains[at[:-1]] = [gain(x, y, int(s[-1]), int(t[-1])) for x, y in zip(s[:-1].tolist(), t[:-1].tolist())]
                continue
            docs, counts = np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<i8")
            held = np.zeros(int(docs.max()) + 1, np.int64)
            np.add.at(held, docs, gains[np.frombuffer(a, "<u2")] * counts)
            out.append((r, salt, 2, packet, held.tobytes(), None, None))
        yield _rows(out)


_DONE = "doc_id long, n_words long, n_features long, weight long"


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets one after the other, what is known of their documents before the contributions."""
    now = None

    def close() -> pd.DataFrame:
        known, ids, n, features, total = now[1:]
        weight = np.where(features > 0, total // np.maximum(features, 1), 0)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=known == 0), *(pa.array(x, pa.int64()) for x in (n, features, weight))], [x.split()[0] for x in _DONE.split(", ")])

    for batch in batches:
        for _, _, _, packet, a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
            if b is not None:
                if now:
                    yield close()
                n = np.frombuffer(b, "<i8")
                now = packet, np.frombuffer(a, np.uint8, len(n)), np.frombuffer(a, "<i8", offset=len(n)), n, np.frombuffer(c, "<i8"), np.zeros(len(n), np.int64)
            else:
                held = np.frombuffer(a, "<i8")
                now[5][: len(held)] += held
    if now:
        yield close()


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs``; ``target`` has texts in ``text_col``."""
    spark = docs.sparkSession
    prepare(spark)
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    corpus, goal = sums(narrow.select("text")), sums(target.select(F.col(text_col).alias("text")))
    both = corpus.withColumn("t", F.lit(0).cast("long")).unionByName(goal.select("bucket", F.lit(0).cast("long").alias("n"), F.col("n").alias("t")))
    both = both.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("t").alias("t"))
    both = both.unionByName(both.agg(F.lit(BUCKETS).alias("bucket"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")))
    # a bucket goes to its range, the totals to all; of each range, a copy for every salt
    own = F.when(F.col("bucket") == BUCKETS, F.sequence(F.lit(0), F.lit(RANGES - 1))).otherwise(F.array(F.floor(F.col("bucket") * RANGES / BUCKETS).cast("int")))
    ranged = both.withColumn("range", F.explode(own)).groupBy("range").agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("all"))
    packed = ranged.mapInArrow(_packed, "range int, a binary, b binary, c binary")
    copies = packed.select("range", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("packet"), "a", "b", "c")
    postings = narrow.mapInArrow(_post(salts), _ROW)
    grouped = copies.unionByName(postings).repartition("range", "salt").sortWithinPartitions("range", "salt", "kind")
    found = grouped.mapInArrow(_contribute, _ROW)
    return found.repartition("packet").sortWithinPartitions("packet", "kind").mapInArrow(_weigh, _DONE)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r, *(np.array([x[k] for x in held], "<i8").tobytes() for k in ("bucket", "s", "t"))) for r, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        names = ("range", "a", "b", "c")
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int32() if k == 0 else pa.binary()) for k in range(4)], names)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(weighed: DataFrame, share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``weighed`` with score and rank; rank is null for what isn't drawn.

    Weights are bounded by the logarithm of the corpora's sizes and noise by that of 2^33, so there are at most some tens of thousands of scores: the
    table of them that is broadcast doesn't grow with the documents.
    """
    scored = weighed.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
    counts = scored.filter(F.col("n_words") >= least).groupBy("score").agg(F.count("*").alias("n"))
    order = Window.partitionBy().orderBy(F.desc("score"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.floor(F.lit(share) * F.sum("n").over(Window.partitionBy()) / 100)
    begin = counts.select(F.col("score").alias("_score"), before.alias("_before"), most.alias("_most")).filter("_before < _most")
    placed = scored.join(F.broadcast(begin), (F.col("score") == F.col("_score")) & (F.col("n_words") >= least), "left")
    inside = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    inner = placed.filter("_score is not null").withColumn("rank", F.col("_before") + inside)
    inner = inner.withColumn("rank", F.when(F.col("rank") <= F.col("_most"), F.col("rank")).cast("long"))
    out = inner.unionByName(placed.filter("_score is null").withColumn("rank", F.lit(None).cast("long")))
    return out.drop("_score", "_before", "_most")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drawn(weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# Fixed values in the list below: crc32's table for four bits at a time.
ORACLE_SQL = r"""
with docs as (
  select row_number() over () as row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), goals as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), held as (
  select row_id, feature, count(*) as n from (
    select row_id, unnest(w) as feature from docs union all
    select row_id, w[i] || ' ' || w[i + 1] as feature from (select row_id, w, unnest(range(1, len(w))) as i from docs where len(w) > 1)
  ) group by row_id, feature
), wanted as (
  select feature, count(*) as n from (
    select unnest(w) as feature from goals union all
    select w[i] || ' ' || w[i + 1] as feature from (select w, unnest(range(1, len(w))) as i from goals where len(w) > 1)
  ) group by feature
), features as (
  select feature, hex(encode(feature)) as h from (select feature from held union select feature from wanted)
), hashed as (
  select feature, xor(list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(0, len(h)), lambda i: (instr('0123456789ABCDEF', substr(h, (i + 2 - 2 * (i % 2))::int, 1)) - 1)::bigint)),
    lambda c, x: xor(c >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108])[(xor(c, x) & 15) + 1])
  ), 4294967295::bigint) % 10000 as bucket
  from features
), corpus as (
  select bucket, sum(n) as s from held join hashed using (feature) group by bucket
), goal as (
  select bucket, sum(n) as t from wanted join hashed using (feature) group by bucket
), gains as (
  select c.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select sum(s) from corpus) + 10000)::double / ((s + 1)::double * (coalesce((select sum(t) from goal), 0) + 10000)::double)))::bigint as gain
  from corpus c left join goal g on c.bucket = g.bucket
), sums as (
  select row_id, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n)::double)::bigint as weight
  from held join hashed using (feature) join gains using (bucket) group by row_id
), scored as (
  select docs.row_id as row_id, doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint::double + 0.5::double) / 4294967296.0::double))))::bigint as score
  from docs left join sums on docs.row_id = sums.row_id
), ranked as (
  select row_id, row_number() over (order by score desc, doc_id nulls last) as place, count(*) over () as n from scored where n_words >= 20
)
select doc_id, n_features, weight, score, case when place <= 25 * n // 100 then place end::bigint as rank
from scored left join ranked on scored.row_id = ranked.row_id
"""
