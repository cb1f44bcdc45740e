"""Phrases whose words occur together more often than their parts would, for each language, through merged count-min sketches.

Texts are lower-cased (A to Z only), cut into pieces at ``.,;:!?`` and at 0x0A-0x0D, and pieces into words at spaces and tabs; a phrase is a run of words
inside a piece.

1. Sketches: a task counts runs of one to ``MOST`` words of a packet of texts in a count-min sketch of ``DEPTH`` rows of ``WIDTH`` cells, kept as sorted cells.
   Sketches are merged by block of cells: sums for each block and salt, then for each block. An estimate is never below the true count.
2. The cells that reach ``LEAST`` are bits: ``DEPTH * WIDTH`` of them, 32 MB whatever the input, which is what is broadcast. The second pass counts exactly
   the runs all of whose cells, and all of whose parts' cells, are set; nothing that occurs ``LEAST`` times is lost. A sketch that is too small for a
   corpus lets more runs through, which costs shuffle and changes no result: beyond some 10^9 runs choose ``WIDTH`` larger.
3. Counts meet by phrase after sums in the packet and in the task. A candidate's cuts are looked up among the counts, all arithmetic in decimals of 38 digits
   (exact up to counts of 10^16); parts of frequent longer candidates go.
4. The best of a language are chosen in two steps, in ``SPREAD`` parts first.

Null texts are empty. A null language is ``und``, as are documents that say so. Repeated rows count again. Ties in score go by count, then by the
phrase's bytes, so ranks are unique. An empty table gives an empty result. Long texts are cut into segments of about ``PACKET`` bytes; each goes on with the
last words of the one before. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing
from .common import prepare, table, texts_of, written

MOST = 3
LEAST = 10
COVERED = 50
TOP = 2000
#: Rows and cells of the sketch, and cells of a block of it. A counter stops at ``CAP``.
DEPTH = 2
WIDTH = 1 << 27
BLOCK = 1 << 22
CAP = 65_535
#: Bytes of text in a packet, about. Parts of a language in the first step of choosing the best.
PACKET = 4 << 20
SPREAD = 64

U = np.uint64
_BITS = WIDTH.bit_length() - 1
# A byte as it counts: capitals small, tabs as blanks, ends of pieces as line feeds.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))


class Segment:
    """A stretch of text: its words, and for each number of words the places where such a run begins."""

    def __init__(self, lang: str, plain: bytes, before: int) -> None:
        """``before``: words at its begin that belong to the segment before, which has counted all runs that end in them."""
        self.lang, self.plain = lang, plain
        self.hashes, begin, _, _ = hashing.words([plain])
        piece = np.searchsorted(np.flatnonzero(np.frombuffer(plain, np.uint8) == 10), begin)
        n = len(begin)
        self.n = n - before
        # runs that begin in i have their last word in i + k - 1
        self.valid = [np.arange(k - 1, n) >= before for k in range(1, MOST + 1)]
        for k in range(2, MOST + 1):
            self.valid[k - 1] &= piece[k - 1 :] == piece[: max(n - k + 1, 0)]

    def runs(self) -> Iterator[np.ndarray]:
        """For one word, two and so on: hashes of all runs, valid or not."""
        h = hashing.final(self.hashes ^ U(crc32(self.lang.encode()) * 0x9E3779B97F4A7C15 % (1 << 64)))
        for k in range(1, MOST + 1):
            yield h
            h = hashing.final(h[: max(len(self.hashes) - k, 0)] * U(0xD6E8FEB86659FD93) + self.hashes[k:])


def cells(h: np.ndarray) -> Iterator[np.ndarray]:
    """The cell of each hash in each row of the sketch."""
    for row in range(DEPTH):
        yield (hashing.final(h + U(row * 0xA0761D6478BD642F)) >> U(64 - _BITS)).astype(np.uint32)


def segments(lang: str, texts: list[bytes]) -> Iterator[Segment]:
    """Texts of one language as segments of about ``PACKET`` bytes."""
    held, size = [], 0
    for text in texts:
        plain = text.translate(_PLAIN)
        if size and size + len(plain) > PACKET:
            yield Segment(lang, b"\n".join(held), 0)
            held, size = [], 0
        if len(plain) <= PACKET:
            held.append(plain)
            size += len(plain) + 1
            continue
        begin, before = 0, b""
        while begin < len(plain):
            cut = _GAP.search(plain, begin + PACKET)
            end = cut.end() if cut else len(plain)
            own = before + plain[begin:end]
            yield Segment(lang, own, len(before.split()))
            begin, before = end, _last(own)
    if held:
        yield Segment(lang, b"\n".join(held), 0)


_GAP = re.compile(rb"[ \n]")

def _last(text: bytes) -> bytes:
    """The last ``MOST - 1`` words of a text and what follows each, a byte for a gap."""
    end = len(text)
    words: list[bytes] = []
    while end and len(words) < MOST - 1:
        solid = len(text[:end].rstrip(b" \n"))
        begin = max(text.rfind(b" ", 0, solid), text.rfind(b"\n", 0, solid)) + 1
        if solid:
            words.insert(0, text[begin:solid] + (b"\n" if b"\n" in text[solid:end] else b" "))
        end = begin if solid else 0
    return b"".join(words)


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Segment]]:
    """The segments of packets of a task's documents."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
            held.setdefault(lang, []).append(text)
            size += len(text) + 1
            if size >= PACKET:
                yield [x for lang in held for x in segments(lang, held[lang])]
                held, size = {}, 0
    if held:
        yield [x for lang in held for x in segments(lang, held[lang])]


def _sketch(salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted cells of each block as gaps, compressed."""
        press = zstandard.ZstdCompressor(1)
        for k, packet in enumerate(_packets(batches)):
            own = [h[v] for s in packet for h, v in zip(s.runs(), s.valid)]
            rows = []
            for row, found in enumerate(cells(np.concatenate(own) if own else np.zeros(0, U))):
                found.sort()
                cuts = np.searchsorted(found, np.arange(0, WIDTH + 1, BLOCK))
                for b, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    if y > x:
                        gaps = np.diff(found[x:y], prepend=np.uint32(b * BLOCK)).astype("<u4")
                        rows.append((row * (WIDTH // BLOCK) + b, k % salts, press.compress(gaps.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["block", "salt", "data"])

    return run


def _merged(final: bool):
    """Sums of the sketches of a block (and salt): from gaps to counters, or from counters to the bits of cells that reach ``LEAST``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, open_, now, total = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor(), None, np.zeros(BLOCK, np.uint32)

        def close() -> pa.RecordBatch:
            data = np.packbits(total >= LEAST).tobytes() if final else total.astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([press.compress(data)], pa.binary())], ["block", "salt", "data"])

        for batch in batches:
            for block, salt, data in zip(*(c.to_pylist() for c in batch.columns)):
                key = block, None if final else salt
                if key != now:
                    if now:
                        yield close()
                    now = key
                    total[:] = 0
                raw = open_.decompress(data)
                if final:
                    np.minimum(total + np.frombuffer(raw, "<u2"), CAP, out=total)
                else:
                    at = np.cumsum(np.frombuffer(raw, "<u4"), dtype=np.int64)
                    first = np.flatnonzero(np.diff(at, prepend=-1))
                    where = at[first]
                    total[where] = np.minimum(total[where] + np.diff(first, append=len(at)), CAP)
        if now:
            yield close()

    return run


_PART = "block int, salt int, data binary"


def frequent_cells(texts: DataFrame) -> np.ndarray:
    """Bits of the cells that reach ``LEAST``, of all rows of the sketch: ``DEPTH * WIDTH / 8`` bytes."""
    salts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 32)
    parts = texts.mapInArrow(_sketch(salts), _PART).repartition("block", "salt").sortWithinPartitions("block", "salt").mapInArrow(_merged(False), _PART)
    blocks = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merged(True), _PART)
    bits = np.zeros(DEPTH * WIDTH // 8, np.uint8)
    for row in blocks.select("block", "data").toLocalIterator():
        bits[row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8)
    return bits


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for row, at in enumerate(cells(h)):
        at = at.astype(np.int64) + row * WIDTH
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def survivors(segment: Segment, bits: np.ndarray) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """For one word, two and so on: the runs of a segment that may be frequent, each once, with their counts."""
    words = segment.plain.split()
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    may, ident = None, None
    for k, (h, valid) in enumerate(zip(segment.runs(), segment.valid), 1):
        size = len(h)
        own = _held(bits, h)
        if may is not None:
            own &= may[:size] & may[1 : size + 1]
        may = own
        if k == 1:
            ident = rank
        else:
            # a run is named by the run without its last word and that word; only runs that may be frequent are named
            names = np.full(size, -1, np.int64)
            at = np.flatnonzero(own)
            names[at] = np.unique(ident[at] * len(known) + rank[at + k - 1], return_inverse=True)[1]
            ident = names
        at = np.flatnonzero(own & valid)
        if len(at):
            _, first, counts = np.unique(ident[at], return_index=True, return_counts=True)
            yield k, [b" ".join(words[i : i + k]) for i in at[first].tolist()], counts


_COUNT = "lang string, words int, phrase string, n long"


def _exact(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packet in _packets(batches):
            for segment in packet:
                found = [(0, [None], np.array([segment.n])), *survivors(segment, bits.value)]
                size = sum(len(p) for _, p, _ in found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([segment.lang] * size, pa.string()), pa.array(np.repeat([k for k, _, _ in found], [len(p) for _, p, _ in found]), pa.int32()),
                        pa.array([x for _, p, _ in found for x in p], pa.binary()).cast(pa.string()), pa.array(np.concatenate([c for _, _, c in found]), pa.int64()),
                    ], ["lang", "words", "phrase", "n"],
                )

    return run


def counted(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, words, phrase, n: exact counts of all runs of one to ``MOST`` words that occur at least ``LEAST`` times; with words 0 the number of words of a language."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    bits = spark.sparkContext.broadcast(frequent_cells(texts))
    return texts.mapInArrow(_exact(bits), _COUNT).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter(f"words = 0 or n >= {LEAST}")


def collocations(counts: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language; ``counts`` as ``counted`` gives them, best as a table."""
    runs = counts.filter("words > 0")
    candidates = runs.filter("words > 1").withColumnRenamed("n", "a").withColumn("w", F.split("phrase", " ", -1))
    part = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda side, n: runs.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    both = both.select("lang", "phrase", "a", "k", "l", "r", (F.lit(1_000_000).cast("decimal(38,0)") * whole("a") * whole("a")).alias("x"), (whole("l") * whole("r")).alias("y"))
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("x div y").alias("score"), "k", "l", "r")).alias("c"))
    # all shorter candidates inside a longer one
    inner = F.expr(f"flatten(transform(sequence(2, least({MOST - 1}, words - 1)), s -> transform(sequence(1, words - s + 1), i -> array_join(slice(w, i, s), ' '))))")
    covers = candidates.filter("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(covers, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {COVERED} * a")
    rows = left.select("lang", "phrase", "a", "c.l", "c.r", "c.score", (F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    n = counts.filter("words = 0").select("lang", "n")
    return rows.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(written(counted(table(spark, sf_dir, "documents")), "counts"))


ORACLE_SQL = r"""
with docs as (
  select row_number() over () as row_id, coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), pieces as (
  select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from (select lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) as p from docs)
), runs as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, range(1, 4) as r(k) where len(w) >= k)
  group by lang, k, phrase
), totals as (
  select lang, sum(f)::bigint as n from runs where k = 1 group by lang
), candidates as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w from runs where k > 1 and f >= 10
), cuts as (
  select lang, k, phrase, a, c, lang || chr(10) || array_to_string(w[1:c], ' ') as lhs, lang || chr(10) || array_to_string(w[c + 1:k], ' ') as rhs from candidates, range(1, 3) as r(c) where c < k
), known as (
  select lang || chr(10) || phrase as name, f from runs
), scores as (
  select u.lang as lang, u.phrase as phrase, a, x.f as l, y.f as r, (1000000::hugeint * a * a // (x.f::hugeint * y.f))::bigint as score,
    row_number() over (partition by u.lang, u.phrase order by 1000000::hugeint * a * a // (x.f::hugeint * y.f), c) as pick
  from cuts u join known x on x.name = lhs join known y on y.name = rhs
), covers as (
  select lang, phrase, max(a) as longer from (
    select lang, array_to_string(w[i:i + 1], ' ') as phrase, a from (select lang, w, a, unnest([1, 2]) as i from candidates where k = 3)
  ) group by lang, phrase
), ranked as (
  select s.lang as lang, s.phrase as phrase, s.a as a, l, r, score, row_number() over (partition by s.lang order by score desc, s.a desc, s.phrase) as rank
  from scores s left join covers c on c.lang = s.lang and c.phrase = s.phrase where pick = 1 and (longer is null or 100 * longer < 50 * s.a)
)
select q.lang as lang, rank, phrase, a, l, r, n, score from ranked q join totals t on t.lang = q.lang where rank <= 2000
"""
