"""Suffix-array dedup: bytes covered by a string of ``least`` bytes (``LEAST`` unless said otherwise) that also starts elsewhere.

Distribution. Every window of ``least`` bytes has an anchor, its substring of least hash among those of about a third of its length;
equal windows have equal anchors at equal places. Neighbouring windows with one anchor form a run, so a text falls into runs (about
one per third of ``least``), and equal windows can only be in runs whose anchors are equal. Anchors that occur once are done. Runs that are equal
as a whole collapse into one with a multiplicity; an anchor all of whose runs are equal is one interval, repeated over its whole depth.
The remaining runs, one representative of each different run, go to blocks by anchor.

Packets. A task's runs are numbered by packet; a packet sends one row per different run, however often it occurs there, and keeps the
places itself. What is found of a run goes back to packets, one row to each, and becomes byte ranges of texts there.

Blocks. A block's runs are one text; its suffixes are sorted, and the Burrows-Wheeler transform is expanded breadth
first: level by level every interval of a string w is extended backward to the intervals of cw, and a boundary gets the common
prefix length of the level that first reaches it. Intervals whose boundary is known are not extended again, and expansion ends at
``LEAST`` levels: boundaries not reached by then separate suffixes with at least ``LEAST`` bytes in common.

Anchors with over ``HOT`` different runs would make a block too large: their windows are compared one by one through 128-bit
hashes, dealt over all tasks and summed before the shuffle. Nothing is skipped.

Null text is the empty text; texts under ``LEAST`` bytes lose nothing. Of texts that occur more than once every window repeats.
Repeated rows are occurrences of their own. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import forget, prepare, table, texts_of, written
from .ngram_join import _fresh, _first_texts
from .passages import shared_words

LEAST = 400
#: Runs of a packet.
PACKET = 100_000
#: Window starts hashed at once; longer texts are cut with an overlap, so memory doesn't grow with a text.
PIECE = 1 << 20
#: Different runs of one anchor that a block takes.
HOT = 4000
#: Bytes of runs that a block should have.
BLOCK = 1 << 20
_U = np.uint64


# -- anchors ---------------------------------------------------------------------------------------


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbouring values; ties go to the left."""
    n = len(values) - width + 1
    low = (values >> _U(24) << _U(24)) | np.arange(len(values), dtype=np.uint64)
    rows = -(-len(low) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(low)] = low
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _U((1 << 24) - 1)).astype(np.int64)


def gram(least: int) -> int:
    """Bytes of an anchor among windows of ``least`` bytes."""
    return max(1, least * 8 // 25)


def runs(text: bytes, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Anchor hash, first window, number of windows and hash of the bytes of each run of a text."""
    out, size = [], gram(least)
    for begin in range(0, max(0, len(text) - least + 1), PIECE):
        data = np.frombuffer(text, np.uint8, min(len(text) - begin, PIECE + least - 1), begin)
        sums = hashing.prefix(data)
        found = hashing.grams(sums, size)
        place = _least_places(found, least - size + 1)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        count = np.diff(np.append(first, len(place)))
        out.append((found[place[first]], first + begin, count, hashing.spans(sums, first, first + count + least - 1)))
    return tuple(map(np.concatenate, zip(*out))) if out else tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.uint64))


#: Of a packet: a row per different run (``first``, ``last``: its least and greatest place, key and start), and one row with all places.
RUN = "packet long, number int, anchor long, run long, windows int, first binary, last binary, places binary"
_RUN = pa.schema([("packet", pa.int64()), ("number", pa.int32()), ("anchor", pa.int64()), ("run", pa.int64()), ("windows", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("places", pa.binary())])


def _packet(uid: int, keys: list[bytes], parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """``parts``: of each text anchors, starts, windows and hashes of its runs."""
    text = np.repeat(np.arange(len(keys)), [len(p[0]) for p in parts])
    anchor, start, windows, run = map(np.concatenate, zip(*parts))
    order = np.lexsort((anchor, run))
    edge = np.flatnonzero(np.append(True, (np.diff(run[order]) != 0) | (np.diff(anchor[order]) != 0)))
    number = np.empty(len(order), np.int32)
    number[order] = np.repeat(np.arange(len(edge)), np.diff(edge, append=len(order)))
    rank = np.empty(len(keys), np.int64)
    rank[np.argsort(np.array(keys, dtype="S16"), kind="stable")] = np.arange(len(keys))
    by_rank = np.argsort(rank)
    place = (rank[text] << 32 | start)[order]

    def where(code: np.ndarray) -> list[bytes]:
        return [keys[t] + int(s).to_bytes(4, "big") for t, s in zip(by_rank[code >> 32].tolist(), (code & 0xFFFFFFFF).tolist())]

    first, last = where(np.minimum.reduceat(place, edge)), where(np.maximum.reduceat(place, edge))
    sizes = np.array([len(keys), len(text)], np.int64)
    places = zstandard.compress(b"".join((sizes.tobytes(), *keys, number.tobytes(), text.astype(np.int32).tobytes(), start.astype(np.int32).tobytes())), 1)
    own, n = order[edge], len(edge)
    cols = [[uid] * (n + 1), [*range(n), -1], pa.array(anchor[own].view(np.int64)).to_pylist() + [None], pa.array(run[own].view(np.int64)).to_pylist() + [None], [*windows[own].tolist(), None], [*first, None], [*last, None], [None] * n + [places]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RUN)], schema=_RUN)


def _runs(least: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        uid = TaskContext.get().partitionId() << 32
        keys, parts, size = [], [], 0
        for batch in batches:
            for k, text in _fresh(texts_of(batch, 0), seen):
                part = runs(text, least)
                if len(part[0]):
                    keys.append(k)
                    parts.append(part)
                    size += len(part[0])
                if size >= PACKET:
                    yield _packet(uid, keys, parts)
                    uid += 1
                    keys, parts, size = [], [], 0
        if keys:
            yield _packet(uid, keys, parts)

    return cut


PLACED = "key binary, spans array<struct<begin:int,end:int>>"
_PLACED = pa.schema([("key", pa.binary()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])


def _placed(least: int):
    """Rows (packet, number, froms, tos, places) come sorted by packet, the row with places first; yields the byte ranges of each text."""

    def solve(places: bytes, found: dict[int, tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
        raw = zstandard.decompress(places)
        texts, n = np.frombuffer(raw, np.int64, 2).tolist()
        number, text, start = np.frombuffer(raw, np.int32, 3 * n, 16 + 16 * texts).reshape(3, n)
        spans: dict[int, list[tuple[int, int]]] = {}
        for k in np.flatnonzero(np.isin(number, np.fromiter(found, np.int32, len(found)))).tolist():
            own, at = spans.setdefault(int(text[k]), []), int(start[k])
            own += [(at + a, at + b + least - 1) for a, b in zip(*found[int(number[k])])]
        rows = [(raw[16 + 16 * t : 32 + 16 * t], [{"begin": a, "end": b} for a, b in merged(s)]) for t, s in spans.items()]
        if rows:
            keys, ranges = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ranges, _PLACED.field("spans").type)], schema=_PLACED)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, found = b"", {}
        for batch in batches:
            for number, froms, tos, own in zip(*(c.to_pylist() for c in batch.columns)):
                if number >= 0:
                    found[number] = froms, tos
                    continue
                if found:
                    yield from solve(places, found)
                places, found = own, {}
        if found:
            yield from solve(places, found)

    return place


# -- blocks ----------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """Suffixes of ``data`` in the order of their first ``least`` bytes; ``left[i]`` bytes are left from i to the end of its run, 0 at a separator.
    Separators are the least symbols. By prefix doubling from packed first bytes; with more bytes in common any order will do."""
    n = len(data)
    packed = np.zeros(n, np.uint64)
    for j in range(7):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - j] = data[j:]
        packed = (packed << _U(8)) | np.where(left > j, shifted, _U(0))
    packed = (packed << _U(8)) | np.minimum(left, 7).astype(np.uint64)
    order = np.argsort(packed)
    packed = packed[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], packed[1:] != packed[:-1])))
    step, longest = 7, min(int(left.max(initial=0)), least - 1)
    at, bits = np.arange(n), n.bit_length()
    while step <= longest and rank[order[-1]] < n - 1:
        # only suffixes that reach past ``step`` compare further; the others end at their own separator
        beyond = np.where(left > step, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank << bits | beyond
        if 3 * bits <= 63:  # values with their places sort faster than places by values
            key = np.sort(key << bits | at)
            order = key & ((1 << bits) - 1)
            key >>= bits
        else:
            order = np.argsort(key)
            key = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        step *= 2
    return order


def boundaries(data: np.ndarray, left: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """True at r if suffixes r-1 and r have under ``least`` bytes in common, by interval expansion on the transform."""
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    before = order - 1
    # a run's first byte has no extension; its separator (left == 0) is extended to the run's last byte
    extends = (before >= 0) & (left[np.maximum(before, 0)] > 0)
    symbol = np.where(extends, data[np.maximum(before, 0)], 0).astype(np.int64)
    back = np.where(extends, inverse[np.maximum(before, 0)], -1)  # the LF mapping
    step = np.where(extends, symbol << 32 | back, -1)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    # level 0: the intervals of single symbols; every separator is a symbol of its own
    head = np.where(left[order] > 0, data[order].astype(np.int64) + n, inverse[order])
    right = np.append(np.flatnonzero(np.diff(head)), n - 1)
    begin = np.concatenate(([0], right[:-1] + 1))
    stay = ~known[right + 1]
    begin, right = begin[stay], right[stay]
    known[right + 1] = True
    for _ in range(1, least):
        if not len(begin):
            break
        one = begin == right
        single = back[begin[one]]
        single = single[single >= 0]
        size = right[~one] - begin[~one] + 1
        if len(size):
            owner = np.repeat(np.arange(len(size)), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin[~one], size)
            own = step[place] >= 0
            # by interval and symbol; the least and the greatest place bound the extension
            key = np.sort(owner[own] << 40 | step[place[own]])
            edge = np.flatnonzero(np.diff(key >> 32))
            low = key[np.concatenate(([0], edge + 1))] & 0xFFFFFFFF if len(key) else edge
            high = key[np.append(edge, len(key) - 1)] & 0xFFFFFFFF if len(key) else edge
        else:
            low = high = np.zeros(0, np.int64)
        begin, right = np.concatenate((single, low)), np.concatenate((single, high))
        stay = ~known[right + 1]
        begin, right = begin[stay], right[stay]
        known[right + 1] = True
    return known


def repeated(segments: list[bytes], many: list[bool], least: int = LEAST) -> list[np.ndarray]:
    """Per segment, for each of its windows whether it starts more than once among the segments; ``many``: the segment itself stands for several."""
    sizes = np.array([len(s) for s in segments])
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    left = ends[owner] - np.arange(len(data))
    order = suffix_array(data, left, least)
    cut = boundaries(data, left, order, least)
    group = np.cumsum(cut[:-1])
    weight = np.bincount(group, 1 + np.array(many, np.int64)[owner[order]])
    flag = np.zeros(len(data), bool)
    flag[order] = weight[group] > 1
    flag &= left >= least
    return [flag[e - n : e - n + max(0, n - least + 1)] for e, n in zip(ends.tolist(), sizes.tolist())]


def _true_runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and past-the-last places of maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


FOUND = "anchor long, run long, froms array<int>, tos array<int>"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ((), (), (), ())
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["anchor", "run", "froms", "tos"])


def _blocks(least: int):
    """Rows (block, anchor, run, many, body) come sorted by block."""

    def solve(own: dict[tuple[int, int], tuple[bool, bytes]]) -> pa.RecordBatch:
        flags = repeated([b for _, b in own.values()], [m for m, _ in own.values()], least)
        return _found([(*k, *_true_runs(f)) for k, f in zip(own, flags) if f.any()])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, {}
        for batch in batches:
            for block, anchor, run, many, body in zip(*(c.to_pylist() for c in batch.columns)):
                if own and block != now:
                    yield solve(own)
                    own = {}
                now = block
                own[anchor, run] = many, body  # a text met by several tasks brings its runs several times
        if own:
            yield solve(own)

    return expand


PART = "anchor long, run long, many boolean, hot boolean, body binary"


def _cut(least: int):
    """From (runs of a text, text) to the bytes of each run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for parts, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(p["anchor"], p["run"], p["many"], p["hot"], body[p["start"] : p["start"] + p["windows"] + least - 1]) for p in parts]
            for k in range(0, max(1, len(rows)), 4000):
                cols = list(zip(*rows[k : k + 4000])) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in PART.split(", ")])

    return cut


WINDOW = "anchor long, run long, many boolean, place int, one long, two long"


def _windows(least: int):
    """A row per window of a run, with a 128-bit hash."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, run, many, body in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(body) - least + 1
                hashes = [hashlib.blake2b(body[k : k + least], digest_size=16).digest() for k in range(n)]
                pair = np.frombuffer(b"".join(hashes), np.int64).reshape(n, 2)
                cols = [pa.array(np.full(n, anchor)), pa.array(np.full(n, run)), pa.array(np.full(n, many)), pa.array(np.arange(n, dtype=np.int32)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in WINDOW.split(", ")])

    return spread


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """key (MD5 of the text) and spans: maximal byte ranges covered by repeated windows, for texts with any; texts of several rows are not compared with themselves."""
    prepare(docs.sparkSession)
    bodies = docs.select("text")
    every = written(bodies.mapInArrow(_runs(least), RUN), "runs")
    own = every.filter("number >= 0")
    # one row per different run; partial sums before the shuffle make copies and common passages cheap
    kinds = own.groupBy("anchor", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("windows").alias("windows"))
    start = F.conv(F.hex(F.substring("first", 17, 4)), 16, 10).cast("int")
    kinds = written(kinds.select("anchor", "run", "windows", F.substring("first", 1, 16).alias("key"), start.alias("start"), (F.col("first") != F.col("last")).alias("many")), "kinds")
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("different"), F.max("many").alias("again"))
    anchors = written(anchors.filter("different > 1 or again"), "anchors")
    mixed = kinds.join(anchors.filter("different > 1"), "anchor").withColumn("hot", F.col("different") > HOT)
    wanted = mixed.groupBy("key").agg(F.collect_list(F.struct("anchor", "run", "many", "hot", "start", "windows")).alias("parts"))
    texts = bodies.mapInArrow(_first_texts, "key binary, body binary")
    parts = written(texts.join(wanted.hint("merge"), "key").select("parts", "body").mapInArrow(_cut(least), PART), "parts")
    amount = parts.filter("not hot").agg(F.sum(F.octet_length("body")).alias("n")).first().n or 0
    blocks = max(1, amount // BLOCK)
    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks))
    cold = parts.filter("not hot").select(block.alias("block"), "anchor", "run", "many", "body")
    found = cold.repartition("block").sortWithinPartitions("block").mapInArrow(_blocks(least), FOUND)
    hot = not anchors.filter(F.col("different") > HOT).isEmpty()
    if hot:
        windows = written(parts.filter("hot").select("anchor", "run", "many", "body").mapInArrow(_windows(least), WINDOW).distinct(), "windows")
        again = windows.groupBy("one", "two").agg(F.count("*").alias("n"), F.max("many").alias("m")).filter("n > 1 or m").select("one", "two")
        places = windows.join(again, ["one", "two"]).groupBy("anchor", "run").agg(F.array_sort(F.collect_list("place")).alias("froms"))
        found = found.unionByName(places.withColumn("tos", F.transform("froms", lambda p: p + 1)))
    # equal runs throughout: all windows repeat
    whole = kinds.join(anchors.filter("different = 1"), "anchor").select("anchor", "run", F.array(F.lit(0)).alias("froms"), F.array("windows").alias("tos"))
    found = written(found.unionByName(whole), "found")
    for done in [kinds, anchors, parts, *([windows] if hot else [])]:
        forget(done)
    spans = own.select("packet", "number", "anchor", "run").join(found.hint("merge"), ["anchor", "run"]).select("packet", "number", "froms", "tos", F.lit(None).cast("binary").alias("places"))
    nothing = F.lit(None).cast("array<int>")
    spans = spans.unionByName(every.filter("number < 0").select("packet", "number", nothing.alias("froms"), nothing.alias("tos"), "places"))
    spans = spans.repartition("packet").sortWithinPartitions("packet", "number").select("number", "froms", "tos", "places")
    return spans.mapInArrow(_placed(least), PLACED).dropDuplicates(["key"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges that ``spans`` cover; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, body, spans in zip(*(c.to_pylist() for c in batch.columns)):
            ranges = [(s["begin"], s["end"]) for s in spans]
            rows.append((key, sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(kept_bytes(body, ranges)).hexdigest()))
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["of", "removed", "n", "sha"])


def _key_column():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = written(docs.select("doc_id", _key_column().alias("key"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("own")), "keys")
    copies = rows.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1").select(F.col("key").alias("copied"))
    texts = docs.select("text").mapInArrow(_first_texts, "key binary, body binary")
    words = shared_words(docs, texts).select(F.col("key").alias("has"), "n_words")
    part = repeats(docs).join(copies, F.col("key") == F.col("copied"), "left_anti")
    part = texts.join(part.hint("merge"), "key").select("key", "body", "spans").mapInArrow(_digests, "of binary, removed long, n long, sha string")
    rows = rows.join(part, F.col("key") == F.col("of"), "left").join(copies, F.col("key") == F.col("copied"), "left").join(words, F.col("key") == F.col("has"), "left")
    gone = F.col("copied").isNotNull() & (F.col("n_bytes") >= LEAST)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
        F.coalesce("n_words", F.lit(0)).cast("long").alias("n_passage_words"),
    )


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with bytes covered by repeated strings of ``least`` bytes taken out of their texts, and without documents of which no
    text is left. A character cut in two goes as a whole. Other columns stay; n_chars is counted again."""
    from .common import SPACES

    names = docs.columns
    rows = docs.withColumn("_sfx_key", _key_column())
    copies = rows.groupBy("_sfx_key").agg(F.count("*").alias("_sfx_copies")).filter("_sfx_copies > 1")
    spans = repeats(docs.select("text"), least).select(F.col("key").alias("_sfx_key"), F.col("spans").alias("_sfx_spans"))
    rows = rows.join(spans.hint("merge"), "_sfx_key", "left").join(copies.hint("merge"), "_sfx_key", "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, copies in zip(texts_of(batch, 0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if copies and len(text) >= least:
                    text = b""
                elif spans:
                    text = kept_bytes(text, [(s["begin"], s["end"]) for s in spans])
                out.append(text.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[3:]], ["text", *batch.schema.names[3:]])

    rest = [c for c in names if c != "text"]
    wide = rows.select("text", "_sfx_spans", "_sfx_copies", *rest)
    rows = wide.mapInArrow(clean, wide.select("text", *rest).schema).filter(F.col("text").rlike(SPACES))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*names)
