"""Passages of ``LEAST`` words that other documents have too: how many words of each text they cover.

Words are maximal runs of bytes outside space and 0x09-0x0D, compared as bytes; what stands between them doesn't count.

1. Every window of ``least`` words has an anchor, its substring of least hash among those of ``gram`` words. Neighbouring windows
   with one anchor form a run; equal windows have equal anchors at equal places, so they meet by anchor. A whole text is a run of
   its own kind, so copies meet as such. A packet of a task's runs sends one row per different run, with the places of the others.
2. Anchors that one text only has are done. Where all runs of an anchor are equal, all their windows repeat.
3. The windows of the other runs go to blocks by anchor, those of anchors with over ``HOT`` rows by their own hash, so that no block
   grows with an anchor. In a block windows with equal 64-bit hashes are equal.

Null text is the empty text; texts under ``least`` words have no passage. Repeats inside one text only don't count. Copies in other
rows do. An empty table gives an empty result. Only text is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import by_bytes, forget, texts_of, written
from .ngram_join import _key

LEAST = 50
#: Runs of a packet.
PACKET = 100_000
#: Windows looked at together, and bytes hashed together; longer texts are cut, so memory doesn't grow with a text.
PIECE = 1 << 20
#: Rows of one anchor that a block takes.
HOT = 4000
#: Windows that a block should have.
BLOCK = 250_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def gram(least: int) -> int:
    """Words of an anchor."""
    return max(1, least // 3)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each."""
    parts, of = [], []
    for k, t in enumerate(texts):
        begin = 0
        while begin < len(t):
            cut = _SPACE.search(t, begin + PIECE) if len(t) - begin > PIECE else None
            end = cut.start() if cut else len(t)
            parts.append(t[begin:end])
            of.append(k)
            begin = end
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for part in by_bytes(parts, PIECE):
        hashes, _, _, n = hashing.words(parts[part])
        found.append(hashes)
        np.add.at(counts, of[part], n)
    return np.concatenate(found), counts


def _sums(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * hashing.powers(hashing._BASE, len(words)), out=out[1:])
    return out


def runs(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """Anchor, hash, text, first window and number of windows of each run, and the number of words of each text."""
    from .suffix import _least_places

    words, counts = word_hashes(texts)
    begins = np.cumsum(counts) - counts
    windows = np.maximum(counts - least + 1, 0)
    out, size = [], gram(least)
    for at in range(0, max(0, len(words) - least + 1), PIECE):
        sums = _sums(words[at : at + PIECE + least - 1])
        found = hashing.grams(sums, size)
        place = _least_places(found, least - size + 1)
        # windows that cross the end of a text are none
        text = np.searchsorted(begins, np.arange(at, at + len(place)), side="right") - 1
        own = np.flatnonzero(np.arange(at, at + len(place)) - begins[text] < windows[text])
        if not len(own):
            continue
        edge = np.flatnonzero(np.append(True, (np.diff(place[own]) != 0) | (np.diff(text[own]) != 0)))
        first, n = own[edge], np.diff(edge, append=len(own))
        out.append((found[place[first]], hashing.spans(sums, first, first + n + least - 1), text[first], first + at - begins[text[first]], n))
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
    return *(map(np.concatenate, zip(*out)) if out else (np.zeros(0, k) for k in kinds)), counts


RUN = "anchor long, run long, text long, several boolean, whole boolean, windows int, key binary, start int, more array<struct<key:binary,start:int>>"


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of rows of 16 bytes."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * 16), pa.py_buffer(np.ascontiguousarray(rows))])


def _packet(keys: list[bytes], parts: list[tuple[np.ndarray, ...]], again: list[bytes], least: int) -> pa.RecordBatch:
    """A row per different run, one per text that has windows, and one per text in ``again``, which this task has met before."""
    name = np.frombuffer(b"".join(keys + again), np.uint8).reshape(-1, 16)
    number = name[:, :8].copy().view(np.int64).ravel()
    sizes = np.concatenate([p[5] for p in parts] or [np.zeros(0, np.int64)])
    shift = np.cumsum([0, *(len(p[5]) for p in parts)])
    anchor, run, start, windows = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1, 3, 4))
    text = np.concatenate([p[2] + s for p, s in zip(parts, shift)] or [np.zeros(0, np.int64)])
    order = np.lexsort((text, anchor, run))
    edge = np.flatnonzero(np.append(True, (np.diff(run[order]) != 0) | (np.diff(anchor[order]) != 0))) if len(order) else order
    ends = np.append(edge[1:], len(order)) if len(order) else order
    one = order[edge]
    rest = np.ones(len(order), bool)
    rest[edge] = False
    rest = order[rest]
    long = np.flatnonzero(sizes >= least)
    also = np.arange(len(keys), len(keys) + len(again))
    own = np.concatenate((text[one], long, also))
    plain, n = len(one), len(own)
    offsets = np.concatenate(([0], np.cumsum(ends - edge - 1), np.full(n - plain, len(rest)))).astype(np.int32)
    places = pa.StructArray.from_arrays([_binary(name[text[rest]]), pa.array(start[rest].astype(np.int32))], ["key", "start"])
    several = np.concatenate((text[one] != text[order[ends - 1]], np.zeros(len(long), bool), np.ones(len(also), bool)))
    cols = [
        pa.array(np.concatenate((anchor[one].astype(np.uint64).view(np.int64), number[own[plain:]]))),
        pa.array(np.concatenate((run[one].astype(np.uint64).view(np.int64), number[own[plain:]]))),
        pa.array(number[own]),
        pa.array(several),
        pa.array(np.arange(n) >= plain),
        pa.array(np.concatenate((windows[one], sizes[long] - least + 1, np.zeros(len(also), np.int64))).astype(np.int32)),
        _binary(name[own]),
        pa.array(np.concatenate((start[one], np.zeros(n - plain, np.int64))).astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(offsets), places),
    ]
    return pa.RecordBatch.from_arrays(cols, ["anchor", "run", "text", "several", "whole", "windows", "key", "start", "more"])


def _runs(least: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[bytes, int] = {}
        keys, parts, again, size = [], [], [], 0
        for batch in batches:
            new = []
            for t in texts_of(batch, 0):
                k = _key(t)
                times[k] = min(3, times.get(k, 0) + 1)
                if times[k] == 1:
                    new.append((k, t))
                elif times[k] == 2:
                    again.append(k)
            for part in by_bytes([t for _, t in new], PIECE):
                found = runs([t for _, t in new[part]], least)
                keys += [k for k, _ in new[part]]
                parts.append(found)
                size += len(found[0])
                if size >= PACKET:
                    yield _packet(keys, parts, again, least)
                    keys, parts, again, size = [], [], [], 0
        if keys or again:
            yield _packet(keys, parts, again, least)

    return cut


DEALT = "block int, keys array<binary>, owner array<int>, place array<int>, hash array<long>"


def _dealt(least: int, blocks: int):
    """From (key, text, runs) sorted by key to the windows of the runs: a row per block and batch."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = [last, *batch.column(0).to_pylist()]
            last = keys[-1]
            batch = batch.take(pa.array([k for k in range(len(batch)) if keys[k] != keys[k + 1]], pa.int64()))  # a text met by several tasks comes once
            bodies = batch.column(1).to_pylist()
            for part in by_bytes(bodies):
                yield from solve(batch.column(0)[part].to_pylist(), bodies[part], batch.column(2)[part])

    def solve(keys: list[bytes], bodies: list[bytes], wanted: pa.ListArray) -> Iterator[pa.RecordBatch]:
        words, counts = word_hashes(bodies)
        anchor, hot, start, n = (wanted.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
        n = n.astype(np.int64)
        owner = np.repeat(np.repeat(np.arange(len(keys)), np.diff(wanted.offsets.to_numpy())), n)
        place = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
        at = place + (np.cumsum(counts) - counts)[owner]
        anchor = np.repeat(anchor.view(np.uint64), n)
        hashes = hashing.final(hashing.spans(_sums(words), at, at + least) + anchor)
        block = np.where(np.repeat(hot, n), hashes, hashing.final(anchor)) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
        for rows in np.split(order, edge[1:]):
            used, own = np.unique(owner[rows], return_inverse=True)
            lists = [pa.array([keys[k] for k in used], pa.binary()), pa.array(own.astype(np.int32)), pa.array(place[rows].astype(np.int32)), pa.array(hashes[rows].view(np.int64))]
            cols = [pa.array([int(block[rows[0]])], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in DEALT.split(", ")])

    return deal


SPAN = "key binary, start int, windows int"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (block, keys, owner, place, hash) sorted by block to the stretches of windows that several texts have."""

    def solve(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        shift = np.cumsum([0, *(len(r[0]) for r in rows)])
        names = np.concatenate([r[0] for r in rows])
        owner = np.concatenate([r[1] + s for r, s in zip(rows, shift)])
        place, hashes = (np.concatenate([r[k] for r in rows]) for k in (2, 3))
        _, text = np.unique(names.view("V16").ravel() if len(names) else np.zeros(0, "V16"), return_inverse=True)
        text, first = text[owner], np.zeros(len(names), np.int64)
        first[text[::-1]] = owner[::-1]
        order = np.argsort(hashes, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0))
        common = np.minimum.reduceat(text[order], edge) != np.maximum.reduceat(text[order], edge)
        own = order[np.repeat(common, np.diff(edge, append=len(order)))]
        own = own[np.lexsort((place[own], text[own]))]
        t, p = text[own], place[own]
        new = np.flatnonzero(np.append(True, (np.diff(t) != 0) | (np.diff(p) > 1))) if len(own) else own
        last = np.append(new[1:], len(own)) - 1 if len(own) else own
        cols = [_binary(names[first[t[new]]]), pa.array(p[new].astype(np.int32)), pa.array((p[last] - p[new] + 1).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["key", "start", "windows"])

    now, rows = None, []
    for batch in batches:
        block, keys, *lists = batch.columns
        for k in range(len(batch)):
            if rows and block[k].as_py() != now:
                yield solve(rows)
                rows = []
            now = block[k].as_py()
            names = np.frombuffer(b"".join(keys[k].as_py()), np.uint8).reshape(-1, 16)
            rows.append((names, *(x[k].values.to_numpy() for x in lists)))
    if rows:
        yield solve(rows)


def shared_words(docs: DataFrame, texts: DataFrame, least: int = LEAST) -> DataFrame:
    """key (MD5 of the text) and n_words: words covered by windows of ``least`` words that other rows' texts have too, for texts with any.
    ``texts``: key and body of the texts of ``docs``, repeated or not."""
    every = written(docs.select("text").mapInArrow(_runs(least), RUN), "word_runs")
    # sums before the shuffle make copies and common passages cheap
    anchors = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("run").alias("least_run"), F.max("run").alias("most_run"), F.min("text").alias("least_text"), F.max("text").alias("most_text"), F.max("several").alias("several"), F.max("whole").alias("copied"))
    anchors = anchors.filter("several or least_text < most_text or copied and n > 1").select("anchor", F.expr("least_run = most_run").alias("same"), (F.col("n") > HOT).alias("hot"))
    places = F.concat(F.array(F.struct("key", "start")), "more")
    met = written(every.join(anchors.hint("merge"), "anchor").select("anchor", "same", "hot", "windows", F.inline(places)), "met")
    forget(every)
    mixed = met.filter("not same")
    amount = mixed.agg(F.sum("windows").alias("n")).first().n or 0
    wanted = mixed.groupBy("key").agg(F.collect_set(F.struct("anchor", "hot", "start", "windows")).alias("runs"))
    asked = texts.join(wanted.hint("merge"), "key").sortWithinPartitions("key").select("key", "body", "runs")
    dealt = asked.mapInArrow(_dealt(least, max(1, amount // BLOCK)), DEALT)
    found = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_met, SPAN)
    spans = met.filter("same and windows > 0").select("key", "start", "windows").unionByName(found)
    spans = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("windows") + least - 1).alias("end")))).alias("spans"))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def longer(a, x):
        return F.struct(F.greatest(a.end, x.end).alias("end"), (a.n + F.greatest(F.lit(0), x.end - F.greatest(a.end, x.start))).cast("long").alias("n"))

    return spans.select("key", F.aggregate("spans", none, longer, lambda a: a.n).alias("n_words"))
