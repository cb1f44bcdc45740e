"""Packing token sequences by the harmonic method.

A piece of length L is of class ``k = capacity // L`` and a bin of class k takes exactly k pieces, so every worker
fills its bins knowing nothing of the others and holds at most one open bin per class. Plain harmonic packing
pads a third; here a document is cut: while its rest would leave over ``SLACK`` of a bin of its class empty, a piece of
the next class's full size is cut off first. Bins that workers leave open are closed by best fit over groups of
``GROUP`` workers, a bounded number of pieces each.

Null text is the empty text: one id (the end) alone. Every id lies in exactly one piece. Repeated rows are
packed each. An empty table gives no piece. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, texts_of, written

CAPACITY = 2048
SLACK = 0.03
END = 1
GROUP = 16
#: Words whose ids are kept per worker.
MEMO = 500_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker long, sequence_id long, offset long"
_TYPES = [(x.split()[0], pa.int64()) for x in PIECE.split(", ")]


def _byte_letters() -> list[str]:
    """The letter a byte-level vocabulary writes for each byte: printable ones stand for themselves, others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Tokens:
    """Ids of whole texts by the ``tokenizers`` file at ``path``, memoised by word.

    White space splits before anything else in this vocabulary, so words can be encoded one by one. Words of
    plain letters with closing punctuation go to the model directly, all others through the whole tokenizer.
    """

    plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
    loaded: dict[str, Tokens] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Tokens:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            mapped = "".join(map(self.letters.__getitem__, part.encode()))
            got = self.parts[part] = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        return got

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if m := self.plain.fullmatch(text):
            return self.part(m[1].lower()) + (self.part(m[2]) if m[2] else b"")
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        words = text.split()
        known = self.words
        for w in set(words).difference(known):
            known[w] = self.word(w)
        out = b"".join(map(known.__getitem__, words))
        if len(known) > MEMO:
            self.words.clear()
            self.parts.clear()
        return out


def cuts(total: int) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [CAPACITY] * (total // CAPACITY)
    rest = total % CAPACITY
    while rest:
        k = CAPACITY // rest
        if rest * k >= CAPACITY * (1 - SLACK):
            out.append(rest)
            break
        out.append(CAPACITY // (k + 1))
        rest -= out[-1]
    return out


def _packer(path: str, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, worker, sequence = Tokens.at(path), TaskContext.get().partitionId(), 0
        bins: dict[int, list[list]] = {}
        end = np.array([END], "<u4").tobytes()

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in list(zip(*rows))[: len(_TYPES)]] if rows else [pa.array([], pa.int64())] * len(_TYPES)
            names = [n for n, _ in _TYPES]
            if with_ids:
                cols.append(pa.array([r[-1] for r in rows], pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            done: list[list] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
                ids = tokens.ids(text) + end
                total, start = len(ids) // 4, 0
                for length in cuts(total):
                    part = ids[4 * start : 4 * (start + length)]
                    piece = [doc_id, start, length, zlib.crc32(part), total, worker, None, None] + [part] * with_ids
                    start += length
                    k = CAPACITY // length
                    own = bins.setdefault(k, [])
                    own.append(piece)
                    if len(own) == k:
                        offset = 0
                        for x in own:
                            x[6], x[7] = worker << 32 | sequence, offset
                            offset += x[2]
                        done += bins.pop(k)
                        sequence += 1
            yield batch_of(done)
        yield batch_of([x for own in bins.values() for x in own])

    return pack


def best_fit(lengths: list[int]) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, longest first into the fullest bin that has room."""
    free: dict[int, list[int]] = {}
    room, used, where, offsets = 0, [], [0] * len(lengths), [0] * len(lengths)  # room: bit s is set if a bin has s ids left
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        above = room >> n
        if above:
            space = n + (above & -above).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                room &= ~(1 << space)
        else:
            b, space = len(used), CAPACITY
            used.append(0)
        where[i], offsets[i] = b, used[b]
        used[b] += n
        if space > n:
            free.setdefault(space - n, []).append(b)
            room |= 1 << (space - n)
    return where, offsets


def _close(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("worker", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    group = (rows.column("worker")[0].as_py() or 0) // GROUP
    where, offsets = best_fit(rows.column("length").to_pylist())
    made = {"sequence_id": pa.array([1 << 62 | group << 32 | b for b in where], pa.int64()), "offset": pa.array(offsets, pa.int64())}
    return pa.table({c: made.get(c, rows.column(c)) for c in rows.column_names if c != "_group"})


def pack(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """A row per piece: document, start, length, crc32 of its ids, sequence and offset there; ``with_ids`` adds the ids."""
    prepare(docs.sparkSession)
    schema = PIECE + ", ids binary" * with_ids
    # tokenised once: both closed bins and open ones are read from the table
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packer(tokenizer, with_ids), schema), "pieces")
    left = pieces.filter("sequence_id is null").withColumn("_group", F.floor(F.col("worker") / GROUP))
    closed = left.groupBy("_group").applyInArrow(_close, schema)
    return pieces.filter("sequence_id is not null").unionByName(closed).drop("worker")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
