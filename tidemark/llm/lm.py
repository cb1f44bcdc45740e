"""LM scoring with an Elias-Fano n-gram trie.

The model is a trigram model over all training words and text boundaries: counts of the orders are added up with falling weight,

    p(w | u, v) = (c(u, v, w) + KAPPA * (c(v, w) + MU * p(w))) / (c(u, v) + KAPPA * (c(v) + MU)),   p(w) = (c(w) + 1) / (N + V + 1)

over words, the boundary and one word unseen. Words are identified by their 64-bit hashes; none is left out or merged with others.
The numerator needs counts of n-grams that end in w only, the denominator those of n-grams that end in v.

Shards. Trigrams are dealt to shards by their last word w. Its count comes to the same shard from the table of counts, so that a shard knows
all numerators of w, and, for each (v, w), the denominator of the token that follows. That belongs to the next token, but every
token of a text but its end is followed by one, so the sum over the text is the same; after the end the first token's denominator is counted.
Words too frequent for one shard are dealt by (v, w) and their counts are broadcast; pairs too frequent for one shard, which consist of such
words, are dealt by (u, v, w) and their counts are broadcast too; triples too frequent are broadcast with their counts and scored where the
text is read. Each of the three lists has at most four entries to a shard. A trigram of a document moves once per packet, with the
times that it occurs. The number of shards grows with the corpus.

Trie levels. The trie is one of reversed trigrams: level 1 holds last words, level 2 the words before them, level 3 the words before those. Levels are
Elias-Fano sequences over the shard's own numbering of its words, and so are the pointers from an entry to its continuations. An entry is stored
relative to its parent's place, which keeps a level monotone. A query finds its word, searches the word's range for the word before, and that one's range for
the third: the high part of the key gives a short run by select, which is searched. Where a level has no entry, the value of the one above
counts. Values (log10 numerators) and weights (log10 of one over the denominator) are quantised to 8 bits with a codebook per level. The levels are one
memory-mapped file without a name. A shard is worked on by ranges of words, each with a trie of its own, so that memory is bounded by ``RANGE``
while packets are cut into few pieces.

Null text is the empty text: one token, the end. Without training texts N and V are 0, and every
token has the base score log10(1 / 1). Ties have no part in it. Repeated rows are scored each. An empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import io
import mmap
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import by_bytes, prepare, split_of, table, texts_of, written

#: Mass of the unigram among a bigram's counts, and of bigram counts among a trigram's.
MU, KAPPA = 30.0, 0.02
#: Tokens that a shard should have, and rows of it that are worked on at once.
SHARD, RANGE = 2_500_000, 500_000
#: Bytes of text packed together; a packet has at most 2**16 documents.
PACKET = 4 << 20
#: Bytes of text hashed at once.
SLICE = 1 << 20
EDGE = np.uint64(0)  # in place of a hash: the boundary of a text
#: Bits of the hashes of words before a word that are left out: of a shard's few million words 48 bits tell all apart.
SHORT = np.uint64(16)
#: Sums are whole numbers of this unit, so that their order doesn't matter.
UNIT = 1e-9


# -- Elias-Fano --------------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence of whole numbers: low bits packed, high parts in unary, found by select over rank samples."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, width: int):
        self.low, self.high, self.n, self.width = low, high, n, width
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))  # before each 64-bit word
        self.zeros = np.arange(len(high) + 1) * 64 - self.ones

    @staticmethod
    def pack(values: np.ndarray, universe: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        n = len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = [np.zeros(0, np.uint8)]
        for k in range(0, n if width else 0, 1 << 15):  # whole bytes at a time, so that bits of few values are spread out at once
            bits = (values[k : k + (1 << 15), None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
            low.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        length = (universe >> width) + n + 1
        unary = np.zeros(-(-length // 64) * 64, np.uint8)
        unary[places] = 1
        return np.concatenate((*low, np.zeros(8, np.uint8))), np.packbits(unary, bitorder="little").view(np.uint64), n, width

    def _select(self, i: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the i-th (from 0) one, or zero with ``flip``."""
        word = np.searchsorted(before, i, side="right") - 1
        bits = self.high[word]
        bits = ~bits if flip else bits
        rest = (i - before[word]).astype(np.int64)
        at = np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << half) - 1)
            count = np.bitwise_count((bits >> at.astype(np.uint64)) & mask).astype(np.int64)
            right = count <= rest
            rest -= np.where(right, count, 0)
            at += np.where(right, half, 0)
        return word * 64 + at

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        high = self._select(i, self.ones, False) - i
        if not self.width:
            return high
        bit = i * self.width
        byte = bit >> 3
        raw = np.zeros(len(i), np.uint64)
        for k in range(8):
            raw |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        low = (raw >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)
        return high << self.width | low.astype(np.int64)

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Places of ``values`` (in [begin, end) if given), -1 where there is none."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        high = values >> self.width
        top = int(self.zeros[-1]) - 1
        inside = high < top
        high = np.where(inside, high, 0)
        # elements with this high part lie between two zeros of the unary code
        low = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) - high + 1, 0)
        past = self._select(high, self.zeros, True) - high
        if begin is not None:
            low, past = np.maximum(low, begin), np.minimum(past, end)
        stop = past.copy()
        while (open_ := low < past).any():
            at = np.flatnonzero(open_)
            middle = (low[at] + past[at]) >> 1
            less = self.at(middle) < values[at]
            low[at] = np.where(less, middle + 1, low[at])
            past[at] = np.where(less, past[at], middle)
        good = inside & (low < stop)
        out = np.full(len(values), -1, np.int64)
        at = np.flatnonzero(good)
        out[at] = np.where(self.at(low[at]) == values[at], low[at], -1)
        return out


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their codebook; bins hold about equally many values."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    # half of the cuts by rank, half evenly spaced, so that neither common nor extreme values get wide bins
    spaced = np.linspace(values.min(), values.max(), 129)[1:-1]
    cuts = np.unique(np.concatenate((np.quantile(values, np.linspace(0, 1, 129)[1:-1]), spaced)))
    codes = np.searchsorted(cuts, values, side="left")
    size = np.bincount(codes, minlength=len(cuts) + 1)
    book = np.bincount(codes, values, len(cuts) + 1) / np.maximum(size, 1)
    return codes.astype(np.uint8), book.astype(np.float32)


class Trie:
    """Three levels in one unnamed memory-mapped file."""

    def __init__(self, c1: np.ndarray, pair: np.ndarray, c2: np.ndarray, triple: np.ndarray, c3: np.ndarray, ids: int, words: Words, edge: int):
        """Training counts. c1: of every word. pair, c2: seen pairs, sorted, as word * ids + word before. triple, c3: seen triples,
        sorted, as place in ``pair`` * ids + word before. edge: the boundary's number among words, or -1."""
        self.ids, self.edge, self.after_edge = ids, edge, float(words.weight(words.texts, words.texts))
        self.unknown = float(words.level1(0)), float(words.weight(0, 0))
        known = np.flatnonzero(c1)
        word, before = pair // ids, pair % ids
        parent, second = triple // ids, triple % ids
        place = np.searchsorted(known, word)
        file = io.BytesIO()
        self.parts: dict[str, tuple] = {}

        def store(name: str, values: np.ndarray, universe: int) -> None:
            low, high, n, width = EliasFano.pack(values, universe)
            self._add(file, f"{name}-low", low)
            self._add(file, f"{name}-high", high)
            self.parts[name] = n, width

        store("words", known, len(c1))
        store("pairs", place * ids + before, max(1, len(known)) * ids)
        store("triples", triple, max(1, len(pair)) * ids)
        store("pairs of words", np.searchsorted(place, np.arange(len(known) + 1)), len(pair) + 1)
        store("triples of pairs", np.searchsorted(parent, np.arange(len(pair) + 1)), len(triple) + 1)
        numerators = words.level1(c1[known]), words.level2(c2, c1[word]), words.level3(c3, c2[parent], c1[word[parent]])
        weights = words.weight(0, c1[known]), words.weight(c2, c1[word])
        self.books = {}
        for name, values in zip(("v1", "v2", "v3", "w1", "w2"), (*numerators, *weights)):
            codes, self.books[name] = quantised(values)
            self._add(file, name, codes)
        handle = os.memfd_create("trie")
        try:
            content = bytes(8) + file.getvalue()  # a mapping isn't empty
            while content:
                content = content[os.write(handle, content) :]
            self.map = mmap.mmap(handle, 0, access=mmap.ACCESS_READ)
        finally:
            os.close(handle)
        self.words, self.pairs, self.triples = map(self._sequence, ("words", "pairs", "triples"))
        self.of_words, self.of_pairs = map(self._sequence, ("pairs of words", "triples of pairs"))

    def _add(self, file: io.BytesIO, name: str, values: np.ndarray) -> None:
        file.write(bytes(-file.tell() % 8))
        self.parts[name] = file.tell() + 8, values.dtype, len(values)
        file.write(values.tobytes())

    def _array(self, name: str) -> np.ndarray:
        at, kind, n = self.parts[name]
        return np.frombuffer(self.map, kind, n, at)

    def _sequence(self, name: str) -> EliasFano:
        return EliasFano(self._array(f"{name}-low"), self._array(f"{name}-high"), *self.parts[name])

    def _value(self, name: str, at: np.ndarray, rest) -> np.ndarray:
        codes = self._array(name)
        return np.where(at >= 0, self.books[name][codes[np.maximum(at, 0)]], rest) if len(codes) else np.broadcast_to(rest, at.shape)

    @staticmethod
    def _below(level: EliasFano, pointers: EliasFano, parent: np.ndarray, child: np.ndarray, ids: int) -> np.ndarray:
        """Places of the children of known parents, -1 elsewhere."""
        out = np.full(len(parent), -1, np.int64)
        known = np.flatnonzero(parent >= 0)
        if len(known) and level.n:
            own = parent[known]
            out[known] = level.find(own * ids + child[known], pointers.at(own), pointers.at(own + 1))
        return out

    def score(self, pair: np.ndarray, parent: np.ndarray, second: np.ndarray) -> np.ndarray:
        """log10 numerator of triples and denominator of what follows them. pair: word * ids + word before; parent, second: place in ``pair`` and the
        word before that of each triple."""
        word, before = pair // self.ids, pair % self.ids
        at1 = self.words.find(word)
        at2 = self._below(self.pairs, self.of_words, at1, before, self.ids)
        value = self._value("v2", at2, self._value("v1", at1, self.unknown[0]))
        weight = self._value("w2", at2, self._value("w1", at1, self.unknown[1]))
        weight = np.where(word == self.edge, self.after_edge, weight)
        at3 = self._below(self.triples, self.of_pairs, at2[parent], second, self.ids)
        return self._value("v3", at3, value[parent]) + weight[parent]


# -- counting ---------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, hash, n, held): kind 0 words, in training and in held-out texts, 1 training texts, 2 all tokens."""
    done: list[tuple[np.ndarray, np.ndarray, bool]] = []
    size = texts = tokens = 0

    def out() -> pa.RecordBatch:
        key, where = np.unique(np.concatenate([k for k, _, _ in done]), return_inverse=True)
        n, held = (np.bincount(where, np.concatenate([n * (out_ == side) for _, n, out_ in done]).astype(float), len(key)).astype(np.int64) for side in (False, True))
        return _rows(_COUNT, kind=np.zeros(len(key), np.int32), hash=key.view(np.int64), n=n, held=held)

    for batch in batches:
        body, train = texts_of(batch, 1), np.array(batch.column(0).to_pylist(), bool)
        for part in by_bytes(body, SLICE):
            hashes, _, _, counts = hashing.words([t.lower() for t in body[part]])
            tokens += len(hashes) + len(counts)
            texts += int(train[part].sum())
            for side in (False, True):
                own = train[part] != side
                if own.any():
                    key, n = np.unique(hashes[np.repeat(own, counts)], return_counts=True)
                    done.append((key, n, side))
                    size += len(key)
            if size > 1_000_000:
                yield out()
                done, size = [], 0
    if done:
        yield out()
    yield _rows(_COUNT, kind=[1, 2], hash=[0, 0], n=[texts, tokens], held=[0, 0])


class Words:
    """Sizes of the model, and words, pairs and triples too frequent for one shard with their training counts."""

    def __init__(self, texts: int, n: int, v: int, shards: int, hot: np.ndarray, hot_n: np.ndarray):
        self.texts, self.n, self.v, self.shards = texts, n, v, shards
        self.ids = v - (texts > 0) + 2
        hot = np.append(hot, EDGE)
        order = np.argsort(hot)
        self.hot, self.hot_n = hot[order], np.append(hot_n, texts).astype(np.int64)[order]
        none = np.zeros(0, np.int64)
        #: By order: codes of places in ``hot``, the last word's the least significant, and counts.
        self.often: dict[int, tuple[np.ndarray, np.ndarray]] = {2: (none, none), 3: (none, none)}

    def prior(self, c1):
        return MU * (np.asarray(c1) + 1) / (self.n + self.ids)

    def level1(self, c1):
        return np.log10(KAPPA * self.prior(c1))

    def level2(self, c2, c1):
        return np.log10(KAPPA * (c2 + self.prior(c1)))

    def level3(self, c3, c2, c1):
        return np.log10(c3 + KAPPA * (c2 + self.prior(c1)))

    def weight(self, c2, c1):
        return -np.log10(c2 + KAPPA * (np.asarray(c1) + MU))

    def base(self, c1):
        return np.log10((c1 + 1) / (self.n + self.v + 1))

    def frequent(self, order: int, *places: np.ndarray) -> np.ndarray:
        """Places in the list of an order, -1 where it has none; ``places``: of words in ``hot``."""
        code, good = np.zeros(len(places[0]), np.int64), np.ones(len(places[0]), bool)
        for p in places:
            code, good = code * len(self.hot) + p, good & (p >= 0)
        return found(self.often[order][0], np.where(good, code, -1))


def edged(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of texts with an edge after each text."""
    out = np.full(len(words) + len(counts), EDGE, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
    return out


def preceding(tokens: np.ndarray, counts: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each, and the one before that; texts begin with edges."""
    first = np.cumsum(counts + 1) - counts - 1
    before = np.concatenate((np.array([edge], tokens.dtype), tokens[:-1]))
    second = np.concatenate((np.array([edge], tokens.dtype), before[:-1]))
    second[first] = edge
    return before, second


def _count_often(sent, order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, hash, n, held) of n-grams of frequent words whose last n-1 are frequent together; ``hash`` has their places."""
        v: Words = sent.value
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, where = np.unique(np.concatenate([x[0] for x in done]), return_inverse=True)
            n, held = (np.bincount(where, np.concatenate([x[k] for x in done]).astype(float), len(key)).astype(np.int64) for k in (1, 2))
            return key, n, held

        def out() -> pa.RecordBatch:
            key, n, held = merged()
            return _rows(_COUNT, kind=np.zeros(len(key), np.int32), hash=key, n=n, held=held)

        edge = int(found(v.hot, np.array([EDGE]))[0])
        for batch in batches:
            body, train = texts_of(batch, 1), np.array(batch.column(0).to_pylist(), bool)
            for part in by_bytes(body, SLICE):
                hashes, _, _, counts = hashing.words([t.lower() for t in body[part]])
                after = found(v.hot, edged(hashes, counts))
                before, second = preceding(after, counts, edge)
                good = (after >= 0) & (before >= 0)
                code = before * len(v.hot) + after
                if order == 3:
                    good &= (second >= 0) & (v.frequent(2, before, after) >= 0)
                    code = second * len(v.hot) ** 2 + code
                own = np.flatnonzero(good)
                key, where = np.unique(code[own], return_inverse=True)
                n = np.bincount(where, np.repeat(train[part], counts + 1)[own], len(key)).astype(np.int64)
                done.append((key, n, np.bincount(where, minlength=len(key)) - n))
                size += len(key)
                if size > 1_000_000:
                    done = [merged()]
                    size = len(done[0][0])
                    if size > 500_000:
                        yield out()
                        done, size = [], 0
        if done:
            yield out()

    return count


def found(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of ``asked`` in sorted ``keys``, -1 where there is none."""
    if not len(keys):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


# -- packets and shards -------------------------------------------------------------------------------

ROW = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
PACK = "shard int, kind int, uid long, data binary"
PART = "uid long, kind int, data binary"
COUNT = "kind int, hash long, n long, held long"
DOCS, TABLE, TRIGRAMS = range(3)
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t]) for n, t in (x.split() for x in text.split(", "))])


_PACK, _PART, _ROW, _COUNT = map(_schema, (PACK, PART, ROW, COUNT))


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _planed(*arrays: np.ndarray) -> bytes:
    """Arrays by planes of bytes, each compressed by itself: leading zeros and narrow ranges cost little."""
    frames = [zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1)[:, k]).tobytes(), 1) for a in arrays for k in range(a.itemsize)]
    return np.array([len(f) for f in frames], np.uint32).tobytes() + b"".join(frames)


def _unplaned(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    lengths = np.frombuffer(data, np.uint32, sum(sizes)).tolist()
    out, at, plane = [], 4 * sum(sizes), 0
    for kind, size in zip(kinds, sizes):
        planes = []
        for n in lengths[plane : plane + size]:
            planes.append(np.frombuffer(zstandard.decompress(data[at : at + n]), np.uint8))
            at += n
        plane += size
        out.append(np.ascontiguousarray(np.stack(planes, 1)).view(kind).ravel())
    return out


def _packer(sent):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Words = sent.value
        task, row = TaskContext.get().partitionId() << 40, 0

        def packet(ids: list, body: list[bytes], held: list[bool]) -> Iterator[pa.RecordBatch]:
            nonlocal row
            docs = len(body)
            uid = task | row
            row += docs
            # training texts first, so that a text's number tells its side
            turn = sorted(range(docs), key=lambda k: held[k])
            ids, body, cut = [ids[k] for k in turn], [body[k] for k in turn], docs - sum(held)
            hash_parts, count_parts = [], []
            for part in by_bytes(body, SLICE):
                hashes, _, _, counts = hashing.words([t.lower() for t in body[part]])
                hash_parts.append(hashes)
                count_parts.append(counts)
            counts = np.concatenate(count_parts)
            names, after = np.unique(edged(np.concatenate(hash_parts), counts), return_inverse=True)
            del hash_parts
            before, second = preceding(after, counts, int(np.searchsorted(names, EDGE)))
            owners = np.repeat(np.arange(docs, dtype=np.uint16), counts + 1)
            size = len(names)
            key = after * size + before
            del after, before
            pairs = None
            if size >= 1 << 21:  # three numbers don't fit into 64 bits
                pairs, key = np.unique(key, return_inverse=True)
            key = key * size + second
            del second
            order = np.argsort(key, kind="stable")
            key, owners = key[order], owners[order]
            del order
            # a triple of a document once, with the times that it occurs
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owners[1:] != owners[:-1])))
            times = np.diff(new, append=len(key)).astype(np.uint32)
            key, owners = key[new], owners[new]
            del new
            second, key = (key % size).astype(np.int32), key // size
            key = key if pairs is None else pairs[key]
            word, before = (key // size).astype(np.int32), (key % size).astype(np.int32)
            del key
            # frequent triples are scored here
            place = found(v.hot, names)
            often2 = v.frequent(2, place[before], place[word])
            often3 = v.frequent(3, place[second], place[before], place[word])
            here = np.flatnonzero(often3 >= 0)
            c1, c2, c3 = v.hot_n[place[word[here]]], v.often[2][1][often2[here]], v.often[3][1][often3[here]]
            weight = np.where(names[word[here]] == EDGE, v.weight(v.texts, v.texts), v.weight(c2, c1))
            sums = [np.zeros(docs, np.int64) for _ in range(3)]
            for own, x in zip(sums, ((v.level3(c3, c2, c1) + weight) / UNIT, v.base(c1) / UNIT, c1 > 0)):
                np.add.at(own, owners[here], np.rint(x).astype(np.int64) * times[here])
            blank, numbers = np.array([i is None for i in ids]), np.array([i or 0 for i in ids], np.int64)
            about = _packed(numbers, (counts + 1).astype(np.int64), *sums, blank, np.arange(docs) >= cut)
            yield _rows(_PACK, shard=[uid % v.shards], kind=[DOCS], uid=[uid], data=[about])
            if len(here):
                rest = np.flatnonzero(often3 < 0)
                word, before, second, owners, times, often2 = (x[rest] for x in (word, before, second, owners, times, often2))
            key = names[word]
            pair = hashing.final(hashing.final(key + np.uint64(1)) ^ names[before])
            key = np.where(place[word] >= 0, pair, key)
            key = np.where(often2 >= 0, hashing.final(pair ^ names[second]), key)
            shard = (key % np.uint64(v.shards)).astype(np.int64)
            del key, pair, often2, often3
            order = np.argsort(shard.astype(np.uint16) if v.shards < 1 << 16 else shard, kind="stable")
            edges = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=v.shards))))
            del shard
            out = []
            for s in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[s] : edges[s + 1]]
                heads, run = np.unique(word[own], return_counts=True)
                priors, at = np.unique(np.concatenate((before[own], second[own])), return_inverse=True)
                steps = [np.diff(x, prepend=np.uint64(0)) for x in (names[heads], names[priors] >> SHORT)]
                at = at.astype(np.uint32)
                out.append((s, _planed(np.array([cut], np.uint32), *steps, run.astype(np.uint32), at[: len(own)], at[len(own) :], times[own], owners[own])))
                if len(out) == 16:
                    yield _rows(_PACK, shard=[x for x, _ in out], kind=[TRIGRAMS] * 16, uid=[uid] * 16, data=[x for _, x in out])
                    out = []
            if out:
                yield _rows(_PACK, shard=[x for x, _ in out], kind=[TRIGRAMS] * len(out), uid=[uid] * len(out), data=[x for _, x in out])

        ids, body, held, size = [], [], [], 0
        for batch in batches:
            for doc_id, out_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, 2)):
                ids.append(doc_id)
                held.append(out_)
                body.append(text)
                size += len(text)
                if size >= PACKET or len(ids) == 1 << 16:
                    yield from packet(ids, body, held)
                    ids, body, held, size = [], [], [], 0
        if ids:
            yield from packet(ids, body, held)

    return pack


def _tabled(shards: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = (np.array(batch.column(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
            shard = (key.view(np.uint64) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            full = np.flatnonzero(np.diff(edges)).tolist()
            data = [_packed(key[order[edges[s] : edges[s + 1]]], n[order[edges[s] : edges[s + 1]]]) for s in full]
            yield _rows(_PACK, shard=full, kind=[TABLE] * len(full), uid=[0] * len(full), data=data)

    return pack


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += out[-1].nbytes
    return out


def _triples(data: bytes) -> list:
    """Of a packet's triples in one shard, sorted by (word, before, second): words, first row of each and the last one's end, other words, places
    of before and second among these, times, documents that occur, places among these, and the number of training documents."""
    cut, words, others, run, before, second, times, owner = _unplaned(data, "u4", "u8", "u8", "u4", "u4", "u4", "u4", "u2")
    docs, owner = np.unique(owner, return_inverse=True)
    return [np.cumsum(words), np.concatenate(([0], np.cumsum(run, dtype=np.int64))), np.cumsum(others), before, second, times, docs, owner.astype(np.uint16), int(cut[0])]


def _scorer(sent):
    def solve(v: Words, packets: dict[int, list[tuple[int, bytes]]]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(d, "i8", "i8") for _, d in packets.pop(TABLE, [])]
        key = np.concatenate([p[0].view(np.uint64) for p in parts]) if parts else np.zeros(0, np.uint64)
        order = np.argsort(key)
        key, count = key[order], np.concatenate([p[1] for p in parts])[order] if parts else np.zeros(0, np.int64)
        cells = [(uid, _triples(d)) for uid, d in packets.pop(TRIGRAMS, [])]
        if not cells:
            return
        heads, where = np.unique(np.concatenate([c[0] for _, c in cells]), return_inverse=True)
        rows = np.cumsum(np.bincount(where, np.concatenate([np.diff(c[1]) for _, c in cells])))
        c1 = np.zeros(len(heads), np.int64)
        for keys, n in ((key, count), (v.hot, v.hot_n)):
            at = found(keys, heads)
            c1 = np.maximum(c1, np.where(at >= 0, n[at] if len(n) else 0, 0))
        del key, count, order, parts, where
        sums = [np.zeros((3, len(c[6])), np.int64) for _, c in cells]
        first = np.flatnonzero(np.diff(rows // RANGE, prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(heads)]):
            _range(v, [c for _, c in cells], sums, heads[a:b], c1[a:b])
        for (uid, c), own in zip(cells, sums):
            yield _rows(_PART, uid=[uid], kind=[TRIGRAMS], data=[_planed(*own, c[6])])

    def _range(v: Words, cells: list, sums: list[np.ndarray], words: np.ndarray, c1: np.ndarray) -> None:
        """Add what the rows of ``words`` give to the sums of each cell's documents."""
        parts = []
        for heads, edge, other, before, second, times, _, owner, cut in cells:
            lo, hi = np.searchsorted(heads, words[0]), np.searchsorted(heads, words[-1], side="right")
            own = slice(edge[lo], edge[hi])
            number = np.repeat(np.searchsorted(words, heads[lo:hi]), np.diff(edge[lo : hi + 1]))
            parts.append((number, other, before[own], second[own], times[own], owner[own]))
        others = np.unique(np.concatenate([p[1][np.unique(np.concatenate(p[2:4]))] for p in parts]))
        ids = len(others)
        pair, second = [], []
        for number, other, before, before2, _, _ in parts:
            at = np.searchsorted(others, other)
            pair.append(number * ids + at[before])
            second.append(at[before2].astype(np.int32))
        times = np.concatenate([p[4] for p in parts])
        learned = times * np.concatenate([c[6][p[5]] < c[8] for c, p in zip(cells, parts)])
        pair, of_pair = np.unique(np.concatenate(pair), return_inverse=True)
        c2 = np.bincount(of_pair, learned, len(pair)).astype(np.int64)
        triple, of_triple = np.unique(of_pair * ids + np.concatenate(second), return_inverse=True)
        del of_pair, second
        c3 = np.bincount(of_triple, learned, len(triple)).astype(np.int64)
        del learned
        if len(v.often[2][1]):  # pairs dealt over several shards have their whole count from the list
            at = v.frequent(2, found(v.hot >> SHORT, others)[pair % ids], found(v.hot, words)[pair // ids])
            c2 = np.where(at >= 0, v.often[2][1][at], c2)
        parent, second = triple // ids, triple % ids
        seen2, seen3 = np.flatnonzero(c2), np.flatnonzero(c3)
        trie = Trie(c1, pair[seen2], c2[seen2], np.searchsorted(seen2, parent[seen3]) * ids + second[seen3], c3[seen3], ids, v, int(found(words, np.array([EDGE]))[0]))
        del seen2, seen3, c2, c3, triple
        score = np.rint(trie.score(pair, parent, second) / UNIT).astype(np.int64)
        del trie, second
        word = (pair // ids)[parent]
        del pair, parent
        base, known = np.rint(v.base(c1) / UNIT).astype(np.int64), (c1 > 0).astype(np.int64)
        begin = 0
        for own, (*_, t, owner) in zip(sums, parts):
            which = of_triple[begin : begin + len(t)]
            begin += len(t)
            for k, x in enumerate((score[which], base[word[which]], known[word[which]])):
                np.add.at(own[k], owner, x * t)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Words = sent.value
        now, packets = None, {}
        for batch in batches:
            for shard, kind, uid, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == DOCS:
                    yield _rows(_PART, uid=[uid], kind=[DOCS], data=[data])
                    continue
                if shard != now:
                    yield from solve(v, packets)
                    now, packets = shard, {}
                packets.setdefault(kind, []).append((uid, data))
        yield from solve(v, packets)

    return score


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by packet, its documents first; yields a row per document."""

    def close(about: list[np.ndarray], total: np.ndarray) -> pa.RecordBatch:
        numbers, tokens, blank, held = about
        ids = pa.array(numbers, pa.int64(), mask=blank)
        return _rows(_ROW, doc_id=ids, held_out=held, n_tokens=tokens, n_known=total[2], base_score=total[1] * UNIT, score=total[0] * UNIT)

    about, total = None, None
    for batch in batches:
        for _, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == DOCS:
                if about:
                    yield close(about, total)
                numbers, tokens, *sums, blank, out = _unpacked(data, "i8", "i8", "i8", "i8", "i8", "?", "?")
                about, total = [numbers, tokens, blank, out], np.array(sums)
            else:
                *sums, owner = _unplaned(data, "i8", "i8", "i8", "u2")
                total[:, owner] += np.array(sums)
    if about:
        yield close(about, total)


def _hashes(frame) -> np.ndarray:
    return frame["hash"].to_numpy(np.int64).view(np.uint64)


def _learned(rows: DataFrame) -> tuple[Words, DataFrame]:
    """The model's sizes and frequent n-grams, and the counts of training words (hash, n)."""
    spark = rows.sparkSession
    texts_in = rows.select((~F.col("held_out")).alias("train"), "text")
    counted = texts_in.mapInArrow(_count, COUNT)
    counts = written(counted.groupBy("kind", "hash").agg(F.sum("n").alias("n"), F.sum("held").alias("held")), "counts")
    totals = {r.kind: (r.n, r.rows) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("rows")).collect()}
    texts, tokens = (totals.get(k, (0, 0))[0] for k in (1, 2))
    n, v = totals.get(0, (0, 0))[0] + texts, totals.get(0, (0, 0))[1] + (texts > 0)
    words = counts.filter("kind = 0 and n > 0").select("hash", "n")
    shards = max(8, tokens // SHARD)
    # at most four n-grams of an order to a shard
    frequent = F.col("n") + F.col("held") > max(1.0, tokens / shards / 4)
    hot = counts.filter("kind = 0").filter(frequent).select("hash", "n").toPandas()
    made = Words(texts, n, v, shards, _hashes(hot), hot["n"].to_numpy(np.int64))
    for order in (2, 3):
        often = texts_in.mapInArrow(_count_often(spark.sparkContext.broadcast(made), order), COUNT).groupBy("hash").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
        often = often.filter(frequent).select("hash", "n").toPandas().sort_values("hash")
        made.often[order] = often["hash"].to_numpy(np.int64), often["n"].to_numpy(np.int64)
        if not len(often):
            break
    return made, words


def score(docs: DataFrame, learn) -> DataFrame:
    """Scores of all ``docs``, learning from those whose doc_id meets ``learn``."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~learn(F.col("doc_id"))).alias("held_out"), "text")
    made, words = _learned(rows)
    shards = made.shards
    sent = spark.sparkContext.broadcast(made)
    packets = rows.mapInArrow(_packer(sent), PACK).unionByName(words.mapInArrow(_tabled(shards), PACK))
    parts = packets.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_scorer(sent), PART)
    found = parts.repartition("uid").sortWithinPartitions("uid", "kind").mapInArrow(_gather, ROW)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(made.n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), lambda i: split_of(i, 7) != 2)
