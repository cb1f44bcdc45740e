"""JSON objects inside free text, and recognised pieces put together to words."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare

FOUND = T.StructType([T.StructField("body", T.StringType()), T.StructField("reason", T.StringType())])
RECT = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x0", "y0", "x1", "y1")])
PIECES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("bbox", RECT)]))


def object_in(text: str | None) -> tuple[str | None, str | None]:
    """The first whole JSON object of a text, fenced or not, and else why there is none: ``empty``, ``no object``, ``cut`` (an object was going on when the text ended)
    or ``not JSON``. Braces in strings are the decoder's business; a brace that opens no object is passed over, so prose may have some."""
    if text is None or not text.strip():
        return None, "empty"
    at, reason, end = text.find("{"), "no object", len(text.rstrip())
    while at >= 0:
        try:
            return text[at : _DECODER.raw_decode(text, at)[1]], None
        except RecursionError:
            return None, "not JSON"
        except json.JSONDecodeError as e:
            rest = text[e.pos : end]
            if e.pos >= end or e.msg.startswith("Unterminated string") or any(x.startswith(rest) for x in ("true", "false", "null")):
                return None, "cut"
            reason = "not JSON"
        at = text.find("{", at + 1)
    return None, reason


_DECODER = json.JSONDecoder()


def answer_body(text: Column) -> Column:
    """``body`` and ``reason`` of an answer: the JSON object in it, whatever stands around it."""
    prepare(SparkSession.active())
    return _answer_body(text)


@F.pandas_udf(FOUND)
def _answer_body(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([object_in(t) for t in texts], columns=["body", "reason"])


def parsed_answer(text: Column, schema: str, required: list[str]) -> Column:
    """``value`` of an answer by ``schema`` and ``reason`` if it has none: those of ``answer_body``, or ``schema`` with the first required field that is missing or
    of another type. Fields that the schema doesn't have are ignored."""
    found = answer_body(text)
    value = F.from_json(found["body"], schema)
    missing = F.lit(None).cast("string")
    for name in reversed(required):
        missing = F.when(value[name].isNull(), F.lit(f"schema: {name}")).otherwise(missing)
    reason = F.coalesce(found["reason"], missing)
    return F.struct(F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def regrouped(text: str | None, pieces: list[dict] | None) -> list[dict] | None:
    """Consecutive pieces merged to the words of ``text`` with the union of their rectangles; None unless they spell the words exactly.

    An empty piece belongs to the word that follows it, so one after the last word fits nothing.
    """
    out, k = [], 0
    pieces = list(pieces) if pieces is not None else []
    for word in (text or "").split():
        begin, length = k, 0
        while k < len(pieces) and length < len(word):
            length += len(pieces[k]["text"])
            k += 1
        own = pieces[begin:k]
        if not own or "".join(p["text"] for p in own) != word:
            return None
        rects = [p["bbox"] for p in own]
        out.append({"text": word, "bbox": {c: (min if c.endswith("0") else max)(r[c] for r in rects) for c in ("x0", "y0", "x1", "y1")}})
    return out if k == len(pieces) else None


def regroup_words(text: Column, pieces: Column) -> Column:
    """``regrouped`` in Arrow batches, null where the pieces don't fit; null texts have no words."""
    prepare(SparkSession.active())
    return _regroup(text, pieces)


def _placed(words: list[str], lengths: np.ndarray, whole: str) -> np.ndarray | None:
    """Where the pieces of each word begin, by the lengths of the pieces and their joined text; None unless they spell the words. Empty pieces belong to the word that follows."""
    if "".join(words) != whole or not words and len(lengths):
        return None
    ends = np.cumsum(lengths)
    upto = np.searchsorted(ends, np.cumsum([len(w) for w in words]))  # the first piece that reaches a word's end
    if not words:
        return upto
    if upto[-1] != len(ends) - 1 or (ends[upto] != np.cumsum([len(w) for w in words])).any():
        return None
    return np.concatenate(([0], upto[:-1] + 1))


#: Pieces of a slice of a batch, at most, but one row at least: what a worker holds beside the batch itself.
SLICE = 100_000


@F.arrow_udf(PIECES)
def _regroup(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Pieces stay in flat Arrow columns: only words are Python strings, those of one slice at a time."""
    for texts, pieces in parts:
        begin = 0
        while begin < len(texts):
            sizes = np.cumsum(np.fromiter((x or 0 for x in pc.list_value_length(pieces.slice(begin)).to_pylist()), np.int64))
            n = max(1, int(np.searchsorted(sizes, SLICE, "right")))
            yield _regrouped(texts.slice(begin, n), pieces.slice(begin, n))
            begin += n


def _regrouped(texts: pa.Array, pieces: pa.Array) -> pa.Array:
    flat = pieces.flatten()
    lengths = pc.utf8_length(flat.field("text")).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
    rects = {c: flat.field("bbox").field(c).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int32) for c in RECT.names}
    out: dict[str, list] = {c: [] for c in RECT.names}
    named: list[str] = []
    offsets, fits, at = [0], [], 0
    for text, n in zip(texts.to_pylist(), pc.list_value_length(pieces).to_pylist()):
        n = n or 0
        words, own = (text or "").split(), slice(at, at + n)
        starts = _placed(words, lengths[own], "".join(flat.field("text").slice(at, n).to_pylist()) if n else "")
        if starts is not None and len(starts):
            for c in RECT.names:
                out[c].append((np.minimum if c.endswith("0") else np.maximum).reduceat(rects[c][own], starts))
            named += words
        fits.append(starts is not None)
        offsets.append(len(named))
        at += n
    columns = [pa.array(np.concatenate(out[c]) if out[c] else [], pa.int32()) for c in RECT.names]
    values = pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.StructArray.from_arrays(columns, RECT.names)], ["text", "bbox"])
    return pa.ListArray.from_arrays(pa.array([o if f else None for o, f in zip(offsets, [*fits, True])], pa.int32()), values)
