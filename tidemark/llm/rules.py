"""Quality rules as a bitmask ledger.

``measure`` reads every whole text once and returns exact measurements. ``ledger`` evaluates every rule
once on those measurements and stores the failures as bits of one long. Policies are versions: a policy
is a mask of rules, so applying, comparing or ablating policies reads the ledger only, never a text.

Null text: no words, so every count is 0 and the rule ``few_words`` fails. Empty table: empty ledger.
Repeated rows each get their own row. Columns besides id and text are not read, so they can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, prepare, table, texts_of

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
WINDOW = 8

#: name -> failure condition over the measurements. The position is the rule's bit: append only, never reorder.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "shouting": "4 * n_exclamations > n_words",
    "capitals": "2 * n_upper > word_chars",
    "duplicate_lines": "n_dup_lines > 3 and 10 * n_dup_lines > 3 * n_lines",
    "long_words": "word_chars > 30 * n_words",
    "few_types": "n_words >= 50 and 20 * n_types < n_words",
}
#: A policy is the set of rules that reject; versions stay so that old verdicts can be made again.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "shouting", "capitals", "duplicate_lines", "long_words", "few_types"),
}
CURRENT = "v2"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_exclamations long, n_upper long, n_lines long, n_types long"
_MIX = (np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur at least twice in ``words``, first occurrence included. Exact."""
    n = len(words)
    if n <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    for half in (1, 2, 4):  # ranks of 2, 4, then 8 words
        rank = np.unique(rank[:-half] * (rank.max() + 1) + rank[half:], return_inverse=True)[1]
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def _maybe_repeated(docs: list[list[bytes]]) -> set[int]:
    """Which of ``docs`` may have a window twice: hashes only rule out, ``repeat_words`` decides."""
    counts = np.array([len(d) for d in docs])
    words = [w for d in docs for w in d]
    if len(words) <= WINDOW:
        return set()
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = h ^ (h >> np.uint64(29))
    mixed = np.zeros(len(words) - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        mixed += h[j : j + len(mixed)] * _MIX[j]
    owner = np.repeat(np.arange(len(docs)), counts)
    inside = owner[: len(mixed)] == owner[WINDOW - 1 :]
    own = owner[: len(mixed)][inside]
    key = (mixed[inside] ^ (mixed[inside] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + own.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    return set(own[order[1:][same]].tolist())


def measure_texts(texts: list[bytes]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {f.split()[0]: [] for f in MEASURES.split(", ")}
    for part in by_bytes(texts):
        docs = [t.split() for t in texts[part]]
        maybe = _maybe_repeated(docs)
        for k, (text, words) in enumerate(zip(texts[part], docs)):
            solid = text.translate(None, SPACE)
            lines = [x for x in text.split(b"\n") if x.strip()]
            out["n_words"].append(len(words))
            out["word_chars"].append(len(solid.decode("utf-8", "replace")))
            out["n_symbols"].append(len(solid) - len(solid.translate(None, SYMBOLS)))
            out["n_dup_lines"].append(len(lines) - len(set(lines)))
            out["n_repeat_words"].append(repeat_words(words) if k in maybe else 0)
            out["n_exclamations"].append(solid.count(b"!"))
            out["n_upper"].append(len(solid) - len(solid.translate(None, UPPER)))
            out["n_lines"].append(len(lines))
            out["n_types"].append(len(set(words)))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = measure_texts(texts_of(batch, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in found.values())], ["doc_id", *found])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measurements per row of ``docs``; one pass, no shuffle."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measure, f"doc_id long, {MEASURES}")


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``failed``: bit k is set if rule k fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measured.withColumn("failed", mask)


def policy_mask(version: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[version])


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``kept``: no rule of the policy fails. Reads the ledger's bits only."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablation(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of the policy: rows it fails, and rows that only it rejects (kept again without it).

    Rows are first summed by distinct bit pattern (at most 2^rules of them), so the rule loop reads that
    small table; no text and no row of the ledger is read twice.
    """
    mask = policy_mask(version)
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("rows"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in enumerate(RULES) if mask >> k & 1]
    return (
        patterns.select("bits", "rows", F.explode(F.array(*rules)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("rows"))), F.lit(0)).alias("fails"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("rows"))), F.lit(0)).alias("only_this"),
        )
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(ledger(measure(table(spark, sf_dir, "documents"))))
    base = F.col("failed").bitwiseAND(F.lit(policy_mask("v1"))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


ORACLE_SQL = r"""
with base as (
  select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents
), words as (
  select row_id, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from base
), windows as (
  select row_id, pos, array_to_string(w[pos:pos+7], ' ') as win
  from (select row_id, w, unnest(range(1, len(w) - 6)) as pos from words where len(w) >= 8)
), again as (
  select row_id, pos from (select row_id, pos, count(*) over (partition by row_id, win) as n from windows) where n > 1
), covered as (
  select row_id, count(distinct pos + k) as n from again, range(0, 8) as r(k) group by row_id
), measured as (
  select words.row_id, doc_id, len(w)::bigint as n_words,
    length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words,
    length(regexp_replace(text, '[^!]', '', 'g'))::bigint as n_exclamations,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_upper,
    len(lines)::bigint as n_lines, len(list_distinct(w))::bigint as n_types
  from words left join covered on words.row_id = covered.row_id
), masked as (
  select *, (case when n_words < 20 then 1 else 0 end
    + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end
    + case when 10 * n_symbols > 3 * n_words then 4 else 0 end
    + case when 4 * n_exclamations > n_words then 8 else 0 end
    + case when 2 * n_upper > word_chars then 16 else 0 end
    + case when n_dup_lines > 3 and 10 * n_dup_lines > 3 * n_lines then 32 else 0 end
    + case when word_chars > 30 * n_words then 64 else 0 end
    + case when n_words >= 50 and 20 * n_types < n_words then 128 else 0 end)::bigint as failed
  from measured
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed
from masked
"""
