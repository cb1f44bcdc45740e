"""From documents to packed sequences: quality, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next stage's
docs; all but the last give the columns of documents.

Null texts count as empty ones: they are scored like any text, are near duplicates of nothing but their copies, and go with the passages, since no text is
left of them. Repeated rows and equal texts are copies, of which one stays, that of the least doc_id (a null id only if the class has no other); other ties need no rule. Empty tables pass through
as empty ones. Extra columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, ngram_join, packing, quality, suffix
from tidemark.llm.common import forget, free_name, split_of, table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labels outside the held-out split."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", lambda i: split_of(i, 3) != 1)
    name = free_name(docs, "_quality")
    return quality.score(docs, model, name).filter(F.col(name) >= 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.one_of_each(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat; documents of which nothing is left go."""
    return suffix.deduplicated(docs, PASSAGE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, the last of a source cut to its budget."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs, packing.default_tokenizer())


#: Bytes from which a repeated string goes: under those of fifty words in nearly all texts.
PASSAGE = 200

STAGES = [
    ("quality", classify),
    ("near_duplicates", drop_near_duplicates),
    ("passages", drop_passages),
    ("mixing", mix),
    ("packing", pack),
]
#: Not expressible: trees, MinHash classes, suffix intervals and a tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if before is not source:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
