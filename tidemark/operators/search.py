"""Ranked retrieval: an inverted index over words and trigrams, BM25, families, fusion and run collapsing.

Nodes: node_id, video_id, level, ordinal (place of a frame among frames, null for other levels), t_start, t_end, apps, text.
The index is a table of postings (tokenizer, term, node_id, positions, length of the node) and one of statistics, built once. A query reads its own few terms
from it: the term filter reaches the scan, the rows that match it are the only ones shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF = 60
K, K_FILTERED = 20, 50
TOKENIZERS = ("word", "trigram")
FAMILIES = {"lifetime": "lifetime", "transition": "transition", "frame": "frame", "step": "summary", "section": "summary", "video": "summary", "chapter": "summary"}


def terms(query: str) -> list[str]:
    """Quoted phrases and runs of non-space."""
    return [a or b for a, b in re.findall(r'"([^"]+)"|(\S+)', query)]


def _tokens(term: str, tokenizer: str) -> list[str]:
    if tokenizer == "trigram":
        low = term.lower()
        return [low[i : i + 3] for i in range(len(low) - 2)]
    table = str.maketrans(tx.MARKED, tx.PLAIN)
    return re.findall(r"(?:[^\W_]|[-_./:\\])+", term.lower().translate(table))


@dataclass
class Index:
    postings: DataFrame
    stats: DataFrame
    nodes: DataFrame

    @staticmethod
    def build(nodes: DataFrame) -> Index:
        """Lazily; ``save`` stores it. A posting carries its node's length, so that a query reads its terms' postings and two rows of statistics."""
        parts = []
        for name, of in (("word", tx.words), ("trigram", tx.trigrams)):
            tokens = spread(nodes).select("node_id", of(F.col("text")).alias("t"))
            parts.append(tokens.select(F.lit(name).alias("tokenizer"), "node_id", F.size("t").alias("dl"), F.posexplode("t").alias("position", "term")))
        flat = parts[0].unionByName(parts[1])
        postings = flat.groupBy("tokenizer", "term", "node_id").agg(F.array_sort(F.collect_list("position")).alias("positions"), F.first("dl").alias("dl"))
        sizes = nodes.select(F.size(tx.words(F.col("text"))).alias("word"), F.greatest(F.length(F.lower("text")) - 2, F.lit(0)).alias("trigram"))
        stats = sizes.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col(t).alias("dl")) for t in TOKENIZERS])).alias("s"))
        return Index(postings, stats.groupBy("s.tokenizer").agg(F.count("*").alias("n"), F.avg("s.dl").alias("mean")), nodes)

    def save(self, path: str, buckets: int = 16) -> None:
        """Postings lie in files by a hash of the term, sorted by term: a query's filters skip all other row groups."""
        dealt = self.postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        dealt.repartition("bucket").sortWithinPartitions("tokenizer", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "stats", "nodes")))

    def bm25(self, query: str, tokenizer: str) -> DataFrame:
        """node_id and score of every node that holds a term; statistics are over the whole index, before any filter.

        A term of several tokens is a phrase: its frequency is the number of places where its tokens stand in a row.
        """
        wanted = [t for x in terms(query) if (t := _tokens(x, tokenizer))]
        if not wanted:
            return self.nodes.select("node_id", F.lit(0.0).alias("score")).limit(0)
        rows = [(p, i, token) for p, tokens in enumerate(wanted) for i, token in enumerate(tokens)]
        spark = self.nodes.sparkSession
        asked = F.broadcast(spark.createDataFrame(rows, "phrase int, place int, term string"))  # a query's own terms
        size = F.create_map(*[F.lit(x) for p, tokens in enumerate(wanted) for x in (p, len(tokens))])
        found = self.postings.filter((F.col("tokenizer") == tokenizer) & F.col("term").isin(sorted({r[2] for r in rows}))).join(asked, "term")
        found = found.select("phrase", "node_id", "dl", F.transform("positions", lambda p: p - F.col("place")).alias("starts"))
        hits = found.groupBy("phrase", "node_id").agg(F.collect_list("starts").alias("all"), F.first("dl").alias("dl"))
        hits = hits.filter(F.size("all") == size[F.col("phrase")])
        same = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.col("all")[0], lambda acc, x: F.array_intersect(acc, x))
        hits = hits.withColumn("tf", F.size(same)).filter("tf > 0").select("phrase", "node_id", "tf", "dl")
        per = hits.groupBy("phrase").agg(F.count("*").alias("df"))
        total = self.stats.filter(F.col("tokenizer") == tokenizer).select("n", "mean")  # one row
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
        scored = hits.join(F.broadcast(per), "phrase").crossJoin(F.broadcast(total))
        return scored.groupBy("node_id").agg(F.sum(idf * weight).alias("score"))


def _folding(token: str) -> list[str]:
    """Patterns of a folded token's characters that also find them with diacritics."""
    marked = {p: "".join(m for m, q in zip(tx.MARKED, tx.PLAIN) if q == p) for p in set(tx.PLAIN)}
    return [f"[{c}{marked[c]}]" if c in marked else re.escape(c) for c in token]


def _phrase(tokens: list[list[str]], between: str) -> str:
    """A pattern of whole tokens in a row. What precedes is looked at after the first character has matched, which few places do; all but that
    character is looked ahead at, so that overlapping phrases count."""
    first = tokens[0][0]
    rest = between.join("".join(t) for t in [tokens[0][1:], *tokens[1:]])
    return f"{first}(?<!{tx.TOKEN}{first})(?={rest}(?!{tx.TOKEN}))"


def _occurrences(text: Column, term: str) -> Column:
    """Places where ``term`` begins, overlapping ones too. A term that can't overlap itself is counted by what its removal takes away."""
    if any(term[k:] == term[:-k] for k in range(1, len(term))):
        return F.regexp_count(text, F.lit("(?=" + re.escape(term) + ")"))
    left = F.octet_length(F.replace(text, F.lit(term), F.lit("")))
    return ((F.octet_length(text) - left) / len(term.encode())).cast("int")


def spread(texts: DataFrame) -> DataFrame:
    """``texts`` dealt over all cores where their scan makes fewer than four tasks a core (small tables and such of few row groups leave cores idle); others stay as they are."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < 4 * cores else texts


@dataclass
class Scan:
    """The same scores without an index: one narrow pass over the texts counts a query's phrases. For texts that are searched once."""

    nodes: DataFrame

    def bm25(self, query: str, tokenizer: str) -> DataFrame:
        wanted = [t for x in terms(query) if (t := _tokens(x, tokenizer))]
        if not wanted:
            return self.nodes.select("node_id", F.lit(0.0).alias("score")).limit(0)
        low = F.lower("text")
        if tokenizer == "trigram":
            # a phrase of trigrams is the substring itself
            length = F.greatest(F.length(low) - 2, F.lit(0))
            counts = [_occurrences(low, t[0] + "".join(x[2] for x in t[1:])) for t in wanted]
        else:
            # diacritics are folded in the patterns, not in the texts
            length = F.regexp_count(low, F.lit(f"{tx.TOKEN}+"))
            other = f"[^{tx.TOKEN[1:-1]}]+"
            counts = [F.regexp_count(low, F.lit(_phrase([_folding(x) for x in t], other))) for t in wanted]
        counts = [c.alias(f"tf{k}") for k, c in enumerate(counts)]
        # what is counted moves once, as numbers, and serves both the statistics and the scores: the exchange is reused
        rows = spread(self.nodes).select("node_id", length.alias("dl"), *counts).repartition("node_id")
        found = [F.col(f"tf{k}") > 0 for k in range(len(wanted))]
        total = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *(F.count_if(x).alias(f"df{k}") for k, x in enumerate(found)))  # one row
        score = F.lit(0.0)
        for k, x in enumerate(found):
            idf = F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
            weight = F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
            score = score + F.when(x, F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * weight).otherwise(0.0)
        # a condition on both sides stays above the join, so that the sides' exchanges stay equal
        some = F.col("n") * F.greatest(*[F.col(f"tf{k}") for k in range(len(wanted))], F.lit(0)) > 0
        return rows.crossJoin(F.broadcast(total)).filter(some).select("node_id", score.alias("score"))


def filters(video_id: str | None = None, level: str | None = None, t_from: float | None = None, t_to: float | None = None, app: str | None = None) -> Column:
    """Conditions on nodes. Empty texts set no condition; times do unless None. ``app`` is part of an app's name, whatever its case."""
    out = F.lit(True)
    if video_id:
        out &= F.col("video_id") == video_id
    if level:
        out &= F.col("level") == level
    if t_from is not None:
        out &= F.col("t_end") >= t_from
    if t_to is not None:
        out &= F.col("t_start") <= t_to
    if app:
        out &= F.exists("apps", lambda a: F.contains(F.lower(a), F.lit(app.lower())))
    return out


def rrf(rankings: DataFrame, k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of (node_id, rank) rows."""
    return rankings.groupBy("node_id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


def ranked(scored: DataFrame, by: list[str], most: int | None, order: list[Column]) -> DataFrame:
    """Adds a rank from 1 inside ``by``; rows past ``most`` go while ranking."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if most is None else out.filter(F.col("rank") <= most)


def collapse_runs(hits: DataFrame, by: list[str], key: str, ordinal: str = "ordinal") -> DataFrame:
    """Adds ``run``: hits with neighbouring ordinals and an equal key are one run, named by its first ordinal."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    new = F.when((F.col(ordinal) != F.lag(ordinal).over(w) + 1) | (F.col(key) != F.lag(key).over(w)) | F.lag(ordinal).over(w).isNull(), 1).otherwise(0)
    hits = hits.withColumn("_run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return hits.withColumn("run", F.min(ordinal).over(Window.partitionBy(*by, "_run"))).drop("_run")


def search(index: Index | Scan, query: str, limit: int | None = None, collapse: bool = True, vector: DataFrame | None = None, **where) -> DataFrame:
    """Hits of all families fused: node_id, level, family, score (5 places), t_start, t_end, matched, members, member_ids.

    ``vector``: further ranked hits as (node_id, rank), fused with the others. With ``collapse``, neighbouring frames whose matched text is the same are one hit: their
    key is ``text.collapse_key`` of their boxes, the array column ``boxes`` of the nodes (where they have none, of their lines). The run is named by its earliest
    member, takes the best member's place in each ranking, and lasts from the first member to the last.

    A ranking is cut to its best while it is made: no task sees more than the best of each, but for the runs of one video's frames.
    """
    level = where.get("level")
    k = limit or (K_FILTERED if any(v is not None for v in where.values()) else K)
    family = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    nodes = index.nodes.filter(filters(**where)).withColumn("family", family[F.col("level")])
    if "boxes" not in nodes.columns:
        nodes = nodes.withColumn("boxes", F.lit(None).cast("array<string>"))
    if level and level not in FAMILIES:
        nodes = nodes.limit(0)
    asked = terms(query)
    scored = [index.bm25(query, t).withColumn("tokenizer", F.lit(t)) for t in TOKENIZERS]
    hits = scored[0].unionByName(scored[1]).join(nodes.select("node_id", "video_id", "family", "ordinal", "t_start", "t_end", "boxes", "text"), "node_id")
    order = [F.desc("score"), F.asc("t_start"), F.asc("node_id")]
    members = None
    if collapse:
        own = hits.filter("family = 'frame'").select("node_id", "video_id", "ordinal", "t_start", "t_end", "boxes", "text")
        if vector is not None:
            own = own.unionByName(nodes.filter("family = 'frame'").join(vector.select("node_id"), "node_id", "left_semi").select(*own.columns))
        key = tx.collapse_key(F.col("text"), F.coalesce("boxes", F.array().cast("array<string>")), asked)
        one = own.dropDuplicates(["node_id"]).withColumn("key", F.sha2(F.to_json(key), 256)).drop("boxes", "text")
        runs = collapse_runs(one, ["video_id"], "key")
        runs = runs.withColumn("head", F.min_by("node_id", "ordinal").over(Window.partitionBy("video_id", "run"))).select("node_id", "head", "ordinal", "t_end")
        heads = runs.select("node_id", "head")
        best = hits.filter("family = 'frame'").join(heads, "node_id").groupBy("tokenizer", "head").agg(F.min(F.struct((-F.col("score")).alias("s"), "t_start", "node_id")).alias("best"))
        frames = ranked(best, ["tokenizer"], k, [F.asc("best")]).select(F.col("head").alias("node_id"), "rank")
        others = ranked(hits.filter("family <> 'frame'"), ["family", "tokenizer"], k, order).select("node_id", "rank")
        rankings = others.unionByName(frames)
        if vector is not None:
            near = vector.select("node_id", "rank").join(heads, "node_id", "left").groupBy(F.coalesce("head", "node_id").alias("node_id")).agg(F.min("rank").alias("_rank"))
            rankings = rankings.unionByName(near.select("node_id", F.row_number().over(Window.partitionBy().orderBy("_rank", "node_id")).alias("rank")))  # k rows at most
        members = runs.groupBy(F.col("head").alias("node_id")).agg(F.count("*").alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "node_id"))), lambda x: x["node_id"]).alias("member_ids"), F.max_by("t_end", "ordinal").alias("_end"))
    else:
        rankings = ranked(hits, ["family", "tokenizer"], k, order).select("node_id", "rank")
        if vector is not None:
            rankings = rankings.unionByName(vector.select("node_id", "rank"))
    fused = rrf(rankings).withColumn("score", F.round("score", 5)).join(nodes.select("node_id", "level", "family", "t_start", "t_end", "text"), "node_id")
    place = F.array_position(F.array(*map(F.lit, dict.fromkeys(FAMILIES.values()))), F.col("family"))
    fused = fused.orderBy(F.desc("score"), place, "t_start", "node_id").limit(k)
    out = fused.withColumn("matched", tx.matched_lines(F.col("text"), asked)).drop("text")
    if members is None:
        return out.withColumn("members", F.lit(1).cast("long")).withColumn("member_ids", F.array("node_id"))
    out = out.join(members, "node_id", "left").withColumn("t_end", F.coalesce("_end", "t_end")).drop("_end")
    return out.withColumn("members", F.coalesce("members", F.lit(1)).cast("long")).withColumn("member_ids", F.coalesce("member_ids", F.array("node_id")))


def knn(vectors: DataFrame, query: Column, k: int, unique: str, embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest by Euclidean distance, ties by ``unique``; a top-k needs no full sort."""
    distance = F.sqrt(F.aggregate(F.zip_with(embedding, query, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return vectors.withColumn("distance", distance).orderBy("distance", unique).limit(k)
