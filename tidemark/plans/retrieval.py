"""Search queries over the driver's text tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search as op
from ..operators.matching import containing
from .common import table

QUERY = 'idiot license "of the"'


def document_nodes(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("string").alias("node_id"), F.lit("d").alias("video_id"), F.lit("frame").alias("level"), F.col("doc_id").cast("int").alias("ordinal"),
        F.lit(0.0).alias("t_start"), F.lit(0.0).alias("t_end"), F.array("source").alias("apps"), F.coalesce("text", F.lit("")).alias("text"),
    )


def _top(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    scored = op.Scan(document_nodes(table(spark, sf_dir, "documents"))).bm25(QUERY, tokenizer)
    scored = scored.select(F.col("node_id").cast("long").alias("doc_id"), F.round("score", 5).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(20)


def search_bm25_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "word")


def search_bm25_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "trigram")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = op.Scan(document_nodes(table(spark, sf_dir, "documents")))
    parts = []
    for tokenizer in op.TOKENIZERS:
        scored = index.bm25(QUERY, tokenizer).withColumn("score", F.round("score", 5)).withColumn("id", F.col("node_id").cast("long"))
        best = scored.orderBy(F.desc("score"), "id").limit(op.K)
        parts.append(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))))  # over the K best
    return op.rrf(parts[0].unionByName(parts[1]).select("node_id", "rank"))


def search_rrf_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select(F.col("node_id").cast("long").alias("doc_id"), F.round("score", 5).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text table is a level."""
    docs, pages, talks, bench = (table(spark, sf_dir, t) for t in ("documents", "pages", "conversations", "benchmark"))
    made = [
        docs.select(F.concat(F.lit("d"), "doc_id").alias("node_id"), F.lit("frame").alias("level"), "text"),
        pages.select(F.concat(F.lit("p"), "page_id").alias("node_id"), F.lit("transition").alias("level"), F.col("html").alias("text")),
        talks.select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("node_id"), F.lit("lifetime").alias("level"), "text"),
        bench.select(F.concat(F.lit("b"), "item_id").alias("node_id"), F.lit("chapter").alias("level"), "text"),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.select("node_id", F.lit("all").alias("video_id"), "level", F.lit(None).cast("int").alias("ordinal"), F.lit(0.0).alias("t_start"), F.lit(0.0).alias("t_end"), F.array().cast("array<string>").alias("apps"), F.coalesce("text", F.lit("")).alias("text"))


class Rounded(op.Scan):
    """Scores to six places, so that ties are ties in any engine."""

    def bm25(self, query: str, tokenizer: str) -> DataFrame:
        return super().bm25(query, tokenizer).withColumn("score", F.round("score", 6))


def search_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Rounded(all_nodes(spark, sf_dir))
    return op.search(index, QUERY, collapse=False).select("node_id", "level", "family", "score")


def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    nodes = talks.select(
        F.concat("conv_id", F.lit("-"), "turn").alias("node_id"), F.col("conv_id").cast("string").alias("video_id"), F.lit("lifetime").alias("level"), F.col("turn").cast("int").alias("ordinal"),
        F.col("turn").cast("double").alias("t_start"), F.col("turn").cast("double").alias("t_end"), F.array("role").alias("apps"), F.coalesce("text", F.lit("")).alias("text"),
    )
    index = Rounded(nodes)
    return op.search(index, "the and", collapse=False, t_from=1.0, t_to=5.0, app="ASSIST").select("node_id", "score", "t_start")


def search_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as frames of their conversation, with their words as boxes: neighbours that hold the same words with a term are one hit."""
    talks = table(spark, sf_dir, "conversations")
    t = F.col("turn").cast("double")
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))))
    nodes = talks.select(
        F.concat("conv_id", F.lit("-"), "turn").alias("node_id"), F.col("conv_id").cast("string").alias("video_id"), F.lit("frame").alias("level"), F.col("turn").cast("int").alias("ordinal"),
        t.alias("t_start"), (t + 1).alias("t_end"), F.array("role").alias("apps"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(words, F.array().cast("array<string>")).alias("boxes"),
    )
    return op.search(Rounded(nodes), "and ich", limit=40).select("node_id", "score", "members", "t_end", F.array_join("member_ids", ",").alias("ids"))


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word query through an index of postings instead of a scan."""
    scored = op.Index.build(document_nodes(table(spark, sf_dir, "documents"))).bm25(QUERY, "word")
    return scored.select(F.col("node_id").cast("long").alias("doc_id"), F.round("score", 5).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def search_matched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.lower("text").contains("license") | F.lower("text").contains("idiot"))
    found = docs.select("doc_id", tx.matched_lines(F.col("text"), ["license", "Idiot"]).alias("m"))
    return found.select("doc_id", F.md5(F.col("m").cast("binary")).alias("matched_md5"), F.length("m").cast("long").alias("matched_chars"))


def search_collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").filter(F.lower("text").contains("the"))
    hits = talks.select("conv_id", F.col("turn").cast("long").alias("ordinal"), F.col("role").alias("key"))
    runs = op.collapse_runs(hits, ["conv_id"], "key")
    return runs.groupBy("conv_id", "run").agg(F.count("*").alias("members"), F.max("ordinal").alias("last"))


def hybrid_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.agg(F.min_by("embedding", "vec_id").alias("query"))  # one row
    near = op.knn(vectors.crossJoin(F.broadcast(query)), F.col("query"), 50, "vec_id").select("vec_id", "label", F.round("distance", 5).alias("distance"))
    return near.filter(F.col("label").isNotNull()).select("vec_id", "distance", F.col("label").cast("string").alias("label"))


def doc_norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(tx.norm(F.coalesce("text", F.lit(""))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    top = texts.orderBy(F.desc("n"), "t").limit(20).select(F.md5(F.col("t").cast("binary")).alias("text_md5"), "n")
    total = texts.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.count_if(F.col("n") > 1).alias("n_repeated"))
    return top.crossJoin(F.broadcast(total)).withColumn("ratio", F.round(F.col("n_rows") / F.col("n_distinct"), 3))


def bench_findability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, by normalised text."""
    items = table(spark, sf_dir, "benchmark").select("item_id", tx.norm(F.coalesce("text", F.lit(""))).alias("item")).filter(F.length(F.regexp_replace("item", " ", "")) >= 4)
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.norm(F.coalesce("text", F.lit(""))).alias("t"))
    hits = containing(docs, items, "t", "item").groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return items.join(hits, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "first_doc")


def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in documents and pages: text that looks like them is rare, so every text gets a head of its own ids."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.coalesce("html", F.lit("")).alias("t"))
    texts = docs.unionByName(pages).select("id", F.concat(F.lit("Frame "), F.length("t"), F.lit(" 12:b4 L3 T7 12:b4 "), "t").alias("t"))
    found = texts.select("id", tx.citations(F.col("t")).alias("c"))
    return found.select("id", F.size("c").cast("long").alias("n"), F.array_join("c", ",").alias("refs"))


_BM25_WORDS = r"""
tok as (select doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}\-_./:\\]+') as w from documents),
wtf as (
  select doc_id, len(w) as dl, 0 as p, len(list_filter(w, lambda x: x = 'idiot')) as tf from tok
  union all select doc_id, len(w), 1, len(list_filter(w, lambda x: x = 'license')) from tok
  union all select doc_id, len(w), 2, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the')) from tok
)"""
_BM25_TRI = r"""
low as (select doc_id, lower(coalesce(text, '')) as t from documents),
ttf as (
  select doc_id, greatest(length(t) - 2, 0) as dl, p, ((length(t) - length(replace(t, q, ''))) // length(q)) as tf
  from low, (values (0, 'idiot'), (1, 'license'), (2, 'of the')) as terms(p, q)
)"""


def _bm25_sql(source: str, name: str, key: str = "doc_id", digits: int = 5) -> str:
    return f"""
{name}_df as (select p, count(*) filter (tf > 0) as df, count(*) as n, avg(dl) as mean from {source} group by p),
{name} as (
  select {key}, round(sum(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), {digits}) as score
  from {source} join {name}_df using (p) where tf > 0 group by {key}
)"""


SQL = {
    "search_bm25_words": f"with {_BM25_WORDS}, {_bm25_sql('wtf', 'w')} select doc_id, score from w order by score desc, doc_id limit 20",
    "search_index": f"with {_BM25_WORDS}, {_bm25_sql('wtf', 'w')} select doc_id, score from w order by score desc, doc_id limit 20",
    "search_bm25_trigram": f"with {_BM25_TRI}, {_bm25_sql('ttf', 't')} select doc_id, score from t order by score desc, doc_id limit 20",
    "search_rrf_fused": f"""with {_BM25_WORDS}, {_bm25_sql('wtf', 'w')}, {_BM25_TRI}, {_bm25_sql('ttf', 't')},
ranks as (
  select doc_id, row_number() over (order by score desc, doc_id) as r from w qualify r <= 20
  union all select doc_id, row_number() over (order by score desc, doc_id) as r from t qualify r <= 20
)
select doc_id, round(sum(1.0::double / (60 + r)), 5) as score from ranks group by doc_id order by score desc, doc_id limit 20""",
    "search_families": rf"""with nodes as (
  select 'd' || doc_id as node_id, 'frame' as level, 'frame' as family, coalesce(text, '') as text from documents
  union all select 'p' || page_id, 'transition', 'transition', coalesce(html, '') from pages
  union all select 'c' || conv_id || '-' || turn, 'lifetime', 'lifetime', coalesce(text, '') from conversations
  union all select 'b' || item_id, 'chapter', 'summary', coalesce(text, '') from benchmark
), tok as (select node_id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}\-_./:\\]+') as w from nodes),
wtf as (
  select node_id, len(w) as dl, 0 as p, len(list_filter(w, lambda x: x = 'idiot')) as tf from tok
  union all select node_id, len(w), 1, len(list_filter(w, lambda x: x = 'license')) from tok
  union all select node_id, len(w), 2, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the')) from tok
), {_bm25_sql('wtf', 'w', 'node_id', 6)}, low as (select node_id, lower(text) as t from nodes), ttf as (
  select node_id, greatest(length(t) - 2, 0) as dl, p, ((length(t) - length(replace(t, q, ''))) // length(q)) as tf
  from low, (values (0, 'idiot'), (1, 'license'), (2, 'of the')) as terms(p, q)
), {_bm25_sql('ttf', 't', 'node_id', 6)}, ranks as (
  select node_id, row_number() over (partition by family order by score desc, node_id) as r from w join nodes using (node_id) qualify r <= 20
  union all select node_id, row_number() over (partition by family order by score desc, node_id) as r from t join nodes using (node_id) qualify r <= 20
), fused as (select node_id, round(sum(1.0::double / (60 + r)), 5) as score from ranks group by node_id)
select node_id, level, family, score from fused join nodes using (node_id) order by score desc, family, node_id limit 20""",
    "search_filtered": rf"""with nodes as (select conv_id || '-' || turn as node_id, turn::double as t_start, role, coalesce(text, '') as text from conversations),
tok as (select node_id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}\-_./:\\]+') as w from nodes),
wtf as (
  select node_id, len(w) as dl, 0 as p, len(list_filter(w, lambda x: x = 'the')) as tf from tok
  union all select node_id, len(w), 1, len(list_filter(w, lambda x: x = 'and')) from tok
), {_bm25_sql('wtf', 'w', 'node_id', 6)}, low as (select node_id, lower(text) as t from nodes), ttf as (
  select node_id, greatest(length(t) - 2, 0) as dl, p, ((length(t) - length(replace(t, q, ''))) // length(q)) as tf from low, (values (0, 'the'), (1, 'and')) as terms(p, q)
), {_bm25_sql('ttf', 't', 'node_id', 6)}, wanted as (select * from nodes where t_start between 1 and 5 and lower(role) like '%assist%'), ranks as (
  select node_id, row_number() over (order by score desc, t_start, node_id) as r from w join wanted using (node_id) qualify r <= 50
  union all select node_id, row_number() over (order by score desc, t_start, node_id) as r from t join wanted using (node_id) qualify r <= 50
), fused as (select node_id, round(sum(1.0::double / (60 + r)), 5) as score from ranks group by node_id)
select node_id, score, t_start from fused join nodes using (node_id) order by score desc, t_start, node_id limit 50""",
    "search_collapsed": rf"""with nodes as (select conv_id || '-' || turn as node_id, conv_id as video, turn, coalesce(text, '') as text from conversations),
tok as (select node_id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}\-_./:\\]+') as w from nodes),
wtf as (
  select node_id, len(w) as dl, 0 as p, len(list_filter(w, lambda x: x = 'and')) as tf from tok
  union all select node_id, len(w), 1, len(list_filter(w, lambda x: x = 'ich')) from tok
), {_bm25_sql('wtf', 'w', 'node_id', 6)}, low as (select node_id, lower(text) as t from nodes), ttf as (
  select node_id, greatest(length(t) - 2, 0) as dl, p, ((length(t) - length(replace(t, q, ''))) // length(q)) as tf from low, (values (0, 'and'), (1, 'ich')) as terms(p, q)
), {_bm25_sql('ttf', 't', 'node_id', 6)}, hits as (select node_id from w union select node_id from t),
boxes as (select node_id, video, turn, list_filter(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))), lambda x: contains(x, 'and') or contains(x, 'ich')) as held,
  list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'and') or contains(lower(x), 'ich')) as lines, text from nodes join hits using (node_id)),
keys as (select node_id, video, turn, case when len(held) > 0 then ['boxes'] || held when len(lines) > 0 then ['lines'] || lines else ['lines'] || string_split(text, chr(10)) end as key from boxes),
starts as (select *, case when turn = lag(turn) over o + 1 and key = lag(key) over o then 0 else 1 end as fresh from keys window o as (partition by video order by turn)),
numbered as (select *, sum(fresh) over (partition by video order by turn rows unbounded preceding) as run from starts),
runs as (select node_id, turn, first_value(node_id) over (partition by video, run order by turn) as head from numbered),
both_ as (select 'w' as kind, node_id, score from w union all select 't', node_id, score from t),
best as (select kind, head, -score as s, turn, b.node_id, row_number() over (partition by kind, head order by -score, turn, b.node_id) as k from both_ b join runs r on r.node_id = b.node_id),
ranks as (select head, row_number() over (partition by kind order by s, turn, node_id) as r from best where k = 1 qualify r <= 40),
fused as (select head, round(sum(1.0::double / (60 + r)), 5) as score from ranks group by head),
sizes as (select head, count(*) as members, max(turn) + 1.0::double as t_end, string_agg(node_id, ',' order by turn) as ids, min(turn) as first from runs group by head)
select f.head as node_id, score, members, t_end, ids from fused f join sizes z on z.head = f.head order by score desc, first, f.head limit 40""",
    "search_matched_lines": """with lines as (
  select doc_id, list_filter(string_split(text, chr(10)), lambda l: contains(lower(l), 'license') or contains(lower(l), 'idiot')) as m
  from documents where contains(lower(text), 'license') or contains(lower(text), 'idiot')
)
select doc_id, md5(array_to_string(m, chr(10))) as matched_md5, length(array_to_string(m, chr(10)))::bigint as matched_chars from lines""",
    "search_collapse_runs": """with hits as (
  select conv_id, turn::bigint as turn, role, turn - row_number() over (partition by conv_id, role order by turn) as g
  from conversations where contains(lower(text), 'the')
)
select conv_id, min(turn) as run, count(*) as members, max(turn) as last from hits group by conv_id, role, g""",
    "hybrid_knn": """with q as (select embedding::double[] as e from embeddings order by vec_id limit 1), near as (
  select vec_id, label, round(list_distance(embedding::double[], e), 5) as distance from embeddings, q order by distance, vec_id limit 50
)
select vec_id, distance, label::varchar as label from near where label is not null""",
    "doc_norm_stats": r"""with t as (
  select trim(regexp_replace(translate(coalesce(text, ''), '“”‘’', '""'''''), '\s+', ' ', 'g')) as t, count(*) as n from documents group by 1
), total as (select sum(n)::bigint as n_rows, count(*) as n_distinct, count(*) filter (n > 1) as n_repeated from t),
top as (select md5(t) as text_md5, n from t order by n desc, t limit 20)
select text_md5, n, n_rows, n_distinct, n_repeated, round(n_rows::double / n_distinct, 3) as ratio from top, total""",
    "bench_findability": r"""with items as (
  select item_id, trim(regexp_replace(translate(coalesce(text, ''), '“”‘’', '""'''''), '\s+', ' ', 'g')) as item from benchmark
), docs as (select doc_id, trim(regexp_replace(translate(coalesce(text, ''), '“”‘’', '""'''''), '\s+', ' ', 'g')) as t from documents)
select item_id, count(doc_id) as n_docs, min(doc_id) as first_doc from items left join docs on contains(t, item)
where length(replace(item, ' ', '')) >= 4 group by item_id""",
    "citation_extract": r"""with texts as (
  select 'd' || doc_id as id, coalesce(text, '') as t from documents union all select 'p' || page_id, coalesce(html, '') from pages
), found as (
  select id, list_transform(regexp_extract_all('Frame ' || length(t) || ' 12:b4 L3 T7 12:b4 ' || t, '\b\d+:b\d+\b|\b[Ff]rame \d+\b|\b[LT]\d+\b'),
    lambda m: case when lower(m[1:6]) = 'frame ' then 'f' || m[7:] else m end) as c from texts
), firsts as (select id, list_filter(c, lambda x, i: list_position(c, x) = i) as c from found)
select id, len(c)::bigint as n, array_to_string(c, ',') as refs from firsts""",
}
QUERIES = {name: globals()[name] for name in SQL}
