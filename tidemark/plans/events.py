"""Queries on event, order and line tables: sequences, lifetimes, joins, roll-ups, evaluation, streams; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import lineage as ln
from ..operators import matching as mt
from ..operators import sequences as sq
from ..streaming import settle as st
from .common import seconds, table

HOUR = 3600.0


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("t", seconds(F.col("ts")))


def turn_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sq.transitions(_talks(spark, sf_dir), ["conv_id"], ["turn"], ["text"])
    kind = tx.kind_of(F.coalesce("prev_text", F.lit("")), F.coalesce("text", F.lit("")))
    return pairs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that a turn begins with as the turn before it of the same role did."""
    pairs = sq.transitions(_talks(spark, sf_dir), ["conv_id", "role"], ["turn"], ["text"])
    return pairs.select("conv_id", "turn", tx.lcp_len(F.coalesce("prev_text", F.lit("")), F.coalesce("text", F.lit(""))).cast("long").alias("n"))


def turn_char_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit scripts of consecutive turns, whole texts; both texts must come back from them."""
    pairs = sq.transitions(_talks(spark, sf_dir), ["conv_id"], ["turn"], ["text"])
    rows = pairs.select("conv_id", "turn", F.coalesce("prev_text", F.lit("")).alias("a"), F.coalesce("text", F.lit("")).alias("b"))
    rows = rows.withColumn("d", tx.char_diff("a", "b"))
    side = lambda op: F.array_join(F.transform(F.filter("d", lambda x: x["op"] != op), lambda x: x["text"]), "")
    return rows.select("conv_id", "turn", F.size("d").cast("long").alias("n_runs"), (side("+") == F.col("a")).alias("before_ok"), (side("-") == F.col("b")).alias("after_ok"))


def occurrence_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-th line of a ship mode in one order with the k-th in the next order of the customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = orders.select(F.col("o_orderkey").alias("left_key"), F.lead("o_orderkey").over(w).alias("right_key")).filter("right_key is not null")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("o"))
    left = lines.join(pairs, lines.l_orderkey == pairs.left_key).select("left_key", "right_key", "l_returnflag", "o")
    right = lines.join(pairs, lines.l_orderkey == pairs.right_key).select("left_key", "right_key", "l_returnflag", "o")
    found = mt.occurrence_pairs(left, right, ["left_key", "right_key", "l_returnflag"], "o")
    return found.groupBy("l_returnflag", "k").agg(F.count("*").alias("n"), F.sum(F.col("o_right") - F.col("o_left")).cast("long").alias("shift"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two consecutive orders of a customer, scored by how near their quantities are."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = orders.select(F.col("o_orderkey").alias("left_key"), F.lead("o_orderkey").over(w).alias("right_key")).filter("right_key is not null")
    # line numbers of an order can repeat: a number's quantities go together before the join, so that what it makes needs no aggregate
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.collect_set("l_quantity").alias("q"))
    left = lines.join(pairs, lines.l_orderkey == pairs.left_key).select("left_key", F.col("l_linenumber").alias("i"), F.col("q").alias("qa"), "right_key")
    right = lines.select(F.col("l_orderkey").alias("right_key"), F.col("l_linenumber").alias("j"), F.col("q").alias("qb"))
    nearest = F.array_max(F.transform("qa", lambda x: F.array_max(F.transform("qb", lambda y: 50 - F.abs(x - y)))))
    return left.join(right, "right_key").select("left_key", "i", "j", nearest.alias("area"))


def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.greedy_pairs(_candidates(spark, sf_dir), ["left_key"])


def mutual_best_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matching by rounds: pairs that are each other's best are taken until none is left."""
    return mt.mutual_best(_candidates(spark, sf_dir), ["left_key"]).select("left_key", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


def track_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots of a customer's lines: a line is a box whose place follows from part and quantity, its text is its part."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = orders.select(F.col("o_orderkey").alias("pair"), F.lead("o_orderkey").over(w).alias("next")).filter("next is not null")
    x, y = F.col("l_partkey") % 200 * 2, F.col("l_quantity").cast("int") * 4
    box = F.struct(x.cast("int").alias("x0"), y.alias("y0"), (x + 120).cast("int").alias("x1"), (y + 18).alias("y1"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("ordinal"), box.alias("bbox"), F.concat(F.lit("part "), F.col("l_partkey") % 50).alias("text"), (F.col("l_quantity") > 10).alias("touched"))
    a = lines.join(pairs, lines.l_orderkey == pairs.pair).select("pair", F.lit("a").alias("side"), "ordinal", "bbox", "text", "touched")
    b = lines.join(pairs, lines.l_orderkey == pairs.next).select("pair", F.lit("b").alias("side"), "ordinal", "bbox", "text", "touched")
    return mt.track(a.unionByName(b)).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("variant").alias("n_variants"))


def status_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sq.islands(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("sightings"))


def majority_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.majority(_events(spark, sf_dir), ["user_id"], "event_type", "event_id")


def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with errors of each user as runs of days."""
    days = _events(spark, sf_dir).filter("event_type = 'error'").select("user_id", F.floor(F.col("t") / 86400).cast("long").alias("day"))
    return sq.ranges(days, ["user_id"], "day")


def moves_and_flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: users who appeared, were removed or stayed since the day before."""
    days = _events(spark, sf_dir).select(F.floor(F.col("t") / 86400).cast("long").alias("day"), "user_id").distinct()
    before = days.select((F.col("day") + 1).alias("day"), "user_id", F.lit(1).alias("b"))
    both = days.withColumn("a", F.lit(1)).join(before, ["day", "user_id"], "full_outer")
    return both.groupBy("day").agg(F.count_if(F.col("b").isNull()).alias("appeared"), F.count_if(F.col("a").isNull()).alias("removed"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"))


def continues_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of event type whose earlier side is the later side of the change before, and of what kind that was."""
    pairs = sq.transitions(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_type"]).filter("event_type <> prev_event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    linked = pairs.withColumn("source", F.when(F.lag("event_type").over(w) == F.col("prev_event_type"), F.lag("event_id").over(w)))
    return linked.select("user_id", "event_id", "source")


def reverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.reverts(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type", "t").select("user_id", "event_id", F.round("hold", 3).alias("hold"))


def labels_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest label at or before each document of its source."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id").select("source", "doc_id", F.col("quality").cast("int").alias("quality"))
    return sq.asof(docs, labels, ["source"], "doc_id", ["quality"])


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of consecutive turns as two readings, of which one has a short token more; ``agreement_of_texts`` compares what was said."""
    pairs = sq.transitions(_talks(spark, sf_dir), ["conv_id"], ["turn"], ["role"])
    a, b = F.concat(F.col("role"), F.lit(" x")), F.col("prev_role")
    return pairs.groupBy("role", "prev_role").agg(F.count_if(tx.agreement(a, b)).alias("n_agree"), F.count("*").alias("n"))


def agreement_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of consecutive turns as two readings, by role."""
    pairs = sq.transitions(_talks(spark, sf_dir), ["conv_id"], ["turn"], ["role", "text"])
    agree = tx.agreement(F.coalesce("text", F.lit("")), F.coalesce("prev_text", F.lit("")))
    return pairs.groupBy("role", "prev_role").agg(F.count_if(agree).alias("n_agree"), F.count("*").alias("n"))


RULES = {"no_quantity": "l_quantity <= 0", "dear": "l_extendedprice > 90000", "free": "l_discount >= 0.1", "returned": "l_returnflag = 'R'", "late": "l_tax > 0.06"}


def repair_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.reason_counts(table(spark, sf_dir, "lineitem"), {k: F.expr(v) for k, v in RULES.items()})


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sq.islands(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "island").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetimes that meet the closed range of January 10th to 12th."""
    return _spans(spark, sf_dir).filter((F.col("t1") >= 1704844800.0) & (F.col("t0") <= 1705017600.0))


def range_join_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = spark.createDataFrame([(f"c{k + 1}", 1704067200.0 + 5 * 86400.0 * k, 1704067200.0 + 5 * 86400.0 * (k + 1) + 86400.0, k) for k in range(5)], "chapter string, start_s double, end_s double, pos int")
    found = sq.first_range(_events(spark, sf_dir).select("event_id", "t"), chapters, "t", "start_s", "end_s", "pos")
    return found.groupBy("chapter").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def parent_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer in steps of four; a step's first and last key, date and price."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    steps = table(spark, sf_dir, "orders").withColumn("step", F.floor((F.row_number().over(w) - 1) / 4).cast("long"))
    return sq.collapsed_ranges(steps, ["o_custkey", "step"], "o_orderkey", "o_orderkey")


def parents_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of four orders of a customer, and steps that begin two orders earlier: an order's parent is the step that holds it and begins last."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    k = F.row_number().over(w) - 1
    steps = orders.withColumn("ids", F.array(F.concat(F.lit("a"), F.floor(k / 4)), F.concat(F.lit("b"), F.floor((k + 2) / 4)))).select("o_custkey", "o_orderkey", F.explode("ids").alias("step"))
    spans = steps.groupBy("o_custkey", "step").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")).withColumn("place", F.col("first") * 2 + (F.substring("step", 1, 1) == "b").cast("int"))
    return sq.parents(orders, spans, ["o_custkey"], "o_orderkey", "first", "last", "place").select("o_custkey", "o_orderkey", "step", "first", "last")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    places = sq.windows_of(rows, ["o_custkey"], ["o_orderkey"], 6, 2)
    w = Window.partitionBy("o_custkey", "window").orderBy("place")
    starts = places.withColumn("_b", (F.col("place") == F.col("window_first")) | (F.lag("o_orderstatus").over(w) != F.col("o_orderstatus"))).filter("_b")
    return starts.select("o_custkey", "window", "window_first", "place", F.col("o_orderstatus").alias("label"))


def boundary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = sq.merged_boundaries(_votes(spark, sf_dir), ["o_custkey"], 2)
    return merged.select("o_custkey", F.col("place").cast("long").alias("place"), "votes", "label")


def _hierarchy(spark: SparkSession, sf_dir: str, *levels: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = orders.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by the schema
    return rows.rollup(*levels).agg(
        F.count("*").alias("n_orders"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.grouping_id().cast("long").alias("depth"),
    )


def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rolled up to nations, regions and all, with the range of keys below; one pass of grouping sets."""
    return _hierarchy(spark, sf_dir, "r_name", "n_name")


def hierarchy_of_all_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same down to customers and orders."""
    return _hierarchy(spark, sf_dir, "r_name", "n_name", "o_custkey", "o_orderkey")


#: Levels of nodes, from below: key, and what orders the lines of a node.
LEVELS = {
    "line": (["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"]),
    "order": (["l_orderkey"], ["l_orderkey", "l_linenumber"]),
    "customer": (["o_custkey"], ["l_orderkey", "l_linenumber"]),
    "nation": (["c_nationkey"], ["o_custkey", "l_orderkey", "l_linenumber"]),
}


def _nodes(spark: SparkSession, sf_dir: str, levels: list[str]) -> DataFrame:
    """Lines meet their order and customer once; a row for each level of a line then goes into one sum, made in the task first."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    at = []
    for name in levels:
        keys, order = LEVELS[name]
        item = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
        place = [F.lit(0)] * (3 - len(order)) + [F.col(c) for c in order]
        at.append(F.struct(F.lit(name).alias("level"), item.alias("item"), F.struct(*[c.cast("long").alias(f"o{k}") for k, c in enumerate(place)]).alias("o")))
    rows = lines.select("l_returnflag", F.explode(F.array(*at)).alias("at")).select("l_returnflag", "at.*")
    firsts = rows.groupBy("level", "item", "l_returnflag").agg(F.min("o").alias("o"), F.count("*").alias("n"))  # one row for each of a node's texts
    parts = F.array_sort(F.collect_list(F.struct("o", "l_returnflag")))
    nodes = firsts.groupBy("level", "item").agg(F.array_join(F.transform(parts, lambda p: p["l_returnflag"]), "\n").alias("text"), F.sum("n").alias("n"))
    return nodes.filter("text <> ''").groupBy("level", "text").agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n_lines"))


def nodes_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of two levels: lines into orders and into customers; texts are distinct return flags in order."""
    return _nodes(spark, sf_dir, ["order", "customer"])


def nodes_of_all_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of four levels: lines into orders into customers into nations; texts are distinct return flags in order."""
    return _nodes(spark, sf_dir, list(LEVELS))


def box_stability_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of consecutive events: unchanged, of which variants by value, and lost ones."""
    pairs = sq.transitions(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_type", "value"])
    same = F.col("event_type") == F.col("prev_event_type")
    counts = pairs.agg(F.count_if(same).alias("unchanged"), F.count_if(same & (F.abs(F.col("value") - F.col("prev_value")) > 50)).alias("variants"), F.count_if(~same).alias("lost"))
    return counts.withColumn("stability", F.round((F.col("unchanged") - F.col("variants")) / F.nullif(F.col("unchanged") + F.col("lost"), F.lit(0)), 4))


def low_half_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median value over the lower half by rank, per event type; events without a value come first."""
    e = _events(spark, sf_dir).select("event_type", "event_id", "value")
    ranked = sq.running(e, ["event_type"], ["value", "event_id"], F.col("value"), F.lit(1), "_before", "_all")
    ranked = sq.running(ranked, ["event_type"], ["value", "event_id"], F.col("value"), F.col("value").isNull().cast("int"), "_nulls_before", "_nulls")
    half = F.ceil(F.col("_all") / 2)
    known = half - F.least("_nulls", half)  # of the lower half, those with a value
    low = ranked.withColumn("_place", F.col("_before") + 1 - F.col("_nulls")).withColumn("_known", known).withColumn("_half", half)
    at = lambda k: F.max(F.when(F.col("_place") == k, F.col("value")))
    median = (at(F.floor((F.col("_known") + 1) / 2)) + at(F.floor(F.col("_known") / 2) + 1)) / 2
    return low.filter(F.col("_before") < F.col("_half")).groupBy("event_type").agg(F.round(median, 4).alias("median_low"), F.count("*").alias("n_low"))


PRICES = (("A", 3.0, 15.0), ("N", 1.0, 5.0))


def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as calls: return flag is the model (R has no price), quantity in, tax class out, ship mode stands for the stage."""
    prices = F.broadcast(spark.createDataFrame(PRICES, "model string, price_in double, price_out double"))  # a price list
    use = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_quantity") * 1000).alias("tokens_in"), (F.col("l_linenumber") * 100.0).alias("tokens_out"), (F.col("l_linestatus") == "O").alias("batch"), F.col("l_linestatus").alias("stage"))
    priced = ev.costs(use, prices, (2.0, 10.0))
    out = priced.rollup("stage", "model").agg(F.round(F.sum("dollars"), 4).cast("double").alias("dollars"), F.count("*").alias("n_calls"))
    return out.withColumn("per_1000_calls", F.round(F.col("dollars") / F.col("n_calls") * 1000, 4))


def paired_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as configs, quarters as repeats, line numbers as units, mean discount as the value."""
    lines = table(spark, sf_dir, "lineitem")
    cards = lines.groupBy(F.col("l_returnflag").alias("config"), F.quarter("l_shipdate").alias("repeat"), F.col("l_linenumber").alias("unit"))
    cards = cards.agg((F.sum(F.col("l_discount").cast("decimal(12,4)")) / F.count("*")).cast("double").alias("value"))
    return ev.compare_configs(cards)


def label_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as rubric lines of their document's source: quality is demanded, toxic is banned when it is the majority's."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    label = ev.label_from(F.col("quality") == 1, (F.col("toxic") == 1) & (F.col("quality") == 0))
    return rows.groupBy("source", "lang").agg(*label, F.count("*").alias("n_lines"))


def matrix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions x nations x segments: axes of a matrix, whose product is its definition; axes are short lists."""
    r = table(spark, sf_dir, "region").select("r_name")
    n = table(spark, sf_dir, "nation").select("n_name")
    s = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    every = r.crossJoin(n).crossJoin(s)
    w = Window.orderBy("r_name", "n_name", "c_mktsegment")  # run numbers are over the whole matrix
    return every.withColumn("run", F.row_number().over(w).cast("long"))


def claims_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and clicks as expected rows, views as claims, by user."""
    e = _events(spark, sf_dir).withColumn("text", F.col("user_id").cast("string"))
    rows = e.filter("event_type in ('error', 'click')").select("text", F.col("event_id").alias("row"), F.col("t").alias("at"), (F.col("event_type") == "error").alias("executed"))
    claims = e.filter("event_type = 'view'").select("text", F.col("event_id").alias("claim"), F.col("t").alias("at"))
    return ev.assign_claims(rows, claims)


def settle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stillness half in SQL: a user's events with gaps of at most six hours are one change, which ends when the next begins."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _events(spark, sf_dir).withColumn("new", (F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(1e18)) > 6 * HOUR).cast("int"))
    rows = rows.withColumn("state", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    states = rows.groupBy("user_id", "state").agg(F.min("t").alias("t_change"), F.max("t").alias("t_settled"))
    return states.withColumn("t_end", F.lead("t_change").over(Window.partitionBy("user_id").orderBy("state")))


def settle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "t", F.col("event_type").alias("digest"))
    return st.settle(e, 2 * HOUR, 24 * HOUR)


def churn_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of errors among a user's last ten events: on above a half, off at or below a fifth, nothing before the third event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf_dir).withColumn("idx", F.row_number().over(w)).withColumn("n", F.least(F.col("idx"), F.lit(10)))
    e = e.withColumn("hits", F.sum((F.col("event_type") == "error").cast("int")).over(w.rowsBetween(-9, 0)))
    warm = F.col("idx") >= 3
    out = sq.latch(e, ["user_id"], ["ts", "event_id"], warm & (F.col("hits") * 2 > F.col("n")), warm & (F.col("hits") * 5 <= F.col("n")))
    return out.select("event_id", F.col("active").cast("long").alias("active"))


def blink_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sq.recurrences(_events(spark, sf_dir), ["user_id", "event_type"], "t", HOUR, 24 * HOUR, 72 * 3600, 2)
    return out.groupBy("event_type").agg(F.count_if("recurs").alias("n_recurs"), F.count_if("confirmed").alias("n_confirmed"), F.count("*").alias("n"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def lineage_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every table of the scale folder."""
    out = None
    for name in TABLES:
        one = ln.table_digest(table(spark, sf_dir, name)).select(F.lit(name).alias("name"), "n_rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def call_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as requests; labelled documents' texts are in the cache. Distinct misses by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", ln.call_key(F.lit("annotate"), F.coalesce("text", F.lit(""))).alias("key"))
    cache = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("key").distinct()
    missing = docs.join(cache, "key", "left_anti").groupBy("key").agg(F.min("source").alias("source"))
    return missing.groupBy("source").agg(F.count("*").alias("n_misses"))


_E = "e as (select *, epoch_us(ts) / 1000000.0::double as t from events)"
_PAIRS = "pairs as (select o_orderkey as left_key, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as right_key from orders qualify right_key is not null)"
_GREEDY = """c as (select left_key, a.l_linenumber::bigint as i, b.l_linenumber::bigint as j, max(50 - abs(a.l_quantity - b.l_quantity)) as area
  from pairs join lineitem a on a.l_orderkey = left_key join lineitem b on b.l_orderkey = right_key group by 1, 2, 3),
r as (select *, row_number() over (partition by left_key order by area desc, i, j) as k from c),
walk as (select left_key, i, j, area, k, true as taken, [i] as ti, [j] as tj from r where k = 1 union all
  select r.left_key, r.i, r.j, r.area, r.k, not (list_contains(ti, r.i) or list_contains(tj, r.j)),
    case when list_contains(ti, r.i) or list_contains(tj, r.j) then ti else list_append(ti, r.i) end, case when list_contains(ti, r.i) or list_contains(tj, r.j) then tj else list_append(tj, r.j) end
  from walk w join r on r.left_key = w.left_key and r.k = w.k + 1)"""
SQL = {
    "turn_transitions": r"""with p as (
  select regexp_replace(coalesce(text, ''), '\s+', '', 'g') as y, lag(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) over (partition by conv_id order by turn) as x,
    row_number() over (partition by conv_id order by turn) as n from conversations
)
select case when x = y then 'reread' when starts_with(y, x) then 'appended' when starts_with(x, y) then 'truncated' else 'changed' end as kind, count(*) as n from p where n > 1 group by 1""",
    "occurrence_pairing": f"""with {_PAIRS}, lines as (
  select l_orderkey, l_returnflag, l_linenumber as o, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber) as k from lineitem
)
select a.l_returnflag, a.k::int as k, count(*) as n, sum(b.o - a.o)::bigint as shift from pairs join lines a on a.l_orderkey = left_key
join lines b on b.l_orderkey = right_key and b.l_returnflag = a.l_returnflag and b.k = a.k group by 1, 2""",
    "common_prefixes": """with p as (select conv_id, turn, coalesce(text, '') as b, lag(coalesce(text, '')) over w as a from conversations window w as (partition by conv_id, role order by turn) qualify a is not null)
select conv_id, turn, coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i::int, 1) <> substr(b, i::int, 1))) - 1, least(length(a), length(b)))::bigint as n from p""",
    "parents_of_orders": """with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as k from orders),
s as (select o_custkey as c, 'a' || (k // 4) as step, min(o_orderkey) as first, max(o_orderkey) as last, 0 as b from o group by 1, 2 union all select o_custkey, 'b' || ((k + 2) // 4), min(o_orderkey), max(o_orderkey), 1 from o group by 1, 2),
p as (select o_custkey, o_orderkey, step, first, last, row_number() over (partition by o_custkey, o_orderkey order by first * 2 + b desc) as r from o join s on c = o_custkey and o_orderkey between first and last)
select o_custkey, o_orderkey, step, first, last from p where r = 1""",
    "greedy_matching": f"with recursive {_PAIRS}, {_GREEDY} select left_key, i, j, area from walk where taken",
    "mutual_best_matching": f"with recursive {_PAIRS}, {_GREEDY} select left_key, i, j from walk where taken",
    "status_lifetimes": f"""with {_E}, m as (
  select *, case when lag(event_type) over w is not distinct from event_type then 0 else 1 end as new from e window w as (partition by user_id order by ts, event_id)
), r as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as island from m)
select user_id, island, min(event_type) as event_type, min(t) as first, max(t) as last, count(*) as sightings from r group by 1, 2""",
    "majority_readings": """with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by 1, 2)
select user_id, event_type as majority, n as majority_n from c qualify row_number() over (partition by user_id order by n desc, f, event_type) = 1""",
    "id_ranges": f"""with {_E}, d as (select distinct user_id, floor(t / 86400)::bigint as day from e where event_type = 'error'),
r as (select *, day - row_number() over (partition by user_id order by day) as g from d)
select user_id, min(day) as first, max(day) as last, count(*) as n from r group by user_id, g""",
    "moves_and_flicker": f"""with {_E}, d as (select distinct floor(t / 86400)::bigint as day, user_id from e), b as (select day + 1 as day, user_id from d)
select coalesce(d.day, b.day) as day, count(*) filter (b.day is null) as appeared, count(*) filter (d.day is null) as removed, count(*) filter (d.day is not null and b.day is not null) as kept
from d full join b on d.day = b.day and d.user_id = b.user_id group by 1""",
    "continues_links": """with p as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as x from events),
c as (select * from p where x is not null and x <> event_type)
select user_id, event_id, case when lag(event_type) over w = x then lag(event_id) over w end as source from c window w as (partition by user_id order by ts, event_id)""",
    "reverts": f"""with {_E}, p as (
  select *, lag(event_type) over w as x, lag(event_type, 2) over w as z, round(t - lag(t) over w, 3) as hold from e window w as (partition by user_id order by ts, event_id)
)
select user_id, event_id, hold from p where event_type = z and event_type <> x""",
    "labels_carry_forward": """with l as (select d.source, d.doc_id, l.quality::int as quality from labels l join documents d using (doc_id))
select d.source, d.doc_id, l.quality from documents d asof left join l on d.source = l.source and d.doc_id >= l.doc_id""",
    "agreement": """with p as (select role, lag(role) over (partition by conv_id order by turn) as prev_role from conversations)
select role, prev_role, count(*) filter (role = prev_role) as n_agree, count(*) as n from p where prev_role is not null group by 1, 2""",
    "repair_counters": "select case "
    + " ".join(f"when {v} then '{k}'" for k, v in RULES.items())
    + " else 'kept' end as reason, count(*) as n from lineitem group by 1",
    "interval_overlap": f"""with {_E}, m as (
  select *, case when lag(event_type) over w is not distinct from event_type then 0 else 1 end as new from e window w as (partition by user_id order by ts, event_id)
), r as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as island from m),
s as (select user_id, island, min(t) as t0, max(t) as t1 from r group by 1, 2)
select * from s where t1 >= 1704844800 and t0 <= 1705017600""",
    "range_join_chapters": f"""with {_E}, c as (select 'c' || (k + 1) as chapter, 1704067200.0 + 432000.0 * k as a, 1704067200.0 + 432000.0 * (k + 1) + 86400 as b, k from range(5) r(k)),
f as (select event_id, t, (select arg_min(chapter, k) from c where t >= a and t < b) as chapter from e)
select chapter, count(*) as n, min(t) as first, max(t) as last from f group by 1""",
    "parent_ranges": """with s as (select *, ((row_number() over (partition by o_custkey order by o_orderkey) - 1) // 4)::bigint as step from orders)
select o_custkey, step, min(o_orderkey) as first, max(o_orderkey) as last, count(*) as n from s group by 1, 2""",
    "boundary_windows": """with p as (
  select o_custkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) - 1 as place, count(*) over (partition by o_custkey) as n from orders
), w as (
  select p.*, k as win, k * 4 as first from p join range(0, 100000) r(k) on place >= k * 4 and place < k * 4 + 6 and (k = 0 or (k - 1) * 4 + 6 < n)
), b as (
  select *, lag(o_orderstatus) over (partition by o_custkey, win order by place) as prev from w
), v as (select * from b where place = first or prev <> o_orderstatus),
m as (select o_custkey, place, sum(case when win > 0 and place = first then 1 else 2 end)::bigint as votes, arg_min(o_orderstatus, win) as label from v group by 1, 2)
select o_custkey, place, votes, label from m where votes >= 2 or place = 0""",
    "hierarchy_rollup": """select r_name, n_name, count(*) as n_orders, min(o_orderkey) as first, max(o_orderkey) as last, sum(o_totalprice::decimal(18, 2))::double as total, grouping(r_name, n_name)::bigint as depth
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""",
    "nodes_by_level": """with l as (select * from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
firsts as (
  select 'order' as level, l_orderkey::varchar as item, l_returnflag as f, min((l_orderkey, l_linenumber)) as o, count(*) as n from l group by all
  union all select 'customer', o_custkey::varchar, l_returnflag, min((l_orderkey, l_linenumber)), count(*) from l group by all
), nodes as (select level, item, string_agg(f, chr(10) order by o, f) as text, sum(n)::bigint as n from firsts group by 1, 2)
select level, text, count(*) as n_nodes, sum(n)::bigint as n_lines from nodes group by 1, 2""",
    "nodes_of_all_levels": """with l as (select * from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
firsts as (
  select 'line' as level, l_orderkey || ' ' || l_linenumber as item, l_returnflag as f, min((0, l_orderkey, l_linenumber)) as o, count(*) as n from l group by all
  union all select 'order', l_orderkey::varchar, l_returnflag, min((0, l_orderkey, l_linenumber)), count(*) from l group by all
  union all select 'customer', o_custkey::varchar, l_returnflag, min((0, l_orderkey, l_linenumber)), count(*) from l group by all
  union all select 'nation', c_nationkey::varchar, l_returnflag, min((o_custkey, l_orderkey, l_linenumber)), count(*) from l group by all
), nodes as (select level, item, string_agg(f, chr(10) order by o, f) as text, sum(n)::bigint as n from firsts group by 1, 2)
select level, text, count(*) as n_nodes, sum(n)::bigint as n_lines from nodes group by 1, 2""",
    "hierarchy_of_all_levels": """select r_name, n_name, o_custkey, o_orderkey, count(*) as n_orders, min(o_orderkey) as first, max(o_orderkey) as last, sum(o_totalprice::decimal(18, 2))::double as total,
  grouping(r_name, n_name, o_custkey, o_orderkey)::bigint as depth
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name, o_custkey, o_orderkey)""",
    "agreement_of_texts": r"""with t as (select conv_id, turn, role, trim(regexp_replace(translate(coalesce(text, ''), '“”‘’', '""'''''), '\s+', ' ', 'g')) as x from conversations),
v as (select *, string_split(x, ' ') as w from t),
f as (select *, case when len(w) > 1 and length(w[1]) <= 2 then array_to_string(w[2:], ' ') end as head, case when len(w) > 1 and length(w[-1]) <= 2 then array_to_string(w[:-2], ' ') end as tail from v),
p as (select role, x, head, tail, lag(role) over o as prev_role, lag(x) over o as px, lag(head) over o as phead, lag(tail) over o as ptail, row_number() over o as k from f window o as (partition by conv_id order by turn))
select role, prev_role, count(*) filter (coalesce(x = px, false) or coalesce(x = phead, false) or coalesce(x = ptail, false) or coalesce(px = head, false) or coalesce(px = tail, false)) as n_agree, count(*) as n
from p where k > 1 group by 1, 2""",
    "box_stability_metric": """with p as (select *, lag(event_type) over w as x, lag(value) over w as v, row_number() over w as k from events window w as (partition by user_id order by ts, event_id)),
c as (select count(*) filter (event_type = x) as unchanged, count(*) filter (event_type = x and abs(value - v) > 50) as variants, count(*) filter (event_type <> x) as lost from p where k > 1)
select *, round((unchanged - variants)::double / nullif(unchanged + lost, 0), 4) as stability from c""",
    "low_half_median": """with r as (select *, row_number() over (partition by event_type order by value nulls first, event_id) as rn, count(*) over (partition by event_type) as n from events)
select event_type, round(median(value), 4) as median_low, count(*) as n_low from r where rn <= ceil(n / 2.0) group by 1""",
    "cost_rollup": """with p as (
  select l_linestatus as stage, l_returnflag as model, ((l_quantity * 1000 * coalesce(price_in, 2.0) + l_linenumber * 100.0 * coalesce(price_out, 10.0)) / 1e6 * case when l_linestatus = 'O' then 0.5 else 1.0 end)::decimal(24, 10) as dollars
  from lineitem left join (values ('A', 3.0::double, 15.0::double), ('N', 1.0::double, 5.0::double)) as prices(model, price_in, price_out) on l_returnflag = model
), s as (select stage, model, round(sum(dollars), 4)::double as dollars, count(*) as n_calls from p group by rollup (stage, model))
select *, round(dollars / n_calls * 1000, 4) as per_1000_calls from s""",
    "paired_noise_floor": """with cards as (
  select l_returnflag as config, quarter(l_shipdate) as repeat, l_linenumber as unit, avg(l_discount) as value from lineitem group by 1, 2, 3
), reps as (select config, count(distinct repeat) as n from cards group by 1),
m as (select config, unit, avg(value) as v, any_value(n) as n from cards join reps using (config) group by 1, 2 having count(distinct repeat) = any_value(n)),
f as (select config, max(d) as floor from (
  select x.config, abs(avg(y.value - x.value)) as d from cards x join cards y on x.config = y.config and x.unit = y.unit and x.repeat < y.repeat group by x.config, x.repeat, y.repeat) group by 1),
p as (select a.config as a, b.config as b, count(*) as n_units, round(avg(a.v), 6) as mean_a, round(avg(b.v), 6) as mean_b, round(avg(b.v - a.v), 6) as diff, max(a.n) as na, max(b.n) as nb
  from m a join m b on a.unit = b.unit and a.config < b.config group by 1, 2),
g as (select p.*, round(greatest(fa.floor, fb.floor) * sqrt((1.0 / na + 1.0 / nb) / 2), 6) as floor from p left join f fa on fa.config = a left join f fb on fb.config = b)
select a, b, n_units, mean_a, mean_b, diff, floor, case when floor is null then 'unknown' when abs(diff) > floor then 'outside' else 'inside' end as verdict,
  case when abs(diff) > floor then case when diff > 0 then b else a end end as favours from g""",
    "label_verdicts": """select source, lang, case when coalesce(bool_or(toxic = 1 and quality = 0), false) or not coalesce(bool_or(quality = 1), false) then 'wrong' when bool_and(quality = 1) then 'correct' else 'partial' end as label, count(*) as n_lines
from labels join documents using (doc_id) group by 1, 2""",
    "matrix_expand": "select r_name, n_name, c_mktsegment, row_number() over (order by r_name, n_name, c_mktsegment) as run from region, nation, (select distinct c_mktsegment from customer)",
    "settle_gaps": f"""with {_E}, m as (select *, case when t - lag(t) over w <= 21600 then 0 else 1 end as new from e window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as state from m),
s as (select user_id, state, min(t) as t_change, max(t) as t_settled from r group by 1, 2)
select *, lead(t_change) over (partition by user_id order by state) as t_end from s""",
    "churn_hysteresis": f"""with recursive {_E}, o as (
  select event_id, user_id, row_number() over w as idx, sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id rows 9 preceding) as hits from e window w as (partition by user_id order by ts, event_id)
), f as (select *, case when idx < 3 then null when hits * 2 > least(idx, 10) then 1 when hits * 5 <= least(idx, 10) then 0 end as flag from o),
s as (select event_id, user_id, idx, coalesce(flag, 0) as active from f where idx = 1 union all select f.event_id, f.user_id, f.idx, coalesce(f.flag, s.active) from s join f on f.user_id = s.user_id and f.idx = s.idx + 1)
select event_id, active::bigint as active from s""",
    "blink_recurrence": f"""with {_E}, s as (select *, t - lag(t) over (partition by user_id, event_type order by t) as step from e), r as (select *, coalesce(step between 3600 and 86400, false) as recurs from s),
c as (select *, sum(recurs::int) over (partition by user_id, event_type order by t range between 259200 preceding and current row) >= 2 as confirmed from r)
select event_type, count(*) filter (recurs) as n_recurs, count(*) filter (confirmed) as n_confirmed, count(*) as n from c group by 1""",
    "call_cache_misses": """with d as (select doc_id, source, sha256('annotate' || chr(31) || coalesce(text, '')) as key from documents),
c as (select distinct key from d where doc_id in (select doc_id from labels)),
m as (select key, min(source) as source from d where key not in (select key from c) group by 1)
select source, count(*) as n_misses from m group by 1""",
}
NO_SQL = ("turn_char_diff", "track_cascade", "claims_assignment", "settle_events", "lineage_digest")
QUERIES = {name: globals()[name] for name in (*SQL, *NO_SQL)}
