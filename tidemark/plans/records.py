"""Queries on records of calls and what they say: repair, links, readings, answers, quotes, settled pictures; with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import text as tx
from ..operators import alignment as al
from ..operators import assignment as asg
from ..operators import lineage as ln
from ..operators import placing as pl
from ..operators import quotes as qu
from ..operators import repair as rp
from ..operators import wording as wd
from ..streaming import pictures as pc
from .common import seconds, table

HOUR = 3600.0
RULES = pc.Rules(still=2 * HOUR, hold=24 * HOUR, shortest=HOUR, longest=24 * HOUR, within=72 * HOUR, forget=48 * HOUR)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as pictures: each shows a shape at the place of its type, a small one for clicks; values move it by some pixels."""
    e = table(spark, sf_dir, "events")
    place = F.crc32(F.col("event_type").cast("binary")) % 5 * 100
    x, wide = (place + F.floor(F.col("value")) % 3).cast("int"), F.when(F.col("event_type") == "click", 8).otherwise(60)
    shape = F.struct(x.alias("x0"), F.lit(20).alias("y0"), (x + wide).cast("int").alias("x1"), F.lit(32).alias("y1"), F.col("event_type").alias("v"))
    return e.select(F.col("user_id").cast("string").alias("key"), seconds(F.col("ts")).alias("t"), "event_id", shape.alias("shape"))


def picture_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).groupBy("key", "t").agg(F.array_sort(F.collect_list("shape")).alias("shapes"))
    return pc.settled_pictures(rows, RULES)


def blinking_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).select("key", "t", F.col("shape").dropFields("v").alias("rect")).distinct()
    return pc.blinks(rows, RULES).groupBy("key").agg(F.count("*").alias("n"), F.count_if("blinks").alias("n_blinks"), F.min("confirmed_at").alias("first_confirmed"))


def optimal_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order grouped by six kinds of parts and by return flag: how many lines agree under the best matching of kinds with flags."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey") % 6).alias("part"), "l_returnflag")
    out = asg.grouping_difference(lines, ["l_orderkey"], "part", "l_returnflag")
    per = out.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("differs")).alias("n_agree"))
    return per.groupBy("n_lines", "n_agree").agg(F.count("*").alias("n_orders"))


def closest_in_next_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first line of a turn occurs in the next one, with errors."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "\n")[0].alias("line"), F.lead("text").over(w).alias("next"))
    return turns.filter("next is not null").select("conv_id", "turn", al.closest(F.col("line"), F.col("next")).alias("c")).select("conv_id", "turn", "c.score", "c.begin", "c.end")


def reading_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as boxes of a conversation; each is read as the next turn of its role, the last turn of a user as the user's first: chains and cycles of shifted readings."""
    t = table(spark, sf_dir, "conversations").filter("text is not null")
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    first = F.when(F.col("role") == "user", F.first("text").over(w))
    t = t.select(F.col("conv_id").alias("frame"), F.col("turn").cast("string").alias("box"), F.col("turn").alias("ordinal"), "text", F.coalesce(F.lead("text").over(w), first).alias("read"))
    rect = F.struct(F.lit(0).alias("x0"), (F.col("ordinal") * 20).cast("int").alias("y0"), F.lit(100).alias("x1"), (F.col("ordinal") * 20 + 15).cast("int").alias("y1"))
    hits = al.scrambled(t.select("frame", "box", "ordinal", rect.alias("bbox"), "text"), t.select("frame", "box", F.col("read").alias("text")).filter("text is not null"))
    out = al.chains(hits)
    return out.groupBy("length", "relation").agg(F.count("*").alias("n"), F.sum(F.abs("steps")).alias("steps"))


def _proposals(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """An order as a record: its lines propose containers, assignments, links, texts and missed texts, with the faults that their keys happen to give.

    Flag and status go as one column, the last to order lines by, so that all tables read the same columns of lines and the shuffle by order is made once.
    A split of the scan goes to 32 parts, by number so that they are not joined again: lines become many items in a part, which are to be sorted in memory.
    """
    # line numbers of an order can repeat, so the place in an order is counted
    marks = F.array("l_returnflag", "l_linestatus")
    lines = table(spark, sf_dir, "lineitem")
    i = lines.select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"), marks.alias("marks"))
    i = i.repartition(32 * max(1, lines.rdd.getNumPartitions()), "record")
    i = i.withColumn("pos", F.row_number().over(Window.partitionBy("record").orderBy(*[F.asc_nulls_last(c) for c in ("line", "p", "s", "q", "price", "marks")])))
    i = i.select("record", "pos", "p", "s", F.col("marks")[0].alias("flag"), F.col("marks")[1].alias("status"))
    name = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    box, other = name("b", F.col("p") % 9 + 1), name("b", F.col("s") % 9 + 1)
    kind = F.when(F.col("flag") == "A", "pair").when(F.col("flag") == "N", "run").otherwise("record")
    header = F.when(kind == "record", F.array(name("b", F.col("p") % 4 + 1))).otherwise(F.array().cast("array<string>"))
    return {
        "boxes": i.select("record", name("b", F.col("pos")).alias("box"), F.col("pos").alias("place"), (F.col("flag") != "A").alias("target")),
        "containers": i.select("record", "pos", name("c", F.col("s") % 4).alias("id"), F.when(F.col("status") == "O", "popup").otherwise("window").alias("kind"), F.when(F.col("p") % 3 != 0, name("c", F.col("p") % 5)).alias("owner"), F.array(name("c", F.col("p") % 4), name("c", F.col("s") % 3)).alias("covers")),
        "assign": i.select("record", "pos", box.alias("box"), name("c", F.col("p") % 4).alias("container"), F.col("flag").alias("pane")),
        "unassigned": i.select("record", "pos", other.alias("box")),
        "links": i.select("record", "pos", kind.alias("kind"), F.concat(F.array(box, other), header).alias("refs"), F.lit(2).alias("cells"), F.array(box, other).alias("members")),
        "texts": i.select("record", "pos", other.alias("box"), F.col("status").alias("text")),
        "missed": i.select("record", "pos", F.when(F.col("p") % 5 == 0, " ").otherwise(F.col("flag")).alias("text"), name("c", F.col("p") % 6).alias("container")),
    }


def proposal_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _proposals(spark, sf_dir)
    known = p["containers"]  # the first of equal ids stays, so no id is lost by the repair
    checks = rp.repair_containers(known)[1], rp.repair_assign(p["assign"], p["unassigned"], p["boxes"], known)[2], rp.repair_links(p["links"], p["boxes"])[1], rp.repair_texts(p["texts"], p["boxes"])[1], rp.repair_missed(p["missed"], known)[1]
    return rp.overall(*checks)


def links_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as records, dated; a line links two of ten lifetimes and would stand for as many days as its quantity."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("frame"))
    w = Window.partitionBy("o_custkey", "frame").orderBy("o_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
    x, y = F.col("l_partkey") % 10, F.col("l_suppkey") % 10
    rows = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter(x != y)
    links = rows.select(F.col("o_custkey").alias("run"), "frame", F.row_number().over(w).alias("pos"), (F.col("frame") + F.col("l_quantity").cast("int")).alias("end"), F.array(x, y).alias("lives"))
    return rp.relinked(links).groupBy("run").agg(F.count("*").alias("n_links"), F.count_if(~F.col("accepted")).alias("relinked"))


def unsupported_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that quote words of the turn before and of themselves, against all turns before them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("before", F.lag("text").over(w)).withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    words = lambda c, k: F.array_join(F.slice(F.split(F.col(c), r"\s+"), k, 3), " ")
    answers = t.filter("before is not null").select("id", "conv_id", "turn", F.lit(None).cast("string").alias("question"), F.concat(F.lit('As "'), words("before", 2), F.lit('" and then `'), words("text", 1), F.lit("`.")).alias("answer"))
    return qu.unsupported(answers, t.select("conv_id", "turn", "text"), "conv_id", "turn").select("id", "quote", F.size("missing").alias("n_missing"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rubric line for each turn: the turn must have the second word of the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lag("text").over(w).alias("before"))
    word = F.regexp_extract("before", r"^[^ \n`]+[ \n]+([^ \n`]+)", 1)
    return t.filter("before is not null and text is not null").withColumn("word", word).filter("word <> ''")


def mechanical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lines(spark, sf_dir).withColumn("question", F.concat_ws(":", "conv_id", "turn"))
    lines = t.select("question", F.lit("M1").alias("line"), F.concat(F.lit("contains the exact string `"), F.col("word"), F.lit("`")).alias("text"))
    answers = t.select("role", F.lit(1).alias("run"), "question", F.col("text").alias("answer"))
    verdicts = t.select(F.lit(1).alias("run"), "question", F.lit("M1").alias("line"), (F.length("word") < 6).alias("met"))
    out = qu.checked(lines, answers.drop("role"), verdicts).join(answers.select("question", "role"), "question")
    return out.groupBy("role").agg(F.count("*").alias("n"), F.count_if("mechanical").alias("n_met"), F.count_if(~F.col("agree")).alias("n_disagree"))


def words_regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts recognised in pieces of at most three characters, put together again; texts of an odd length lose their last piece and fit no more."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = F.flatten(F.transform(F.regexp_extract_all(F.col("text"), F.lit(r"(?U)\S+"), F.lit(0)), lambda w: F.regexp_extract_all(w, F.lit("(?s).{1,3}"), F.lit(0))))
    rect = lambda k: F.struct(*[(k * 10 + d).cast("int").alias(c) for c, d in (("x0", 0), ("y0", 0), ("x1", 9), ("y1", 12))])
    d = d.withColumn("cut", cut).withColumn("cut", F.when(F.length("text") % 2 == 1, F.slice("cut", F.lit(1), F.greatest(F.size("cut") - 1, F.lit(0)))).otherwise(F.col("cut")))
    d = d.withColumn("words", an.regroup_words(F.col("text"), F.transform("cut", lambda p, k: F.struct(p.alias("text"), rect(k).alias("bbox")))))
    wide = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + w["bbox"]["x1"] - w["bbox"]["x0"])
    return d.select("doc_id", F.col("words").isNotNull().alias("fits"), F.size("cut").cast("long").alias("n_pieces"), F.when(F.col("words").isNotNull(), F.size("words")).cast("long").alias("n_words"), wide.alias("width"))


def answers_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers of a model: JSON in a fence, in prose with braces, or cut short, by role."""
    t = table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(F.col("turn").cast("int").alias("turn"), F.coalesce("text", F.lit("")).alias("text")))
    fenced, prose, short = F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("So {that} is: "), body, F.lit(" or {so}.")), F.substring(body, F.lit(1), F.length(body) - 2)
    answer = F.when(F.col("role") == "user", fenced).when(F.col("role") == "assistant", prose).otherwise(short)
    rows = t.select("role", "text", an.parsed_answer(answer, "turn int, text string", ["turn", "text"]).alias("p"))
    same = F.coalesce(F.col("p.value.text") == F.coalesce("text", F.lit("")), F.lit(False))
    return rows.groupBy("role", F.col("p.reason").alias("reason")).agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"), F.sum("p.value.turn").alias("turns"))


def tags_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames: a tag for each line's box."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # named before the window, so that the shuffle by frame serves the fold too
    w = Window.partitionBy("frame").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x, y = (F.col("l_partkey") % 50 * 3).cast("int"), (F.col("l_quantity") * 3).cast("int")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 14).alias("y1"))
    rows = lines.select("frame", F.row_number().over(w).alias("pos"), F.col("l_linenumber").cast("string").alias("box"), box.alias("bbox"), F.lit(20).alias("tag_width"), F.lit(12).alias("tag_height"))
    return pl.place_tags(rows, 240, 180).groupBy("frame").agg(F.count("*").alias("n"), F.count_if("clash").alias("n_clashes"), F.sum(F.col("x") * 1000 + F.col("y")).alias("places"))


def requests_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as attempts of a request on each of their days: errors expire, views are invalid, clicks have no result yet, the rest succeeds."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    result = F.when(kind == "error", "expired").when(kind == "view", "invalid").when(kind == "click", F.lit(None).cast("string")).otherwise("succeeded")
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    rows = e.select(F.concat_ws(":", "user_id", F.to_date("ts").cast("string")).alias("key"), F.row_number().over(w).alias("pass"), result.alias("result"), F.col("event_id").cast("string").alias("body"))
    return ln.standing(rows).groupBy("state").agg(F.count("*").alias("n"), F.sum("tries").alias("tries"), F.max("body").alias("last_body"))


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as changes of a conversation: one record each, of the kind by which the turn before became this one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("after")).withColumn("before", F.lag("after").over(w)).filter("before is not null")
    t = t.withColumn("run", F.col("conv_id")).withColumn("change", F.concat(F.lit("T"), "turn"))
    n, none = F.col("turn"), F.lit(None).cast("string")
    changes = t.select(
        "run", "change", (n - 1).alias("from_frame"), n.alias("to_frame"), (n - 1).cast("double").alias("t0"), n.cast("double").alias("t1"), F.when(n % 2 == 0, n / 16).alias("changed_fraction"), n.alias("components"), (n % 3).alias("textless"),
        (n % 4).alias("moved"), (n % 2).alias("same_place"), F.when(n == 3, "T1").alias("reverts_of"), F.lit(0.75).alias("reverts_share"), F.lit(1.5).alias("reverts_hold"), F.when(n % 5 == 0, "unsettled").otherwise("single").alias("kind"),
    )
    records = t.select(
        "run", "change", F.lit(1).alias("pos"), tx.kind_of(F.col("before"), F.col("after")).alias("kind"), F.concat((n - 1).cast("string"), F.lit(":b1")).alias("before_ref"), "before", F.concat(n.cast("string"), F.lit(":b1")).alias("after_ref"), "after",
        F.lit("").alias("added"), F.lit("").alias("removed"), none.alias("label"), none.alias("continues"), F.lit(False).alias("in_churn"), none.alias("reading"), none.alias("reading_ref"),
    )
    return changes, records


def lines_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.change_lines(*_changes(spark, sf_dir))


def texts_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.change_texts(*_changes(spark, sf_dir)).select("run", "change", "text", F.array_join("ids", ",").alias("ids"))


def readings_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of a user: the type with most events, the first seen on a tie; views are blank."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    return wd.second_readings(e.select(F.col("user_id").alias("lifetime"), F.col("event_id").alias("frame"), text.alias("text")), e.select(F.col("user_id").alias("lifetime"), F.lit("click").alias("text")).distinct())


def pairs_off_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's first line as key, the others as values of one pair: how far the nearest is."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x, y = (F.col("l_partkey") % 50 * 8).cast("int"), (F.col("l_quantity") * 3).cast("int")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 14).alias("y1"))
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.row_number().over(w).alias("box"), box.alias("bbox"))
    out = wd.off_row(i.select("frame", F.lit(1).alias("link"), F.when(F.col("box") == 1, "key").otherwise("value").alias("side"), "box"), i)
    return out.groupBy("dx", "dy", "off_row").agg(F.count("*").alias("n"))


_NORM = r"trim(regexp_replace(translate(coalesce(TEXT, ''), '“”‘’', '\"\"'''''), '\s+', ' ', 'g'))".replace("\\\"", '"')
_I = """i as (select l_orderkey as record, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos,
  l_partkey as p, l_suppkey as s, l_returnflag as flag, l_linestatus as status from lineitem)"""
SQL = {
    "optimal_grouping": """with m as (select l_orderkey as o, 'p' || (l_partkey % 6) as x, l_returnflag as y, count(*) as n from lineitem where l_partkey is not null and l_returnflag is not null group by all),
a as (select o, x, n from m where y = 'A' union all select distinct o, '-a', 0 from m), r as (select o, x, n from m where y = 'R' union all select distinct o, '-r', 0 from m),
n as (select o, x, n from m where y = 'N' union all select distinct o, '-n', 0 from m),
best as (select a.o, max(a.n + r.n + n.n) as n_agree from a join r on a.o = r.o and a.x <> r.x join n on n.o = a.o and n.x <> a.x and n.x <> r.x group by a.o),
sizes as (select l_orderkey as o, count(*) as n_lines from lineitem group by 1)
select n_lines, coalesce(n_agree, 0) as n_agree, count(*) as n_orders from sizes left join best using (o) group by 1, 2""",
    "reading_chains": f"""with recursive t as (select conv_id as frame, turn as box, lower({_NORM.replace("TEXT", "text")}) as own,
  coalesce(lead(text) over w, case when role = 'user' then first_value(text) over w end) as read from conversations where text is not null window w as (partition by conv_id, role order by turn)),
r as (select frame, box, own, lower({_NORM.replace("TEXT", "read")}) as read from t where read is not null),
bad as (select frame, box, read from r where length(read) >= 3 and own <> read and 1 - levenshtein(own, read) / greatest(length(own), length(read))::double < 0.6
  and not (length(split_part(own, ' ', 1)) <= 2 and substr(own, length(split_part(own, ' ', 1)) + 2) = read) and not (length(split_part(read, ' ', 1)) <= 2 and substr(read, length(split_part(read, ' ', 1)) + 2) = own)),
near as (select b.frame, b.box, t.box as other, row_number() over (partition by b.frame, b.box order by abs(t.box - b.box), t.box) as k from bad b join t on t.frame = b.frame and t.box <> b.box
  where abs(length(t.own) - length(b.read)) <= 0.1 * greatest(length(t.own), length(b.read)) and 1 - levenshtein(t.own, b.read) / greatest(length(t.own), length(b.read))::double >= 0.9 - 1e-9),
h as (select frame, box, other from near where k = 1),
walk as (select frame, box as start, other as at, [box] as seen from h union all
  select w.frame, w.start, h.other, list_append(w.seen, h.box) from walk w join h on h.frame = w.frame and h.box = w.at where not list_contains(w.seen, h.box)),
n as (select frame, start, max(len(seen)) as length from walk group by 1, 2)
select n.length as length, case when h.other > h.box then 'above' else 'below' end as relation, count(*) as n, sum(abs(h.other - h.box)) as steps from n join h on h.frame = n.frame and h.box = n.start group by 1, 2""",
    "proposal_repair": f"""with recursive {_I}, boxes as (select record, 'b' || pos as box, flag <> 'A' as target from i),
c as (select record, pos, 'c' || (s % 4) as id, case when status = 'O' then 'popup' else 'window' end as kind, case when p % 3 <> 0 then 'c' || (p % 5) end as owner, 'c' || (p % 4) as v1, 'c' || (s % 3) as v2,
  row_number() over (partition by record, s % 4 order by pos) as k from i),
kept as (select * from c where k = 1),
cover as (select record, id, 1 as nr, v1 as v from kept union all select record, id, 2, v2 from kept),
fit as (select v.record, v.id, nr, v, (k.id is not null and v <> v.id) as fit from cover v left join kept k on k.record = v.record and k.id = v.v),
covers as (select record, fit and row_number() over (partition by record, id, v, fit order by nr) = 1 as ok from fit),
a0 as (select i.record, i.pos, 'b' || (p % 9 + 1) as box, 'c' || (p % 4) as container from i),
a1 as (select a0.*, case when b.box is null then 'unknown_box' when not b.target then 'not_target' when k.id is null then 'unknown_container' end as reason
  from a0 left join boxes b on b.record = a0.record and b.box = a0.box left join kept k on k.record = a0.record and k.id = a0.container),
a as (select record, box, coalesce(reason, case when row_number() over (partition by record, box, reason is null order by pos) > 1 then 'second_assignment' end) as reason from a1),
open as (select b.record, b.box from boxes b where target and not exists (select 1 from a where a.record = b.record and a.box = b.box and reason is null)
  and not exists (select 1 from i where i.record = b.record and 'b' || (s % 9 + 1) = b.box)),
l0 as (select record, pos, 'b' || (p % 9 + 1) as x, 'b' || (s % 9 + 1) as y, case when flag = 'R' then 'b' || (p % 4 + 1) end as h from i),
l1 as (select l.*, case when bx.box is null or y_.box is null or (h is not null and hx.box is null) then 'link_unknown_box' when x = y or x = h or y = h then 'link_malformed' end as reason
  from l0 l left join boxes bx on bx.record = l.record and bx.box = x left join boxes y_ on y_.record = l.record and y_.box = y left join boxes hx on hx.record = l.record and hx.box = h),
walk as (select record, pos, coalesce(reason, '') as reason, case when reason is null then [x, y] else [''] end as taken from l1 where pos = 1 union all
  select l.record, l.pos, coalesce(l.reason, case when list_contains(w.taken, x) or list_contains(w.taken, y) then 'link_already_linked' else '' end),
    case when l.reason is null and not list_contains(w.taken, x) and not list_contains(w.taken, y) then list_concat(w.taken, [x, y]) else w.taken end
  from walk w join l1 l on l.record = w.record and l.pos = w.pos + 1),
t0 as (select record, pos, 'b' || (s % 9 + 1) as box from i),
t1 as (select t0.*, case when b.box is null then 'text_unknown_box' when not b.target then 'text_not_target' end as reason from t0 left join boxes b on b.record = t0.record and b.box = t0.box),
t as (select record, box, coalesce(reason, case when row_number() over (partition by record, box, reason is null order by pos) > 1 then 'second_text' end) as reason from t1),
every as (
  select record, 'dup_container' as reason from c where k > 1
  union all select k.record, 'bad_owner' from kept k left join kept o on o.record = k.record and o.id = k.owner where k.owner is not null and not coalesce(k.kind = 'popup' and o.kind = 'window' and k.owner <> k.id, false)
  union all select record, 'bad_covers' from covers where not ok
  union all select record, reason from a where reason is not null
  union all select record, 'unplaced' from open
  union all select record, reason from walk where reason <> ''
  union all select record, reason from t where reason is not null
  union all select b.record, 'text_missing' from boxes b where target and not exists (select 1 from t where t.record = b.record and t.box = b.box and reason is null)
  union all select record, 'missed_empty' from i where p % 5 = 0
  union all select i.record, 'missed_unknown_container' from i left join kept k on k.record = i.record and k.id = 'c' || (p % 6) where p % 5 <> 0 and k.id is null
), n as (select record, reason, count(*) as n from every group by 1, 2)
select reason, sum(n)::bigint as n, count(*) as n_records from n group by 1""",
    "mechanical_lines": r"""with t as (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn) as before from conversations),
w as (select role, text, regexp_extract(before, '^[^ \n`]+[ \n]+([^ \n`]+)', 1) as word from t where before is not null and text is not null)
select role, count(*) as n, count(*) filter (contains(text, word)) as n_met, count(*) filter (contains(text, word) <> (length(word) < 6)) as n_disagree from w where word <> '' group by 1""",
    "words_regrouped": r"""with d as (select doc_id, length(coalesce(text, '')) % 2 = 1 as odd, regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}\x{85}\x0B]+') as w from documents),
n as (select doc_id, odd, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: (length(x) + 2) // 3)), 0)::bigint as n from d)
select doc_id, not odd or n = 0 as fits, (n - case when odd and n > 0 then 1 else 0 end)::bigint as n_pieces, case when not odd or n = 0 then n_words end::bigint as n_words,
  case when not odd or n = 0 then 10 * n - n_words end::bigint as width from n""",
    "answers_parsed": """select role, case when role in ('user', 'assistant') then null else 'cut' end as reason, count(*) as n, count(*) filter (role in ('user', 'assistant')) as n_same,
  case when role in ('user', 'assistant') then sum(turn) end::bigint as turns from conversations group by role""",
    "requests_standing": """with e as (select user_id || ':' || ts::date as key, event_type as kind, event_id, row_number() over (partition by user_id, ts::date order by ts, event_id) as pass from events),
k as (select key, count(*) as tries, min(case when kind not in ('error', 'view', 'click') then pass end) as good, bool_or(kind = 'view') as bad, bool_or(kind = 'click') as open from e group by 1),
s as (select k.*, case when good is not null then 'done' when bad then 'invalid' when open then 'open' when tries >= 2 then 'failed' else 'again' end as state from k)
select state, count(*) as n, sum(tries)::bigint as tries, max(event_id::varchar) as last_body from s left join e on e.key = s.key and e.pass = s.good group by 1""",
}
_K = r"""k as (select conv_id, turn, coalesce(text, '') as after, lag(coalesce(text, '')) over (partition by conv_id order by turn) as before from conversations),
c as (select conv_id as run, 'T' || turn as change, turn as n, after, before, regexp_replace(after, '\s+', '', 'g') as y, regexp_replace(before, '\s+', '', 'g') as x from k where before is not null),
r as (select *, case when x = y then 'reread' when starts_with(y, x) then 'appended' when starts_with(x, y) then 'truncated' else 'changed' end as kind from c)"""
SQL |= {
    "lines_of_changes": f"""with {_K} select run, change, change || ' [f' || (n - 1) || '→f' || n || ', ' || printf('%.1f', (n - 1)::double) || '–' || printf('%.1f', n::double) || 's] ' || kind || ' "'
  || case when length(after) > 80 then substr(after, 1, 79) || '…' else after end || '"' || case when n % 4 > 0 then '; moved ' || (n % 4) else '' end || case when n = 3 then '; undoes T1' else '' end as line from r""",
    "texts_of_changes": f"""with {_K} select run, change, 'Transition ' || change || ': frame ' || (n - 1) || ' → frame ' || n || ', t=' || printf('%.2f', (n - 1)::double) || '–' || printf('%.2f', n::double) || 's.' || chr(10)
  || case when n % 2 = 0 then 'Pixels changed: ' || printf('%.2f', n / 16.0::double * 100) || '% of the screen; changed areas: ' || n || '.' else 'Pixels: no comparison is available for this pair.' end || chr(10) || 'Text changes:' || chr(10)
  || '[' || n || ':b1, ' || (n - 1) || ':b1] ' || case kind when 'appended' then '"' || before || '" → appended ""; now "' || after || '"' when 'truncated' then '"' || before || '" → truncated, removed ""; now "' || after || '"'
    when 'changed' then 'at this place "' || before || '" was replaced by "' || after || '"' else '"' || before || '" re-read as "' || after || '" (same text)' end
  || case when n % 4 > 0 then chr(10) || 'Texts that only moved: ' || (n % 4) || '.' else '' end || case when n % 2 > 0 then chr(10) || 'Boxes with a visual change over unchanged text: ' || (n % 2) || '.' else '' end
  || case when n % 2 = 0 and n % 3 > 0 then chr(10) || 'Changed areas without text: ' || (n % 3) || '.' else '' end || case when n = 3 then chr(10) || 'Undoes 75% of T1''s change after 1.5 s.' else '' end
  || case when n % 5 = 0 then chr(10) || 'One of these frames was captured while the screen was still changing.' else '' end as text, n || ':b1,' || (n - 1) || ':b1' as ids from r""",
    "readings_of_users": """with c as (select user_id as lifetime, event_type as t, count(*) as n, min(event_id) as f from events where event_type is not null group by 1, 2),
s as (select lifetime, sum(n)::bigint as n_readings from c group by 1), b as (select lifetime, t, row_number() over (partition by lifetime order by n desc, f) as k from c where t <> 'view')
select s.lifetime as lifetime, t as reading, n_readings, t is null as non_text, t = 'click' as agree from s left join b on b.lifetime = s.lifetime and k = 1""",
    "pairs_off_row": f"""with {_I.replace('l_linestatus as status from', 'l_linestatus as status, l_quantity as q from')}, b as (select record, pos, p % 50 * 8 as x, (q * 3)::int as y from i),
g as (select a.record, greatest(0, greatest(a.x, b.x) - least(a.x, b.x) - 60) as dx, greatest(0, greatest(a.y, b.y) - least(a.y, b.y) - 14) as dy from b a join b on b.record = a.record and b.pos > 1 where a.pos = 1),
m as (select record, dx, dy, row_number() over (partition by record order by dy * 10 + dx, dx, dy) as k from g),
o as (select distinct record from b) select coalesce(dx, 0) as dx, coalesce(dy, 0) as dy, coalesce(dy, 0) > 12 as off_row, count(*) as n from o left join m on m.record = o.record and k = 1 group by 1, 2, 3""",
}
NO_SQL = ("picture_states", "blinking_places", "closest_in_next_turn", "links_refused", "unsupported_quotes", "tags_placed")
QUERIES = {name: globals()[name] for name in (*SQL, *NO_SQL)}
