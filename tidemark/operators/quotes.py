"""Answers held against what they claim to rest on: exact strings, times and frames that a rubric line asks for, and quotes that no source has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the character runs by which parts of quotes and texts meet; shorter parts are not looked at.
RUN = 4
LONGEST = 300
# What parts a quote into passages that are looked up one by one, and marks that don't count in a comparison.
BREAKS = r"\s*(?:…|\.\.\.| / | \| | — | – | - |\s{2,}|→|->|>)\s*"
DASHES = "‐‑–—"
MARKS = "\"'`*\\\\"


def squashed(text: Column) -> Column:
    """Lower case without quote marks, backslashes and emphasis, one kind of dash, single blanks."""
    plain = F.replace(F.lower(F.translate(text, "“”’‘", "\"\"''")), F.lit("\\n"), F.lit(" "))
    plain = F.translate(plain, DASHES + "\"'`*\\", "-" * len(DASHES))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def quotes(answer: Column) -> Column:
    """Distinct strings of an answer in double quotes or backticks, of four to 300 characters on one line."""
    plain = F.replace(F.translate(answer, "“”", '""'), F.lit("**"), F.lit(""))
    found = F.concat(*[F.regexp_extract_all(plain, F.lit(p), F.lit(1)) for p in (r'"([^"\n]*)"', r"`([^`\n]*)`")])
    return F.array_distinct(F.filter(found, lambda q: F.length(q).between(RUN, LONGEST)))


def passages(quote: Column) -> Column:
    """The squashed passages of a quote that are long enough to look up."""
    parts = F.transform(F.split(quote, BREAKS, -1), lambda p: F.rtrim(squashed(p), F.lit(".,;:")))
    return F.filter(parts, lambda p: F.length(p) >= RUN)


def _runs(text: Column) -> Column:
    """Hashes of the distinct runs of RUN characters of a text, from shifted copies of its characters."""
    chars = F.split(text, "")
    n = F.greatest(F.size(chars) - (RUN - 1), F.lit(0))
    out = F.slice(chars, F.lit(1), n)
    for k in range(2, RUN + 1):
        out = F.zip_with(out, F.slice(chars, F.lit(k), n), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.transform(out, lambda r: F.xxhash64(r)))


def contained(parts: DataFrame, texts: DataFrame, on: list[str], part: str, text: str, place: str | None = None) -> DataFrame:
    """The distinct (on, part) that some text with the same ``on`` contains; with ``place``, a column of ``texts``, its least among those texts too.

    An inverted index of runs: a part is looked up by one of its runs, that of least hash, and meets the texts that have this run. Runs travel as
    (on, hash, number of the text), neither text nor part beside them; texts join again only where a run was found, and ``contains`` decides.
    """
    first = F.min(place if place else F.lit(None).cast("long"))
    texts = texts.groupBy(*on, F.col(text).alias("_text")).agg(first.alias("_place")).withColumn("_number", F.xxhash64("_text"))
    wanted = parts.select(*on, F.col(part).alias("_part")).distinct()
    keyed = wanted.withColumn("_run", F.array_min(_runs(F.col("_part"))))
    index = texts.select(*on, "_number", F.explode(_runs(F.col("_text"))).alias("_run"))
    index = index.join(keyed.select("_run").distinct(), "_run", "left_semi")
    near = keyed.join(index, [*on, "_run"]).select(*on, "_part", "_number").distinct()
    hit = near.join(texts, [*on, "_number"]).filter(F.contains("_text", "_part"))
    found = hit.groupBy(*on, F.col("_part").alias(part)).agg(F.min("_place").alias("_place"))
    return found.withColumnRenamed("_place", place) if place else found.drop("_place")


def unsupported(answers: DataFrame, sources: DataFrame, group: str | None = None, place: str | None = None) -> DataFrame:
    """Quotes of answers (id, question, answer) with passages that neither a source (id, text) of the answer nor its question has: id, quote, missing.

    With ``group`` and ``place``, columns of both, the sources of an answer are those of its group at a lesser place. They are looked up by group, so a text moves once
    and not once for each answer after it.

    A passage must lie in one source. Quotes without a passage of four characters are supported. Null answers have no quotes, a null question has nothing.
    """
    own = [group, place] if group else []
    every = answers.select("id", *own, "question", F.explode(quotes(F.col("answer"))).alias("quote"))
    parts = every.select("id", *own, "question", "quote", F.posexplode(passages(F.col("quote"))).alias("pos", "part"))
    parts = parts.filter(~F.coalesce(F.contains(squashed(F.col("question")), F.col("part")), F.lit(False)))
    if group:
        held = contained(parts, sources.select(*own, squashed(F.col("text")).alias("text")), [group], "part", "text", place).withColumnRenamed(place, "_held")
        lost = parts.join(held, [group, "part"], "left").filter(~F.coalesce(F.col("_held") < F.col(place), F.lit(False)))
    else:
        held = contained(parts, sources.select("id", squashed(F.col("text")).alias("text")), ["id"], "part", "text")
        lost = parts.join(held, ["id", "part"], "left_anti")
    return lost.groupBy("id", "quote").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "part"))), lambda x: x["part"]).alias("missing"))


def times(answer: Column) -> Column:
    """Seconds that an answer names: ``m:ss`` with a fraction or without, numbers before s, sec or a dash, and numbers after t."""
    clock = r"(?<![\d:.])(\d{1,2}):(\d{2})(\.\d+)?(?![\d:])"
    at = lambda k: F.regexp_extract_all(answer, F.lit(clock), F.lit(k))
    clocks = F.transform(F.arrays_zip(at(1).alias("m"), at(2).alias("s"), at(3).alias("f")), lambda z: z["m"].cast("double") * 60 + F.concat(z["s"], z["f"]).cast("double"))
    spans = F.regexp_extract_all(answer, F.lit(r"(\d{2,4}(?:\.\d+)?)\s*(?:s\b|sec|–|-\d)"), F.lit(1))
    named = F.regexp_extract_all(answer, F.lit(r"t\s*[=≈~]?\s*(\d{1,4}(?:\.\d+)?)"), F.lit(1))
    return F.concat(clocks, F.transform(F.concat(spans, named), lambda x: x.cast("double")))


def _span(first: Column, last: Column) -> Column:
    return F.struct(first.cast("long").alias("a"), last.cast("long").alias("b"))


def frames(answer: Column) -> Column:
    """Ranges of frames that an answer names; of a range of 60 or more only its ends count."""
    at = lambda k: F.regexp_extract_all(answer, F.lit(r"[Ff]rames?\s+(\d+)(?:\s*[–-]\s*(\d+))?"), F.lit(k))
    pairs = F.transform(F.arrays_zip(at(1).alias("x"), at(2).alias("y")), lambda z: _span(z["x"], F.when(z["y"] != "", z["y"]).otherwise(z["x"])))
    return F.flatten(F.transform(pairs, lambda p: F.when(p["b"] - p["a"] < 60, F.array(p)).otherwise(F.array(_span(p["a"], p["a"]), _span(p["b"], p["b"])))))


def allowed_frames(line: Column) -> Column:
    """Ranges of frames that a rubric line lets pass instead of a time."""
    got = lambda p, k: F.regexp_extract(line, p, k)
    span, two, one = r"or a frame from (\d+) to (\d+)", r"or frame (\d+) or (\d+)", r"or frame (\d+)"
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return (
        F.when(line.rlike(span), F.array(_span(got(span, 1), got(span, 2))))
        .when(line.rlike(two), F.array(_span(got(two, 1), got(two, 1)), _span(got(two, 2), got(two, 2))))
        .when(line.rlike(one), F.array(_span(got(one, 1), got(one, 1)))).otherwise(none)
    )


def mechanical(line: Column, answer: Column) -> Column:
    """What a rubric line asks for, checked without a judge: whether the answer has the exact string in backticks, or a time between two (or an allowed frame).
    Null for other lines and for null answers."""
    exact = r"contains the exact string `([^`]+)`"
    between = r"gives a time between (\d+):(\d+) and (\d+):(\d+)"
    got = lambda k: F.regexp_extract(line, between, k).cast("double")
    low, high = got(1) * 60 + got(2), got(3) * 60 + got(4)
    timed = F.exists(times(answer), lambda t: (t >= low) & (t <= high))
    framed = F.exists(frames(answer), lambda f: F.exists(allowed_frames(line), lambda a: (f["a"] <= a["b"]) & (a["a"] <= f["b"]) & (f["a"] <= f["b"])))
    return F.when(line.rlike(exact), F.contains(answer, F.regexp_extract(line, exact, 1))).when(line.rlike(between), timed | framed)


def checked(lines: DataFrame, answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Lines (question, line, text) of answers (run, question, answer) that can be checked mechanically, beside the judge's verdict (run, question, line, met): run,
    question, line, mechanical, met, agree. A line without a verdict doesn't agree."""
    rows = answers.join(lines, "question").withColumn("mechanical", mechanical(F.col("text"), F.col("answer"))).filter("mechanical is not null")
    rows = rows.join(verdicts.select("run", "question", "line", "met"), ["run", "question", "line"], "left")
    return rows.select("run", "question", "line", "mechanical", "met", F.col("met").eqNullSafe(F.col("mechanical")).alias("agree"))
