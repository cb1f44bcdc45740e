"""Files as tables: JSON lines with a schema, content hashes, Markdown tables, question lists and outlines, and the run manifest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON lines file or folder; a missing path is an empty table, blank lines are skipped, a bad line raises."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    parsed = F.from_json("value", schema if isinstance(schema, str) else schema.json(), {"mode": "FAILFAST"})
    return lines.filter(F.trim("value") != "").select(parsed.alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Spark's committer writes beside the target and renames; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def object_hash(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))


def markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all tables: file, heading (of the last ``## `` line above), row (from 1, without header and rule), column (the header's text), text.

    Files are documents of a person's size; a table's rows stay with their file. A row with another number of cells than its header raises.
    """
    w = Window.partitionBy("file").orderBy("n")
    rows = _lines(spark, path).withColumn("heading", F.last(F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 10_000))), ignorenulls=True).over(w))
    rows = rows.withColumn("is_row", F.trim("line").startswith("|"))
    rows = rows.withColumn("table", F.sum((F.col("is_row") & ~F.coalesce(F.lag("is_row").over(w), F.lit(False))).cast("int")).over(w)).filter("is_row")
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    rows = rows.withColumn("cells", F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.regexp_replace(F.trim(c), r"\\\|", "|")))
    t = Window.partitionBy("file", "table").orderBy("n")
    rows = rows.withColumn("header", F.first("cells").over(t)).withColumn("k", F.row_number().over(t))
    rows = rows.filter((F.col("k") > 1) & ~F.forall("cells", lambda c: c.rlike("^:?-+:?$")))
    rows = rows.withColumn("row", F.row_number().over(t))
    wrong = F.size("cells") != F.size("header")
    rows = rows.withColumn("cells", F.when(wrong, F.raise_error(F.concat(F.lit("a table row has another number of cells than its header: "), "line")).cast("array<string>")).otherwise(F.col("cells")))
    cell = rows.select("file", "heading", "table", "row", F.posexplode("cells").alias("c", "text"), "header")
    return cell.select("file", "heading", "table", "row", F.get("header", F.col("c")).alias("column"), "text")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Question files: ``### Q1 (polarity, style)`` sections with Question, Reference answer and Rubric lines.

    Returns id, key (id @ six digits of the question's hash, so an edited question is another unit), polarity, style, question, reference, must and
    must_not. Lines without a mark continue the one before.
    """
    w = Window.partitionBy("file").orderBy("n")
    head = r"^### (Q\d+) \((\w+), ([\w ]+)\)"
    rows = _lines(spark, path).withColumn("id", F.last(F.nullif(F.regexp_extract("line", head, 1), F.lit("")), ignorenulls=True).over(w)).filter("id is not null")
    line = F.regexp_replace(F.trim("line"), r"\*\*", "")
    part = (
        F.when(F.col("line").rlike(head), "head").when(line.rlike("^(- )?Question:"), "question").when(line.rlike("^(- )?Reference answer:"), "reference")
        .when(line.rlike("^(- )?Rubric:"), "rubric").when(line.rlike(r"^- (M|M\d+):"), "must").when(line.rlike(r"^- (X|X\d+):"), "must_not")
    )
    rows = rows.withColumn("part", part).withColumn("item", F.sum(F.col("part").isNotNull().cast("int")).over(w)).withColumn("kind", F.last("part", ignorenulls=True).over(w))
    text = F.trim(F.regexp_replace(line, r"^(- )?(Question:|Reference answer:|Rubric:|M\d*:|X\d*:)\s*", ""))
    rows = rows.withColumn("text", text).filter("text <> '' and kind <> 'rubric'")
    items = rows.groupBy("file", "id", "item", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("text"))
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("text")))
    many = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("item", "text")))), lambda x: x["text"])
    out = items.groupBy("id").agg(pick("head").alias("head"), pick("question").alias("question"), pick("reference").alias("reference"), many("must").alias("must"), many("must_not").alias("must_not"))
    key = F.concat("id", F.lit("@"), F.substring(F.sha2(F.trim(F.regexp_replace("question", r"\s+", " ")), 256), 1, 6))
    return out.select("id", key.alias("key"), F.regexp_extract("head", head, 2).alias("polarity"), F.regexp_extract("head", head, 3).alias("style"), "question", "reference", "must", "must_not")


OUTLINE = "array<struct<start: string, end: string, title: string, gist: string>>"


def outline(texts: DataFrame, text: str = "text") -> DataFrame:
    """Chapters from the first JSON list in a text: times are seconds or h:m:s; bad and negative ranges go; numbered c1, c2, ... by start."""

    def secs(c: str) -> Column:
        parts = F.reverse(F.split(F.col(f"x.{c}"), ":"))
        return F.aggregate(F.zip_with(parts, F.array(F.lit(1.0), F.lit(60.0), F.lit(3600.0)), lambda p, m: F.coalesce(p.try_cast("double") * m, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)

    rows = texts.withColumn("_id", F.monotonically_increasing_id())
    rows = rows.select("_id", F.explode(F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), OUTLINE)).alias("x"))
    rows = rows.filter("x.start rlike '^[0-9:.]+$' and x.end rlike '^[0-9:.]+$'").select("_id", secs("start").alias("start_s"), secs("end").alias("end_s"), "x.title", "x.gist").filter("end_s > start_s")
    w = Window.partitionBy("_id").orderBy("start_s", "end_s")
    return rows.withColumn("id", F.concat(F.lit("c"), F.row_number().over(w))).drop("_id")


MANIFEST = "stage string, inputs string, config string, finished double, stats map<string,double>"


def latest(manifest: DataFrame) -> DataFrame:
    """The last entry of each stage of an append-only manifest."""
    return manifest.groupBy("stage").agg(F.max_by(F.struct("inputs", "config", "finished", "stats"), "finished").alias("x")).select("stage", "x.*")
