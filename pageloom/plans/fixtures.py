"""Deterministic boxes, predictions and hypotheses over the driver's documents, in Spark and in SQL.

Every non-blank line of every document is a ground-truth line on a canvas of 1700 x 2200; all arithmetic is on integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANVAS_W, CANVAS_H = 1700, 2200


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small file would leave them in a few tasks; as they are otherwise."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() * 2 < n else df


def boxed(text: Column, doc_id: Column) -> Column:
    """Array of (line_no, text, x1, y1, x2, y2) of a text's lines that aren't blank; null for a null text."""

    def line(raw: Column, k: Column) -> Column:
        t = F.trim(raw)
        x1, y1 = F.lit(32) + (doc_id * 7 + k * 13) % 64, F.lit(20) + 24 * k
        return F.struct(k.alias("line_no"), t.alias("text"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), (x1 + 8 * F.length(t)).cast("int").alias("x2"), (y1 + 16 + (doc_id + k) % 9).cast("int").alias("y2"))

    return F.filter(F.transform(F.split(text, "\n"), line), lambda x: x["text"] != "")


def gt_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, line_no, text, x1, y1, x2, y2."""
    rows = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", F.explode(boxed(F.col("text"), F.col("doc_id"))).alias("l")).select("doc_id", "source", "l.*")


GT = """gt as (
  select doc_id, source, line_no, t as text, x1, y1, (x1 + 8 * length(t))::int as x2, (y1 + 16 + (doc_id + line_no) % 9)::int as y2 from (
    select doc_id, source, line_no, t, (32 + (doc_id * 7 + line_no * 13) % 64)::int as x1, (20 + 24 * line_no)::int as y1 from (
      select doc_id, source, (p.i - 1)::int as line_no, trim(p.s) as t
      from (select doc_id, source, unnest(list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1))) as z from documents where text is not null),
           lateral (select z[1] as s, z[2] as i) p) where t <> ''))"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    """One row per document with a line: page_id, source, img_w, img_h, lines in input order."""
    rows = spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", boxed(F.col("text"), F.col("doc_id")).alias("r")).filter("size(r) > 0")
    return rows.select(F.col("doc_id").alias("page_id"), "source", F.lit(CANVAS_W).alias("img_w"), F.lit(CANVAS_H).alias("img_h"), F.transform("r", lambda x: F.struct(x["text"].alias("text"), *[x[k].alias(k) for k in ("x1", "y1", "x2", "y2")])).alias("lines"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, line_no, k, score and box: some lines missed, some found twice, shifted, some half as wide."""
    n, line = F.col("doc_id"), F.col("line_no")
    rows = gt_lines(spark, d).filter((n * 31 + line * 17) % 11 != 0).select("*", F.explode(F.when((n * 5 + line) % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k"))
    dx, dy = (n + line) % 5 - 2, (n * 3 + line) % 3 - 1 + F.col("k")
    w = F.col("x2") - F.col("x1")
    w = F.when((n + line) % 7 == 0, F.floor(w / 2)).otherwise(w)
    return rows.select("doc_id", "line_no", "k", (((n * 97 + line * 57 + F.col("k") * 13) % 1000) / 1000.0).alias("score"), (F.col("x1") + dx).cast("int").alias("x1"), (F.col("y1") + dy).cast("int").alias("y1"), (F.col("x1") + dx + w).cast("int").alias("x2"), (F.col("y2") + dy).cast("int").alias("y2"))


PRED = """pred as (
  select doc_id, line_no, k, ((doc_id * 97 + line_no * 57 + k * 13) % 1000) / 1000.0 as score,
         x1 + dx as x1, y1 + dy as y1, x1 + dx + case when (doc_id + line_no) % 7 = 0 then (x2 - x1) // 2 else x2 - x1 end as x2, y2 + dy as y2
  from (select *, (doc_id + line_no) % 5 - 2 as dx, (doc_id * 3 + line_no) % 3 - 1 + k as dy
        from (select gt.*, unnest(case when (doc_id * 5 + line_no) % 13 = 0 then [0, 1] else [0] end) as k from gt where (doc_id * 31 + line_no * 17) % 11 <> 0)))"""


def plain(text: Column) -> Column:
    """Signs beyond ASCII as ``?``."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def misread(ref: Column, doc_id: Column, line_no: Column) -> Column:
    """Every third line has its e misread as c."""
    return F.when((doc_id + line_no) % 3 == 0, F.translate(ref, "e", "c")).otherwise(ref)


def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, line_no, ref, hyp of every line."""
    rows = gt_lines(spark, d).select("doc_id", "line_no", plain(F.col("text")).alias("ref"))
    return rows.withColumn("hyp", misread(F.col("ref"), F.col("doc_id"), F.col("line_no")))


def doc_texts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ref, hyp of whole documents."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", boxed(F.col("text"), F.col("doc_id")).alias("l")).filter("size(l) > 0")
    ref = F.transform("l", lambda x: plain(x["text"]))
    hyp = F.transform("l", lambda x: misread(plain(x["text"]), F.col("doc_id"), x["line_no"]))
    return rows.select("doc_id", F.array_join(ref, " ").alias("ref"), F.array_join(hyp, " ").alias("hyp"))


HYP = r"""hyp as (
  select doc_id, line_no, ref, case when (doc_id + line_no) % 3 = 0 then replace(ref, 'e', 'c') else ref end as hyp
  from (select doc_id, line_no, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') as ref from gt))"""


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """log, seq, ts, line: a training log per user made of the events table."""
    e = table(spark, d, "events").filter("user_id is not null and ts is not null")
    step = (F.col("event_id") % 9000).cast("string")
    kind = F.col("event_id") % 10
    number = F.format_string("%.4f", F.coalesce(F.col("value"), F.lit(0.0)))
    line = (
        F.when(kind == 0, F.concat(F.lit("STAGE "), (F.col("event_id") % 3 + 1).cast("string"), F.lit(": begin")))
        .when(kind <= 5, F.concat(F.lit("step="), step, F.lit(" loss="), F.when(F.col("event_id") % 77 == 5, "nan").otherwise(number), F.lit(" text=1.0 loc=2.0 lr=1e-4")))
        .when(kind == 6, F.concat(F.lit("validation step="), step, F.lit(" val_loss=1.5 cer=0.5 wer=0.7 word-f1=0.2 decoded=8 empty="), F.when(F.col("event_id") % 20 == 6, "8").otherwise("2")))
        .when(kind == 7, F.concat(F.lit("Checkpoint saved: x (step "), step, F.lit(")")))
        .when(kind == 8, "supervisor: chain exited with code 1")
        .otherwise("a line that is no event")
    )
    return e.select(F.col("user_id").cast("string").alias("log"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"), line.alias("line")).withColumn("ts", F.col("ts") / 1e6)
