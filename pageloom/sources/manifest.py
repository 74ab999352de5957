"""JSONL manifests, version 1: strict and lenient reading, writing, and making one from quad text.

Records are parsed twice: as raw JSON texts per field, so that types can be checked as written, and as typed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.filters import manifest_error
from ..schema import BOX, DEFAULT_TASK, LINES

FIELD_NAMES = ("version", "image", "ref", "task", "bboxes", "query_text", "query_bbox")


def raw_field(value: Column, name: str) -> Column:
    """A field of a JSON object as JSON text, strings in quotes; null where absent."""
    variant = F.try_parse_json(value)
    return F.to_json(F.try_variant_get(variant, f"$.{name}", "variant"))


def raw_fields(value: Column) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), "$.version", "variant"))
    return F.when(F.try_parse_json(value).isNotNull(), F.struct(*[raw_field(value, n).alias(n) for n in FIELD_NAMES], kind.alias("version_kind")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), value without blank and # lines. A file is cut as one row, which keeps its line numbers."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rows = rows.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("k", "value"))
    return rows.select("file", (F.col("k") + 1).alias("line_no"), t.stripped(F.col("value")).alias("value")).filter("value <> '' and not startswith(value, '#')")


def unquoted(c: Column) -> Column:
    return F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds error (null where valid) and the typed fields image, ref, task, lines, has_boxes, query_text, query_bbox."""
    rows = lines.withColumn("_r", raw_fields(F.col(value))).withColumn("error", manifest_error(F.col("_r"), F.col(value)))
    r, good = F.col("_r"), F.col("error").isNull()
    box = F.from_json(r["query_bbox"], "array<double>")
    whole = F.array(F.struct(unquoted(r["ref"]).alias("text"), *[F.lit(0).alias(n) for n in ("x1", "y1", "x2", "y2")])).cast(LINES)
    boxes = F.from_json(r["bboxes"], "array<array<string>>")
    number = lambda v: F.when(v == "true", F.lit(1.0)).when(v == "false", F.lit(0.0)).otherwise(v.try_cast("double")).cast("int")
    made = F.transform(boxes, lambda b: F.struct(b[4].alias("text"), *[number(b[k]).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])).cast(LINES)
    n_boxes = F.coalesce(F.size(boxes), F.lit(0))
    return (
        rows.withColumn("image", F.when(good, unquoted(r["image"])))
        .withColumn("ref", F.when(good, unquoted(r["ref"])))
        .withColumn("task", F.when(good, F.coalesce(unquoted(r["task"]), F.lit(DEFAULT_TASK))))
        .withColumn("lines", F.when(good, F.when(n_boxes > 0, made).otherwise(whole)))
        .withColumn("has_boxes", F.when(good, r["bboxes"].isNotNull() & (r["bboxes"] != "null")))
        .withColumn("query_text", F.when(good, unquoted(r["query_text"])))
        .withColumn("query_bbox", F.when(good & (F.size(box) == 4), F.struct(*[box[k].cast("int").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])).cast(BOX))
        .drop("_r")
    )


def strict(rows: DataFrame) -> DataFrame:
    """Valid records; evaluating an invalid one fails the job with its line number."""
    say = F.raise_error(F.concat(F.lit("manifest line "), F.col("line_no").cast("string"), F.lit(": "), F.col("error")))
    return rows.withColumn("image", F.when(F.col("error").isNull(), F.col("image")).otherwise(say.cast("string"))).filter("image is not null").drop("error")


def lenient(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, quarantined lines with their error)."""
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("file", "line_no", "value", "error")


def read(spark: SparkSession, path: str) -> DataFrame:
    return strict(parsed(numbered_lines(spark, path)))


def record_json(rows: DataFrame) -> Column:
    """JSON of a record from image, ref, lines and, where present, task and query columns; null fields are left out."""
    box = lambda x: F.concat(F.lit("["), F.concat_ws(",", *[x[k].cast("string") for k in ("x1", "y1", "x2", "y2")]), F.lit(","), F.to_json(F.array(x["text"])).substr(F.lit(2), F.length(F.to_json(F.array(x["text"]))) - 2), F.lit("]"))
    head = F.to_json(F.struct(F.lit(1).alias("version"), *[F.col(c) for c in ("image", "ref", "task", "query_text") if c in rows.columns]))
    boxes = F.concat(F.lit("["), F.array_join(F.transform("lines", box), ","), F.lit("]"))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"bboxes":'), boxes, F.lit("}"))


def write(rows: DataFrame, path: str) -> int:
    """Writes valid records, all or none: the whole table is checked before a byte is written. Returns their number."""
    bad = (F.coalesce(F.col("image"), F.lit("")) == "") | F.col("ref").isNull()
    counts = rows.agg(F.count(F.lit(1)), F.count_if(bad)).first()
    if counts[1]:
        raise ValueError(f"{counts[1]} records without image or ref")
    rows.select(record_json(rows).alias("value")).write.text(path)
    return counts[0]


def from_quads(pages: DataFrame, image: Column) -> DataFrame:
    """Manifest records of quad-text pages; pages without a line are left out. ref joins the texts with blanks."""
    return pages.filter(F.size("lines") > 0).select(image.alias("image"), t.joined(F.col("lines")).alias("ref"), "lines")
