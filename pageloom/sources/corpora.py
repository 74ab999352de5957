"""Text corpora: sentences, paragraphs, useful lines, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.filters import useful_line
from ..operators.ordering import paragraphs
from .annotations import text_lines


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines that aren't blank."""
    return spark.read.text(path).select(t.stripped(F.col("value")).alias("text")).filter("text <> ''")


def joined_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Lines between blank lines as one text: id, paragraph_no, text."""
    return paragraphs(text_lines(spark, path).withColumnRenamed("value", "text"), ["id"], "line_no")


def dump_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a dump without blank lines and = headers."""
    return sentences(spark, path).filter("not startswith(text, '=')")


def useful_lines(lines: DataFrame, max_seen: int | None = None) -> DataFrame:
    """Lines of at least three signs, half of them letters; ``max_seen`` limits the lines looked at, not those kept."""
    rows = lines if max_seen is None else lines.limit(max_seen)
    return rows.filter(useful_line(F.col("text")))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha of the files at a path."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(t.basename(F.col("path")).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha"))
