"""Page rows from shard sidecars in the two array layouts, and lines and texts of raw payloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import filters
from ..schema import DEFAULT_TASK


@dataclass(frozen=True)
class Scan:
    """Options of a shard scan; the defaults are those of nested-page shards."""

    family: str = "pdfa"
    nested: bool = True
    min_score: float = 0.5
    drop_non_latin: bool = True
    drop_blank: bool = True
    max_lines: int | None = 200
    outlier_lines: int | None = None
    outlier_words: int | None = None
    all_pages: bool = True


FLAT = Scan(family="idl", nested=False, max_lines=None)


def page_rows(payloads: DataFrame) -> DataFrame:
    """One row per page of a payload: adds page_no and page."""
    return payloads.select("*", F.posexplode("payload.pages").alias("page_no", "page")).drop("payload")


def line_texts(payloads: DataFrame, nested: bool = True) -> DataFrame:
    """shard, key, page_no, line_no, text of all lines; nulls are left out."""
    rows = page_rows(payloads)
    texts = F.col("page.lines.text") if nested else F.col("page.text")
    return rows.select("shard", "key", "page_no", F.posexplode(texts).alias("line_no", "text")).filter("text is not null")


def with_lines(pages: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """Adds ``lines`` in pixels to page rows that know their size (img_w, img_h)."""
    at = (lambda f: F.col(f"page.lines.{f}")) if scan.nested else (lambda f: F.col(f"page.{f}"))
    lines = filters.scored_lines(at("text"), at("bbox"), at("score"), F.col("img_w"), F.col("img_h"), scan.min_score)
    return pages.withColumn("lines", filters.latin_lines(lines) if scan.drop_non_latin else lines)


def kept_pages(pages: DataFrame, scan: Scan = Scan(), luminance: Column | None = None) -> DataFrame:
    """The page filters in their order: lines, empty pages, outliers, cap, then blank images where a luminance is known."""
    rows = filters.not_empty(with_lines(pages, scan))
    rows = filters.outliers(rows, scan.outlier_lines, scan.outlier_words)
    if scan.max_lines is not None:
        rows = rows.withColumn("lines", filters.capped(F.col("lines"), scan.max_lines))
    if scan.drop_blank and luminance is not None:
        rows = rows.filter(~filters.blank_image(luminance))
    if not scan.all_pages:
        first = F.row_number().over(Window.partitionBy("shard", "key").orderBy("page_no"))
        rows = rows.withColumn("_r", first).filter("_r = 1").drop("_r")
    return rows


def scan(payloads: DataFrame, sizes: DataFrame, options: Scan = Scan()) -> DataFrame:
    """Page rows of a shard scan.

    sizes(key, page_no, img_w, img_h) are the rendered pages; JSON pages without a rendered one, and the reverse, are left out.
    """
    rows = page_rows(payloads).join(sizes, ["key", "page_no"])
    kept = kept_pages(rows, options, F.col("mean_luminance") if "mean_luminance" in rows.columns else None)
    return as_pages(kept, F.concat(F.lit(f"{options.family}:"), F.col("key")), F.concat_ws("#", "key", "page_no"))


def as_pages(rows: DataFrame, source: Column, page_id: Column) -> DataFrame:
    box = "cast(null as struct<x1: int, y1: int, x2: int, y2: int>)"
    no = F.col("page_no") if "page_no" in rows.columns else F.lit(0)
    return rows.select(
        page_id.alias("page_id"), no.cast("int").alias("page_no"), F.col("img_w").cast("int").alias("img_w"), F.col("img_h").cast("int").alias("img_h"), "lines",
        F.lit(DEFAULT_TASK).alias("task"), F.lit(None).cast("string").alias("query_text"), F.expr(box).alias("query_bbox"), source.alias("source"), F.expr("cast(map() as map<string, string>)").alias("meta"),
    )
