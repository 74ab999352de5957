"""Seeded synthetic pages as layouts: texts and boxes without pixels. Every row depends on its number and the seed alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..schema import LINES
from .shards import as_pages

# Words of the receipt generator, tax rate, canvases as width and height.
COMPANIES = ("Northgate Market", "Harbour Supply", "Corner Bakery", "Blue Door Books", "Old Mill Hardware")
ITEMS = ("apples", "bread", "candles", "envelopes", "hammer", "ladder", "paper", "ribbon", "soap", "tea")
TAX = 0.07
RECEIPT_CANVAS = (384, 1024)
HANDWRITTEN_CANVAS = (1050, 1400)
CHAR_W = 8


def _rng(seed: int, number: int) -> np.random.Generator:
    return np.random.default_rng([seed, number])


def _generated(spark: SparkSession, n: int, make, canvas: tuple[int, int], family: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"number": pdf["id"], "lines": [make(int(k)) for k in pdf["id"]]})

    rows = spark.range(n).mapInPandas(run, f"number long, lines {LINES}")
    rows = rows.withColumn("img_w", F.lit(canvas[0])).withColumn("img_h", F.lit(canvas[1]))
    pages = as_pages(rows, F.concat(F.lit(f"{family}:"), F.col("number").cast("string")), F.concat(F.lit(f"{family}-"), F.col("number").cast("string")))
    return pages.withColumn("meta", F.create_map(F.lit("source_family"), F.lit(family)))


def _line(text: str, x: int, y: int, h: int) -> dict:
    return {"text": text, "x1": x, "y1": y, "x2": x + CHAR_W * len(text), "y2": y + h}


def receipts(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Company, address, 3 to 8 items, subtotal, tax of 7 % and total; total = subtotal + tax to the cent."""

    def make(number: int) -> list[dict]:
        r = _rng(seed, number)
        rows = [COMPANIES[r.integers(len(COMPANIES))].upper(), f"{r.integers(1, 999)} Mill Road"]
        cents = [int(r.integers(99, 5000)) for _ in range(int(r.integers(3, 9)))]
        rows += [f"{ITEMS[r.integers(len(ITEMS))]:<14}{c / 100:>8.2f}" for c in cents]
        tax = round(sum(cents) * TAX)
        rows += [f"{name:<14}{v / 100:>8.2f}" for name, v in (("SUBTOTAL", sum(cents)), ("TAX 7%", tax), ("TOTAL", sum(cents) + tax))]
        return [_line(x, 20, 20 + 36 * k, 24) for k, x in enumerate(rows)]

    return _generated(spark, n, make, RECEIPT_CANVAS, "synth_receipts")


def handwritten(spark: SparkSession, n: int, sentences: list[str], seed: int = 0) -> DataFrame:
    """1 to 12 lines of 20 to 60 characters cut from given sentences, at heights of 32 to 72 and spacing of 1 to 1.6."""

    def make(number: int) -> list[dict]:
        r, y, out = _rng(seed, number), 20, []
        for _ in range(int(r.integers(1, 13))):
            text, size, h = sentences[r.integers(len(sentences))], int(r.integers(20, 61)), int(r.integers(32, 73))
            text = text if len(text) <= size else text[:size].rsplit(" ", 1)[0]
            if y + h > HANDWRITTEN_CANVAS[1]:
                break
            out.append(_line(text, int(r.integers(8, 33)), y, h))
            y += int(h * r.uniform(1.0, 1.6))
        return out

    return _generated(spark, n, make, HANDWRITTEN_CANVAS, "synth_handwritten")


def paged_text(texts: DataFrame, canvas_w: int = 850, canvas_h: int = 1100, line_h: int = 24, margin: int = 32, key: str = "id") -> DataFrame:
    """texts(id, text) -> pages: words wrapped to the canvas, one line below the other until it is full. Native expressions."""
    width = (canvas_w - 2 * margin) // CHAR_W
    rows = F.slice(t.wrapped(F.col("text"), width), 1, (canvas_h - 2 * margin) // line_h)
    lines = F.transform(
        rows,
        lambda x, k: F.struct(x.alias("text"), F.lit(margin).alias("x1"), (F.lit(margin) + k * line_h).alias("y1"), (F.lit(margin) + CHAR_W * F.length(x)).cast("int").alias("x2"), (F.lit(margin + line_h - 4) + k * line_h).alias("y2")),
    )
    made = texts.select(key, lines.cast(LINES).alias("lines"), F.lit(canvas_w).alias("img_w"), F.lit(canvas_h).alias("img_h")).filter("size(lines) > 0")
    return as_pages(made, F.concat(F.lit("synth_page:"), F.col(key).cast("string")), F.col(key).cast("string"))


def turned(pages: DataFrame, max_degrees: float = 1.0, seed: int = 0, min_visibility: float = 0.5) -> DataFrame:
    """Pages with their boxes turned by a drawn angle; boxes that leave the page too far are dropped."""
    angle = (t.uniform(F.col("page_id"), F.lit(seed)) * 2 - 1) * max_degrees
    rows = pages.withColumn("_a", angle)

    def moved(x):
        b = g.rotated(x, F.col("_a"), F.col("img_w") / 2, F.col("img_h") / 2)
        inside = g.clipped(b, F.col("img_w"), F.col("img_h"))
        ok = ~g.degenerate(x) & ~g.degenerate(inside) & (g.area(inside) >= min_visibility * g.area(b))
        return F.when(ok, F.struct(x["text"].alias("text"), *[inside[k].alias(k) for k in g.AXES]))

    return rows.withColumn("lines", F.filter(F.transform("lines", moved), lambda x: x.isNotNull())).drop("_a")


def mask_box(pixels: np.ndarray, below: int = 250) -> tuple[int, int, int, int] | None:
    """Extent of the dark pixels of a grey image; None where it has none."""
    ys, xs = np.nonzero(pixels < below)
    return (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1) if len(xs) else None
