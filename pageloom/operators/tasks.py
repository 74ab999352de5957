"""Relabelling pages for several tasks, deterministically by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..schema import BOX, TASKS


def normalised(weights: dict[str, float]) -> dict[str, float]:
    """Task weights that add up to 1; unknown tasks, negative weights and all zeros are errors."""
    if set(weights) - set(TASKS) or min(weights.values(), default=0) < 0 or not sum(weights.values()):
        raise ValueError(f"bad task weights {weights}")
    return {k: v / sum(weights.values()) for k, v in weights.items()}


def drawn_task(u: Column, weights: dict[str, float]) -> Column:
    """The task whose stretch of [0, 1) holds u."""
    at, out, names = 0.0, None, [k for k, v in weights.items() if v > 0]
    share = normalised(weights)
    for name in names[:-1]:
        at += share[name]
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def fixed_task(meta: Column, family: str = "synth_handwritten") -> Column:
    """Pages of a family that keep their task."""
    return F.coalesce(meta["source_family"] == family, F.lit(False))


def relabelled(pages: DataFrame, weights: dict[str, float], key: str = "page_id", seed: int = 0) -> DataFrame:
    """New task, query_text and query_bbox for every page that isn't fixed.

    region_ocr asks for the box of one line; find_it for 2 to 11 words of one line, fewer if it has fewer. Where the page has no
    line, or the line no word, the page stays as it was.
    """
    draw = lambda salt: t.uniform(F.col(key), F.lit(seed), F.lit(salt))
    task, n = drawn_task(draw("task"), weights), F.size("lines")
    line = F.element_at("lines", 1 + F.floor(draw("line") * n).cast("int"))
    words = t.words(line["text"])
    w = F.size(words)
    take = F.greatest(F.lit(1), F.least(w, 2 + F.floor(draw("length") * 10).cast("int")))
    start = 1 + F.floor(draw("start") * (w - take + 1)).cast("int")
    query = F.array_join(F.slice(words, start, take), " ")
    box = F.struct(*[line[k].alias(k) for k in ("x1", "y1", "x2", "y2")])
    able = F.when(task == "region_ocr", n > 0).when(task == "find_it", (n > 0) & (F.when(n > 0, w).otherwise(0) > 0)).otherwise(True)
    changed = ~fixed_task(F.col("meta")) & able
    return (
        pages.withColumn("_task", F.when(changed, task))
        .withColumn("query_text", F.when(F.col("_task") == "find_it", query).when(F.col("_task").isNull(), F.col("query_text")))
        .withColumn("query_bbox", F.when(F.col("_task") == "region_ocr", box).when(F.col("_task").isNull(), F.col("query_bbox")).cast(BOX))
        .withColumn("task", F.coalesce("_task", "task"))
        .drop("_task")
    )
