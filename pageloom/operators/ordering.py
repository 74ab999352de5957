"""Order-dependent operators over runs: smoothing, streaks, attempts, filling forward, islands, folds, top-k.

A run's rows stream through one sorted window; a window keeps no more than its frame in memory.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(part: list[str], order: list[str]):
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def tail_ema(value: str, part: list[str], order: list[str], window: int = 5) -> Column:
    """Exponential mean over the last k <= window values, alpha 2 / (k + 1), begun with the first of them."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-(window - 1), 0)
    tail = F.collect_list(value).over(w)
    alpha = 2.0 / (F.size(tail) + 1)
    return F.aggregate(F.slice(tail, 2, window), F.get(tail, F.lit(0)).cast("double"), lambda s, v: alpha * v + (1 - alpha) * s)


def streak(flag: Column, part: list[str], order: list[str]) -> Column:
    """Length of the run of true flags up to this row; 0 where the flag is false."""
    group = F.sum((~flag).cast("long")).over(_before(part, order))
    return F.when(flag, F.count_if(flag).over(Window.partitionBy(*part, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.lit(0))


def with_streak(rows: DataFrame, flag: Column, part: list[str], order: list[str], name: str = "streak") -> DataFrame:
    marked = rows.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_g", F.sum((~F.col("_f")).cast("long")).over(_before(part, order)))
    return marked.withColumn(name, F.sum(F.col("_f").cast("int")).over(_before([*part, "_g"], order))).drop("_f", "_g")


def with_attempts(rows: DataFrame, stage: str, part: list[str], order: list[str]) -> DataFrame:
    """Adds attempt, and stage filled forward: a header whose stage isn't above the last header's begins a new attempt.

    ``stage`` is set on header rows only. Rows before any header are stage 0, attempt 1.
    """
    last = F.last(stage, ignorenulls=True).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    again = (F.col(stage).isNotNull() & F.coalesce(F.col(stage) <= last, F.lit(False))).cast("int")
    marked = rows.withColumn("_a", again)
    return marked.withColumn("attempt", (F.lit(1) + F.sum("_a").over(_before(part, order))).cast("int")).withColumn(stage, F.coalesce(F.last(stage, ignorenulls=True).over(_before(part, order)), F.lit(0))).drop("_a")


def paragraphs(lines: DataFrame, part: list[str], order: str, text: str = "text") -> DataFrame:
    """Lines between blank lines joined by spaces: part, paragraph_no (from 0), text."""
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    marked = lines.withColumn("_b", blank).withColumn("_g", F.sum(F.col("_b").cast("int")).over(_before(part, [order])))
    joined = marked.filter(~F.col("_b")).groupBy(*part, "_g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.trim(text).alias("t")))), lambda x: x["t"]), " ").alias(text))
    return joined.withColumn("paragraph_no", F.row_number().over(Window.partitionBy(*part).orderBy("_g")) - 1).drop("_g")


def interval_union(rows: DataFrame, part: list[str], low: str = "x1", high: str = "x2") -> DataFrame:
    """part, covered: length of the union of intervals, by the highest end seen before each."""
    before = F.max(high).over(Window.partitionBy(*part).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), F.col(high) - F.greatest(F.col(low), F.coalesce(before, F.col(low))))
    return rows.withColumn("_g", gain).groupBy(*part).agg(F.sum("_g").alias("covered"))


def precision_recall(ranked: DataFrame, part: list[str], order: list[str], hit: str = "hit", total: str = "n_truth") -> DataFrame:
    """Adds running precision and recall, and the gain of recall at each row."""
    w = _before(part, order)
    tp, n = F.sum(F.col(hit).cast("int")).over(w), F.count(F.lit(1)).over(w)
    rows = ranked.withColumn("precision", tp / n).withColumn("recall", tp / F.col(total))
    return rows.withColumn("recall_gain", F.col("recall") - F.coalesce(F.lag("recall").over(Window.partitionBy(*part).orderBy(*order)), F.lit(0.0)))


def layout_cursor(lines: DataFrame, part: list[str], order: str, advance: str, top: int = 20) -> DataFrame:
    """Adds y: where each line of a column begins, after the advances of those above."""
    above = F.sum(advance).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("y", F.lit(top) + F.coalesce(above, F.lit(0)))


def last_k(rows: DataFrame, part: list[str], order: str, k: int) -> DataFrame:
    """The k rows of highest order of each part."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(F.col(order).desc()))).filter(F.col("_r") <= k).drop("_r")


def latest(rows: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    return rows.groupBy(*part).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def fold(rows: DataFrame, run: str, order: list[str], schema: str, step: Callable[[object, dict], tuple[object, dict]], start: Callable[[object], object]) -> DataFrame:
    """An ordered fold per run: ``start(run) -> state``, ``step(state, row) -> state, output``. For histories that no frame can express."""

    def go(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        state, out, names = start(key[0]), [], list(pdf.columns)
        for values in zip(*(pdf[n].tolist() for n in names), strict=True):
            state, made = step(state, dict(zip(names, values, strict=True)))
            out.append(made)
        return pd.DataFrame(out)

    return rows.groupBy(run).applyInPandas(go, schema)
