"""Problem 6: best-fit packing of documents, sized in tokens, into containers of fixed capacity.

Bulk-synchronous best-fit on the run-length encoded order of sizes. Sizes are integers, so the range-sorted order of documents is one
row (size, count) per size: at most the capacity, and at most the root of twice the corpus's tokens (3 million rows for 5e12). The
open gaps are runs of containers likewise. A sweep takes the largest size left, finds its successor among the gaps (the smallest gap that
holds it), matches as many documents to containers as both have, resolves who gets which container by rank, updates the gaps and
repeats; what finds no gap opens containers. Ranks and assignments are computed for all documents by distributed aggregation.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task ranks: a size that more documents share is ranked in parts of about this many.
RANK_ROWS = 100_000


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Match runs (size, first rank, count, first container) of best-fit decreasing and the number of containers.

    Equal to placing documents one by one, largest first, each into the fullest container that holds it.
    """
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first container, count)
    order: list[int] = []  # gaps in use, ascending
    opened = 0

    def give(gap: int, first: int, count: int) -> None:
        if gap:
            if gap not in gaps or not gaps[gap]:
                bisect.insort(order, gap)
            gaps[gap].append((first, count))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            k = bisect.bisect_left(order, size)
            if k < len(order):
                gap = order[k]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(k)
                n = min(left, count)
                if count > n:
                    give(gap, first + n, count - n)
                runs.append((size, rank, n, first))
                give(gap - size, first, n)
            else:
                # each container opened takes as many of this size as it holds
                per = capacity // size
                n = left
                whole, rest = divmod(n, per)
                for j in range(per):
                    if whole:
                        runs.append((size, rank + j * whole, whole, opened))
                if whole:
                    give(capacity - per * size, opened, whole)
                if rest:
                    for j in range(rest):
                        runs.append((size, rank + per * whole + j, 1, opened + whole))
                    give(capacity - rest * size, opened + whole, 1)
                opened += whole + bool(rest)
            rank, left = rank + n, left - n
    return runs, opened


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """item_id, piece_no, n_pieces, piece_tokens: an item above the capacity gives full pieces and a rest, any other one piece."""
    n = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    cut = items.withColumn("n_pieces", n).select("item_id", "n_tokens", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece_no"))
    size = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece_no").cast("long") * capacity)
    return cut.select("item_id", "piece_no", "n_pieces", size.alias("piece_tokens"))


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """items(item_id, n_tokens) -> item_id, piece_no, n_pieces, piece_tokens, container_no; every piece in one container.

    Items of null or no size take no room: their container_no is null. Repeated ids are packed as often as they occur. Ties of
    size go by id. An empty table gives an empty result. Items larger than the capacity, and only they, have several pieces.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = items.sparkSession
    sized = items.select("item_id", F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
    cut = pieces(sized, capacity)
    histogram = {r[0]: r[1] for r in cut.filter("piece_tokens > 0").groupBy("piece_tokens").count().toLocalIterator()}
    hot = spark.createDataFrame([(s, -(-n // RANK_ROWS)) for s, n in histogram.items() if n > RANK_ROWS], "piece_tokens long, parts long")
    cut = cut.join(hot, "piece_tokens", "left").withColumn("part", F.pmod(F.xxhash64("item_id", "piece_no"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    before = Window.partitionBy("piece_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.join(hot, "piece_tokens", "left_semi").groupBy("piece_tokens", "part").count().select("piece_tokens", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for size, rank, _, first in best_fit(histogram, capacity)[0]:
        by_size[size].append((rank, first))
    shared = spark.sparkContext.broadcast({s: tuple(np.array(x, dtype="int64") for x in zip(*sorted(runs), strict=True)) for s, runs in by_size.items()})

    @F.pandas_udf("long")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        runs, sizes, ranks = shared.value, size.to_numpy("int64"), rank.to_numpy("int64")
        out, order = np.full(len(size), -1, dtype="int64"), np.argsort(sizes, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            found = runs.get(int(sizes[at[0]])) if len(at) else None
            if found:
                k = np.searchsorted(found[0], ranks[at], side="right") - 1
                out[at] = found[1][k] + ranks[at] - found[0][k]
        return pd.Series(out)

    within = Window.partitionBy("piece_tokens", "part").orderBy("item_id", "piece_no")
    ranked = cut.withColumn("row", F.row_number().over(within) - 1).join(offsets, ["piece_tokens", "part"], "left")
    placed = ranked.withColumn("container_no", container("piece_tokens", F.col("row") + F.coalesce("start", F.lit(0))))
    return placed.select("item_id", "piece_no", "n_pieces", "piece_tokens", F.expr("nullif(container_no, -1)").alias("container_no"))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, share of unused room."""
    used = packed.filter("container_no is not null").groupBy("container_no").agg(F.sum("piece_tokens").alias("used"))
    return used.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.max("used").alias("fullest"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * F.lit(float(capacity)))).alias("unused_share"),
    )
