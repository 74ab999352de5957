"""Problem 7: mixing sources to target weights by balanced sampling (the cube method).

Each document of a source is taken ``floor(f)`` times for certain and once more with probability ``frac(f)``, f being the wanted
tokens of the source over its tokens, at most max_repeats. Which documents get the extra copy is chosen by the cube method: in
groups of bounded size, the vector of fractional probabilities moves along the null-space of the constraints (number of documents,
number of tokens) until at most two documents per group are undecided; those of many groups meet in the next round, and the last
few are landed by giving up the document count, then by chance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_rows, trimmed

GROUP_ROWS = 4096
EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, seed: int, land: bool = False) -> np.ndarray:
    """Move probabilities along the null-space of (count, size) until at most 2 are fractional; with ``land``, until none is."""
    rng, p = np.random.default_rng(seed), p.astype("float64").copy()
    queue, live = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))], []
    x, t = p.tolist(), size.astype("float64").tolist()
    draws = iter(rng.random(2 * len(queue) + 8).tolist())

    def move(units: list[int], u: list[float]) -> list[int]:
        up = min((1 - x[k]) / d if d > 0 else -x[k] / d for k, d in zip(units, u, strict=True) if d)
        down = min(x[k] / d if d > 0 else (x[k] - 1) / d for k, d in zip(units, u, strict=True) if d)
        step = up if next(draws) * (up + down) < down else -down
        for k, d in zip(units, u, strict=True):
            v = x[k] + step * d
            x[k] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
        return [k for k in units if 0.0 < x[k] < 1.0]

    while True:
        while len(live) < 3 and queue:
            live.append(queue.pop())
        if len(live) < 3:
            break
        a, b, c = (t[k] for k in live)
        u = [c - b, a - c, b - a]
        live = move(live, u if any(u) else [1.0, -1.0, 0.0])
    if land:
        while len(live) == 2:
            a, b = (t[k] for k in live)
            live = move(live, [1.0, -a / b] if a and b else [1.0, -1.0])
        for k in live:
            x[k] = 1.0 if next(draws) < x[k] else 0.0
    return np.asarray(x)


def plan(documents: DataFrame, recipe: DataFrame) -> list[dict]:
    """One dict per mix and source with its totals, wanted tokens and copies per document; the recipe is a small table."""
    rows = small_rows(recipe.select("mix_name", "source", "weight", "max_repeats"), "the recipe")
    named = documents.sparkSession.createDataFrame([((r["source"] or "").strip().lower(),) for r in rows] or [("",)], "source string").distinct()
    sums = documents.join(F.broadcast(named), "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()
    held = {r["source"]: (r["n"], r["t"] or 0) for r in sums}
    out, by_mix = [], {}
    for r in rows:
        source = (r["source"] or "").strip().lower()
        n, t = held.get(source, (0, 0))
        row = {"mix_name": r["mix_name"], "named": r["source"], "source": source, "weight": max(0.0, r["weight"] or 0.0), "max_repeats": 1 if r["max_repeats"] is None else max(0, r["max_repeats"]), "n_docs": n, "n_tokens": t}
        out.append(row)
        by_mix.setdefault(r["mix_name"], {})[source] = row
    for row in out:
        own = by_mix[row["mix_name"]].values()
        weights = sum(x["weight"] for x in out if x["mix_name"] == row["mix_name"])
        total = sum(x["n_tokens"] for x in own)
        row["wanted_share"] = row["weight"] / weights if weights else 0.0
        row["wanted_tokens"] = row["wanted_share"] * total
        row["copies"] = min(row["wanted_tokens"] / row["n_tokens"], float(row["max_repeats"])) if row["n_tokens"] else 0.0
    return out


def _settle(rows: DataFrame, groups: dict, land: bool, seed: int) -> DataFrame:
    """One round: fractional rows meet in groups of at most about GROUP_ROWS; ``groups`` has their number by mix and source."""
    spark = rows.sparkSession
    numbers = F.broadcast(spark.createDataFrame([(m, s, g) for (m, s), g in groups.items()], "mix_name string, source string, groups long"))

    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "item_id"], kind="stable")  # the largest fly first, the smallest land
        pdf = pdf.reset_index(drop=True)
        pdf["p"] = flight(pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy(), abs(hash((seed, len(pdf), int(pdf["n_tokens"].sum())))) % 2**32, land)
        return pdf.drop(columns=["bucket"])

    keyed = rows.join(numbers, ["mix_name", "source"])
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("item_id", "row", F.lit(seed)), F.col("groups"))).drop("groups")
    return keyed.groupBy("mix_name", "source", "bucket").applyInPandas(fly, "mix_name string, source string, item_id long, row long, n_tokens long, whole long, p double")


def mix(documents: DataFrame, recipe: DataFrame, seed: int = 0, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """documents(item_id, source, n_tokens), recipe(mix_name, source, weight, max_repeats) -> (chosen, report).

    chosen: mix_name, source, item_id, n_tokens, copies (0 rows are left out). report: one row per recipe row with wanted and
    reached shares and ``short`` where the sample holds max_repeats copies of all the source has and still less than its share. Sources compare trimmed and in lower case;
    documents without source or size are in no mix. A null or negative weight is 0, a null max_repeats 1; a recipe source
    without documents is short if it has a weight and its mix has tokens. Repeated ids count as documents of their own. Empty
    tables give empty results.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("item_id").cast("long").alias("item_id"), F.lower(trimmed(F.col("source"))).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens")).filter("source is not null and n_tokens is not null")
    planned = plan(docs, recipe)
    steps = {(r["mix_name"], r["source"]): r for r in planned if r["copies"] > 0}
    schema = "mix_name string, source string, whole long, p double"
    wanted = F.broadcast(spark.createDataFrame([(m, s, math.floor(r["copies"] + EPS), max(0.0, r["copies"] - math.floor(r["copies"] + EPS))) for (m, s), r in steps.items()], schema))
    rows = docs.join(wanted, "source").withColumn("row", F.monotonically_increasing_id()).select("mix_name", "source", "item_id", "row", "n_tokens", "whole", "p")
    state, counts, level = checkpoint(rows), {k: r["n_docs"] for k, r in steps.items()}, 0
    open_rows = F.col("p").between(EPS, 1 - EPS)
    while counts:
        groups = {k: math.ceil(n / group_rows) for k, n in counts.items()}
        last = max(groups.values()) == 1
        state = checkpoint(state.filter(~open_rows).unionByName(_settle(state.filter(open_rows), groups, last, seed + level)))
        counts = {} if last else {(r[0], r[1]): r[2] for r in state.filter(open_rows).groupBy("mix_name", "source").count().collect()}
        level += 1
    chosen = state.withColumn("copies", F.col("whole") + F.round("p").cast("long")).filter("copies > 0").select("mix_name", "source", "item_id", "n_tokens", "copies")
    reached = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.sum("copies").alias("reached_docs"))
    base = spark.createDataFrame(
        [(r["mix_name"], r["named"], r["source"], r["n_docs"], int(r["n_tokens"]), r["max_repeats"], float(r["wanted_share"]), float(r["wanted_tokens"])) for r in planned],
        "mix_name string, named string, source string, n_docs long, n_tokens long, max_repeats int, wanted_share double, wanted_tokens double",
    )
    report = base.join(reached, ["mix_name", "source"], "left").na.fill(0, ["reached_tokens", "reached_docs"])
    spent = F.col("reached_tokens") >= F.col("n_tokens") * F.col("max_repeats")
    report = report.withColumn("short", spent & (F.col("reached_tokens") < F.col("wanted_tokens"))).drop("max_repeats")
    totals = reached.groupBy("mix_name").agg(F.sum("reached_tokens").alias("mix_tokens"))
    report = report.join(totals, "mix_name", "left").withColumn("reached_share", F.coalesce(F.expr("reached_tokens / nullif(mix_tokens, 0)"), F.lit(0.0)))
    return chosen, report.drop("source").withColumnRenamed("named", "source")
