"""Mixing sources, slicing shards over workers, epochs, splits and sampling, all deterministic by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .serialize import numbered_globally


def check_mixture(sources: list[tuple[str, float]]) -> None:
    """At least one source, names once, weights not negative and one positive."""
    names = [n for n, _ in sources]
    if not sources or len(set(names)) < len(names) or min(w for _, w in sources) < 0 or not any(w > 0 for _, w in sources):
        raise ValueError(f"bad mixture {sources}")


def hash_ranked(rows: DataFrame, group: str, key: str, seed: int, name: str) -> DataFrame:
    """Adds the 0-based rank in hash order of the key within each group.

    Ranks are made in 64 stretches of the hash range and offset by the counts of the stretches before, so a group that holds a
    third of all rows is many tasks' work.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    cut = rows.withColumn("_h", h).withColumn("_part", F.shiftright(F.col("_h"), 58))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(group, "_part").count().select(group, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy(group, "_part").orderBy("_h", key)
    return cut.withColumn("_r", F.row_number().over(within) - 1).join(offsets, [group, "_part"]).withColumn(name, F.col("_r") + F.col("_o")).drop("_h", "_part", "_r", "_o")


def interleaved(rows: DataFrame, weights: dict[str, float], source: str = "source", key: str = "doc_id", seed: int = 0) -> DataFrame:
    """Adds mix_rank and mix_time, by which rows are to be drawn.

    Within a source the k-th row (in hash order of its key) comes at (k + u) / weight, u in [0, 1): at any time the sources have
    given rows in the ratio of their weights; an exhausted source drops out and the others go on at their own ratio. Sources of
    weight 0 or unnamed are left out.
    """
    check_mixture(list(weights.items()))
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    live = rows.filter(F.col(source).isin(*[n for n, w in weights.items() if w > 0]))
    u = t.uniform(F.col(source), F.lit(seed))
    return hash_ranked(live, source, key, seed, "mix_rank").withColumn("mix_time", (F.col("mix_rank") + u) / table[F.col(source)])


def global_order(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    return numbered_globally(rows, order, name)


def sample_counts(rows: DataFrame, source: str = "source") -> DataFrame:
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def first_draws(mixed: DataFrame, n: int) -> DataFrame:
    """The first n rows in drawing order."""
    return mixed.orderBy("mix_time", "source").limit(n)


def loader(sources: dict[str, tuple[float, DataFrame | None]], seed: int = 0, key: str = "page_id") -> DataFrame:
    """One interleaved table of several page sources; those of weight 0 are never read, one with weight but no table is an error."""
    weights = {n: w for n, (w, _) in sources.items() if w > 0}
    check_mixture([(n, w) for n, (w, _) in sources.items()])
    for n in weights:
        if sources[n][1] is None:
            raise ValueError(f"source {n} has a weight but no pages")
    tagged = [sources[n][1].withColumn("mix_source", F.lit(n)) for n in weights]
    return interleaved(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), weights, "mix_source", key, seed)


def two_source_loader(main: DataFrame, other: DataFrame, other_share: float = 0.3, seed: int = 0, key: str = "page_id") -> DataFrame:
    return loader({"main": (1 - other_share, main), "other": (other_share, other)}, seed, key)


def worker_slices(shards: DataFrame, workers: int, policy: str = "broadcast", order: str = "shard") -> DataFrame:
    """shard -> (shard, worker): every N-th shard; with fewer shards than workers either all to all, or one each and some none."""
    if policy not in ("broadcast", "cap"):
        raise ValueError(f"unknown policy {policy!r}")
    ranked = numbered_globally(shards.select(order).distinct(), [order], "shard_no")
    few = ranked.agg((F.count(F.lit(1)) < workers).alias("few"))
    every = F.transform(F.sequence(F.lit(0), F.lit(workers - 1)), lambda w: w.cast("long"))
    own = F.array((F.col("shard_no") % workers).cast("long"))
    held = F.when(F.col("few"), every).otherwise(own) if policy == "broadcast" else own
    return ranked.crossJoin(F.broadcast(few)).select(order, F.explode(held).alias("worker"))  # few is one row


def worker_seed(base: Column, worker: Column) -> Column:
    return (base.cast("long") * F.lit(100003).cast("long")).bitwiseXOR(worker.cast("long") * 31)


def epochs(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Every row once per epoch, with the order of that epoch; a narrow operation."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("epoch_order", F.xxhash64(F.lit(seed), F.col("epoch"), F.col(key)))


def uniform_sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, every row equally likely: the first in hash order."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """recorded(name, sha), current(name, sha) -> name, state: match, drift, missing (no longer there) or new."""
    both = recorded.select("name", F.col("sha").alias("old")).join(current.select("name", F.col("sha").alias("new")), "name", "full")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "match").otherwise("drift")
    return both.select("name", state.alias("state"))


def geometry_differences(held: dict, wanted: dict, fields=("canvas_h", "canvas_w", "dpi", "min_score", "source")) -> list[str]:
    """Fields in which a cache does not fit; the loader version may differ."""
    return [f for f in fields if held.get(f) != wanted.get(f)]


def shortened(rows: DataFrame, text: str, low: int, high: int, key: str, seed: int = 0) -> DataFrame:
    """Text cut at a space to a drawn length of low to high characters."""
    n = low + F.floor(t.uniform(F.col(key), F.lit(seed)) * (high - low + 1)).cast("int")
    return rows.withColumn(text, t.truncated_at_space(F.col(text), n))
