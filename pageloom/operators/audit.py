"""Corpus audits: exact percentiles by three rules, layout distributions, tokenizer and shard audits, digests, run summaries.

Percentiles come from counts per value, not from collected lists: a group of any size is reduced map-side to its distinct values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from .filters import latin
from .recognition import ratio

QS = (5, 25, 50, 75, 95)

# Where in the sorted values (from 0) the q-th percentile of n of them stands.
RULES: dict[str, Callable[[Column, float], Column]] = {
    "floor": lambda n, q: F.least(n - 1, F.floor(F.lit(float(q)) * n / 100)),
    "rounded": lambda n, q: F.greatest(F.lit(0), F.least(n - 1, F.rint(F.lit(q / 100.0) * (n - 1)))).cast("long"),
    "truncated": lambda n, q: F.least(n - 1, F.floor(F.lit(q / 100.0) * n)),
}


def cumulative(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, value, upto (values of at most this one), n (all): null values don't count."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    return counts.withColumn("upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_c").over(w)).drop("_c")


def percentiles(rows: DataFrame, groups: list[str], value: str, qs=QS, rule: str = "floor") -> DataFrame:
    """groups, n, mean, min, max and one column pQ per percentile of ``value``."""
    at = RULES[rule]
    c = cumulative(rows, groups, value)
    v, n = F.col(value), F.col("n")
    own = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    c = c.withColumn("_k", F.col("upto") - F.coalesce(F.lag("upto").over(own.orderBy(value)), F.lit(0)))
    return c.groupBy(*groups).agg(
        F.max("n").alias("n"),
        (F.sum(v * F.col("_k")) / F.sum("_k")).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        *[F.min(F.when(F.col("upto") > at(n, q), v)).alias(f"p{q}") for q in qs],
    )


def medians(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, median: the mean of the middle two."""
    c = cumulative(rows, groups, value)
    n = F.col("n")
    low, high = F.min(F.when(F.col("upto") > F.floor((n - 1) / 2), F.col(value))), F.min(F.when(F.col("upto") > F.floor(n / 2), F.col(value)))
    return c.groupBy(*groups).agg(((low + high) / 2.0).alias("median"))


def line_measures(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per line: height, words, characters, aspect (width over height, null without height)."""
    x = F.col("line")
    h, w = g.height(x), g.width(x)
    rows = pages.select(*keep, F.explode("lines").alias("line"))
    return rows.select(*keep, h.alias("line_height"), F.size(t.words(x["text"])).alias("words"), F.length(x["text"]).alias("chars"), F.when(h > 0, w / h).alias("aspect"))


def page_measures(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per page: lines, words, characters and the share of the page covered by its boxes' areas."""
    total = lambda f, kind: F.aggregate("lines", F.lit(0).cast(kind), lambda a, x: a + f(x).cast(kind))
    return pages.select(
        *keep,
        F.size("lines").alias("n_lines"),
        total(lambda x: F.size(t.words(x["text"])), "long").alias("n_words"),
        total(lambda x: F.length(x["text"]), "long").alias("n_chars"),
        ratio(total(g.safe_area, "long"), F.col("img_w").cast("long") * F.col("img_h")).alias("density"),
    )


def layout_report(pages: DataFrame, by: str, qs=QS) -> DataFrame:
    """Long form: by, measure, n, mean, min, max and percentiles of line and page measures."""
    lines = line_measures(pages, by)
    out = None
    for rows, names in ((lines, ("line_height", "words", "chars", "aspect")), (page_measures(pages, by), ("n_lines", "n_words", "n_chars", "density"))):
        stacked = F.explode(F.array(*[F.struct(F.lit(x).alias("measure"), F.col(x).cast("double").alias("v")) for x in names]))
        long = rows.select(by, stacked.alias("m")).select(by, "m.*")
        out = long if out is None else out.unionByName(long)
    return percentiles(out, [by, "measure"], "v", qs)


def tokenizer_audit(lines: DataFrame, groups: list[str], tokens: str = "tokens", unknown: str = "<unk>", text: str = "text") -> DataFrame:
    """Lines, tokens, unknown tokens and lines with one, and their shares; denominators are at least 1."""
    n_unk = F.size(F.filter(F.col(tokens), lambda x: x == unknown))
    rows = lines.select(*groups, F.size(tokens).alias("n"), n_unk.alias("u"), F.length(text).alias("c"))
    sums = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("total_tokens"), F.sum("u").alias("unk_tokens"), F.count_if(F.col("u") > 0).alias("unk_lines"), F.sum("c").alias("total_chars"))
    at_least = lambda c: F.greatest(F.col(c), F.lit(1))
    return sums.withColumn("unk_line_share", F.col("unk_lines") / at_least("n_lines")).withColumn("unk_token_share", F.col("unk_tokens") / at_least("total_tokens")).withColumn("chars_per_token", F.col("total_chars") / at_least("total_tokens"))


def truncation_audit(targets: DataFrame, groups: list[str], limit: int = 2048, qs=QS) -> DataFrame:
    """Lengths of targets before clipping, and how many are longer than the limit."""
    over = targets.groupBy(*groups).agg(F.count_if(F.col("full_len") > limit).alias("n_over"))
    found = percentiles(targets, groups, "full_len", qs)
    return found.join(over, groups) if groups else found.crossJoin(over)


def shard_audit(records: DataFrame, shard: str = "shard") -> DataFrame:
    """records(shard, failed, lines, img_w, img_h), lines of a record's first page -> decode and geometry figures per shard."""
    ok = ~F.col("failed") & (F.size("lines") > 0)
    seen = F.when(ok, F.col("lines"))
    inside = lambda x: (x["x1"] >= 0) & (x["x1"] < x["x2"]) & (x["x2"] <= F.col("img_w")) & (x["y1"] >= 0) & (x["y1"] < x["y2"]) & (x["y2"] <= F.col("img_h"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    rows = records.select(
        shard,
        ok.cast("int").alias("ok"),
        F.col("failed").cast("int").alias("bad"),
        (~F.col("failed") & (F.size("lines") <= 0)).cast("int").alias("empty"),
        F.when(ok, F.size("lines")).alias("lines_of_page"),
        F.when(ok, n("lines")).otherwise(0).alias("boxes"),
        F.when(ok, n(F.filter(seen, inside))).otherwise(0).alias("inside"),
        F.when(ok, n(F.filter(seen, lambda x: ~latin(x["text"])))).otherwise(0).alias("foreign"),
    )
    sums = rows.groupBy(shard).agg(
        F.count(F.lit(1)).alias("n_attempted"), F.sum("ok").alias("decode_ok"), F.sum("empty").alias("zero_line"), F.sum("bad").alias("render_fail"), F.sum("boxes").alias("bbox_total"), F.sum("inside").alias("bbox_inside"), F.sum("foreign").alias("non_latin_lines")
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    sums = sums.withColumn("decode_ok_frac", share("decode_ok", "n_attempted")).withColumn("bbox_inside_frac", share("bbox_inside", "bbox_total")).withColumn("non_latin_frac", share("non_latin_lines", "bbox_total"))
    mid = medians(rows, [shard], "lines_of_page").withColumnRenamed("median", "median_lines")
    top = percentiles(rows, [shard], "lines_of_page", (95,), "truncated").select(shard, F.col("p95").alias("p95_lines"))
    return sums.join(mid, shard, "left").join(top, shard, "left").na.fill(0, ["median_lines", "p95_lines"])


def flagged(audit: DataFrame, threshold: float = 0.9, error: str | None = None) -> DataFrame:
    bad = F.col("decode_ok_frac") < threshold
    return audit.filter(bad | F.col(error).isNotNull() if error else bad)


def gate(audit: DataFrame, threshold: float = 0.9) -> int:
    """Exit code: 1 where any shard is flagged."""
    return int(not flagged(audit, threshold).isEmpty())


def coverage(lines: DataFrame, needed: list[str], text: str = "text") -> DataFrame:
    """One row: which of the needed characters occur, and which don't."""
    chars = lines.select(F.explode(F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), ""))).alias("c")).filter(F.col("c").isin(*needed)).distinct()
    have = chars.agg(F.array_sort(F.collect_set("c")).alias("present"))  # at most the needed characters
    return have.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, needed)), F.col("present"))))


def kept_and_dropped(lines: DataFrame, predicate: Column, groups: list[str]) -> DataFrame:
    ok = F.coalesce(predicate, F.lit(False))
    return lines.groupBy(*groups).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def stream_digest(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, digest: sha256 over ``text|x1,y1,x2,y2`` of the lines in order, each ended by a new line."""
    line = lambda x: F.concat(x["text"], F.lit("|"), F.concat_ws(",", *[x[k].cast("string") for k in g.AXES]), F.lit("\n"))
    return pages.select(key, t.digest(F.array_join(F.transform("lines", line), "")).alias("digest"))


def run_summary(history: DataFrame, run: str, step: str = "step", loss: str = "loss", window: int = 50) -> DataFrame:
    """run, n_steps, first and last mean loss over up to ``window`` steps, their difference."""
    w = Window.partitionBy(run)
    ranked = history.withColumn("_f", F.row_number().over(w.orderBy(F.col(step)))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.avg(F.when(F.col("_f") <= window, F.col(loss))).alias("loss_first"),
        F.avg(F.when(F.col("_f") > F.col("_n") - window, F.col(loss))).alias("loss_last"),
    ).withColumn("loss_delta", F.col("loss_last") - F.col("loss_first"))


def markdown(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A small result as a Markdown table; raises where it is larger than ``limit`` rows."""
    found = rows.take(limit + 1)
    if len(found) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    body = ["| " + " | ".join(show(v) for v in r) + " |" for r in found]
    return "\n".join([f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *body, ""])


def validation_summary(batches: DataFrame, run: str, order: list[str], loss: str = "loss", max_batches: int = 50) -> DataFrame:
    """run, n_batches, n_skipped, mean_loss over the first ``max_batches`` batches of a run; batches without a finite loss are skipped.

    The limit is the feature: a validation looks at no more batches. Only order and loss are sorted.
    """
    w = Window.partitionBy(run).orderBy(*order)
    seen = batches.select(run, *order, F.col(loss).cast("double").alias("_l")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_batches)
    ok = F.col("_l").isNotNull() & ~F.isnan("_l") & (F.abs("_l") < float("inf"))
    return seen.groupBy(run).agg(F.count_if(ok).alias("n_batches"), F.count_if(~ok).alias("n_skipped"), F.avg(F.when(ok, F.col("_l"))).alias("mean_loss"))
