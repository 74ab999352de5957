"""Detection metrics over rows that hold the boxes of a page: ``gt`` and ``pred`` arrays of boxes, ``scores`` of the predictions.

A page's boxes are one row, so no metric shuffles; the order of the arrays is the order of greedy matching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import bound
from .recognition import ratio

TR, TP = 0.8, 0.4
IOU_THRESHOLDS = (0.5, 0.6, 0.7, 0.8)


def paged(gt: DataFrame, pred: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per page of either side with its boxes in order; pages missing on one side get an empty array there."""
    fields = [F.col(k).cast("int").alias(k) for k in g.AXES]

    def gathered(df: DataFrame, extra: list[str]) -> DataFrame:
        return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *extra, F.struct(*fields).alias("b")))).alias("rows"))

    left = gathered(gt, []).select(key, F.transform("rows", lambda x: x["b"]).alias("gt"))
    right = gathered(pred, ["score"] if "score" in pred.columns else [])
    right = right.select(key, F.transform("rows", lambda x: x["b"]).alias("pred"), (F.transform("rows", lambda x: x["score"].cast("double")) if "score" in pred.columns else F.transform("rows", lambda x: F.lit(1.0))).alias("scores"))
    none = F.expr("cast(array() as array<struct<x1: int, y1: int, x2: int, y2: int>>)")
    return left.join(right, key, "full").select(key, F.coalesce("gt", none).alias("gt"), F.coalesce("pred", none).alias("pred"), F.coalesce("scores", F.expr("cast(array() as array<double>)")).alias("scores"))


def overlapping(a: DataFrame, b: DataFrame, page: str, strip: int = 24, left: str = "a", right: str = "b") -> DataFrame:
    """All pairs of rows of one page whose boxes overlap, with ``inter``: an equi join on the page and the strips a box touches.

    A pair counts in the first strip both touch; the strip's height is about that of a line.
    """
    strips = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}.y1") / strip), F.floor(F.col(f"{c}.y2") / strip)))
    both = a.withColumn("_s", strips(left)).join(b.withColumn("_s", strips(right)), [page, "_s"])
    first = F.floor(F.greatest(F.col(f"{left}.y1"), F.col(f"{right}.y1")) / strip) == F.col("_s")
    return both.filter(first).drop("_s").withColumn("inter", g.intersection(F.col(left), F.col(right))).filter("inter > 0")


def places(a: Column) -> Column:
    """0 .. size - 1, empty for an empty array."""
    return F.transform(a, lambda _, k: k)


def matching(truth: Column, guess: Column, tr: float = TR, tp: float = TP) -> Column:
    inter = g.intersection(truth, guess)
    return (inter >= tr * F.greatest(g.safe_area(truth).cast("double"), F.lit(1e-9))) & (inter >= tp * F.greatest(g.safe_area(guess).cast("double"), F.lit(1e-9)))


def deteval(gt: Column, pred: Column, tr: float = TR, tp: float = TP) -> Column:
    """precision, recall, f1. A truth takes the first free prediction that matches; one left over with several matches counts half.

    A truth left over can only match predictions that are taken, so half credits never change who is taken, and both sides can be
    counted from the one-to-one pass.
    """
    candidates = F.transform(gt, lambda a: F.filter(places(pred), lambda j: matching(a, F.get(pred, j), tr, tp)))
    start = lambda c: F.struct(F.expr("cast(array() as array<int>)").alias("used"), F.lit(0).alias("halves"), c.alias("c"))

    def take(s: Column, c: Column) -> Column:
        return bound(
            F.array_except(c, s["used"]),
            lambda free: F.struct(
                F.when(F.size(free) > 0, F.array_append(s["used"], F.get(free, F.lit(0)))).otherwise(s["used"]).alias("used"),
                (s["halves"] + ((F.size(free) == 0) & (F.size(c) > 1)).cast("int")).alias("halves"),
                s["c"].alias("c"),
            ),
        )

    def rates(s: Column) -> Column:
        one, many = F.size(s["used"]), F.size(F.filter(F.array_except(places(pred), s["used"]), lambda j: F.size(F.filter(s["c"], lambda c: F.array_contains(c, j))) > 1))
        p, r = ratio(one + 0.5 * many, F.size(pred)), ratio(one + 0.5 * s["halves"], F.size(gt))
        return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))

    full = bound(candidates, lambda c: F.aggregate(c, start(c), take, rates))
    flat = lambda v: F.struct(*[F.lit(v).alias(k) for k in ("precision", "recall", "f1")])
    return F.when((F.size(gt) == 0) & (F.size(pred) == 0), flat(1.0)).when((F.size(gt) == 0) | (F.size(pred) == 0), flat(0.0)).otherwise(full)


def union_area(boxes: Column) -> Column:
    """Exact area of the union: strips between the edges in y, interval unions in x within each."""

    def strip(bs: Column, top: Column, bottom: Column) -> Column:
        spans = F.array_sort(F.transform(F.filter(bs, lambda b: (b["y1"] <= top) & (b["y2"] >= bottom) & (b["x2"] > b["x1"])), lambda b: F.struct(b["x1"].alias("a"), b["x2"].alias("b"))))
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-(2**31) + 1).alias("end"))
        step = lambda s, x: F.struct((s["sum"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).cast("long").alias("sum"), F.greatest(s["end"], x["b"]).alias("end"))
        return F.aggregate(spans, start, step, lambda s: s["sum"]) * (bottom - top)

    def total(bs: Column) -> Column:
        edges = F.array_sort(F.array_distinct(F.flatten(F.transform(bs, lambda b: F.array(b["y1"], b["y2"])))))
        inner = lambda e: F.slice(e, 1, F.greatest(F.lit(0), F.size(e) - 1))
        return bound(edges, lambda e: F.aggregate(F.transform(inner(e), lambda y, k: strip(bs, y, F.get(e, k + 1))), F.lit(0).cast("long"), lambda a, x: a + x))

    return bound(boxes, total)


def area_f1(gt: Column, pred: Column, img_w, img_h) -> Column:
    """precision, recall, f1 of the pixels covered, boxes clipped to the page; both empty 1."""
    inside = lambda bs: F.transform(bs, lambda b: g.clipped(b, img_w, img_h))
    areas = F.struct(union_area(inside(gt)).alias("a"), union_area(inside(pred)).alias("b"), union_area(F.concat(inside(gt), inside(pred))).alias("u"))
    flat = F.struct(*[F.lit(1.0).alias(k) for k in ("precision", "recall", "f1")])

    def rates(v: Column) -> Column:
        shared = v["a"] + v["b"] - v["u"]
        p, r = ratio(shared, v["b"]), ratio(shared, v["a"])
        full = F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
        return F.when((v["a"] == 0) & (v["b"] == 0), flat).otherwise(full)

    return bound(areas, rates)


def ap_at_iou(gt: Column, pred: Column, scores: Column, threshold: float) -> Column:
    """Average precision: predictions by falling score (ties in input order), each against the best free truth (first of ties).

    Sum over true positives of precision at their rank, over the number of truths; both empty 1, one empty 0.
    """
    ranked = F.transform(F.array_sort(F.transform(pred, lambda b, k: F.struct((-F.get(scores, k)).alias("s"), k.alias("k"), b.alias("b")))), lambda x: x["b"])
    start = F.struct(F.expr("cast(array() as array<int>)").alias("used"), F.lit(0).alias("tp"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))

    def counted(s: Column, best: Column) -> Column:
        hit = F.coalesce((best["v"] >= threshold) & (best["v"] > 0), F.lit(False))
        tp, n = s["tp"] + hit.cast("int"), s["n"] + 1
        return F.struct(F.when(hit, F.array_append(s["used"], -best["j"])).otherwise(s["used"]).alias("used"), tp.alias("tp"), n.alias("n"), (s["sum"] + F.when(hit, tp / n).otherwise(0.0)).alias("sum"))

    def draw(s: Column, b: Column) -> Column:
        touching = F.filter(F.array_except(places(gt), s["used"]), lambda j: g.intersection(F.get(gt, j), b) > 0)
        best = F.array_max(F.transform(touching, lambda j: F.struct(g.iou(F.get(gt, j), b).alias("v"), (-j).alias("j"))))
        return bound(best, lambda v: counted(s, v))

    full = F.aggregate(ranked, start, draw, lambda s: s["sum"] / F.size(gt))
    return F.when((F.size(gt) == 0) & (F.size(pred) == 0), 1.0).when((F.size(gt) == 0) | (F.size(pred) == 0), 0.0).otherwise(full)


def ap_sweep(gt: Column, pred: Column, scores: Column, thresholds=IOU_THRESHOLDS) -> Column:
    return F.create_map(*[x for v in thresholds for x in (F.lit(float(v)), ap_at_iou(gt, pred, scores, v))])


def page_metrics(pages: DataFrame, img_w, img_h, expand_px: int = 0, thresholds=IOU_THRESHOLDS, tr: float = TR, tp: float = TP) -> DataFrame:
    """Adds deteval, area and ap of every page; only predictions are expanded."""
    grown = F.transform("pred", lambda b: g.expanded(b, expand_px)) if expand_px else F.col("pred")
    rows = pages.withColumn("pred", grown)
    return rows.withColumn("deteval", deteval(F.col("gt"), F.col("pred"), tr, tp)).withColumn("area", area_f1(F.col("gt"), F.col("pred"), img_w, img_h)).withColumn("ap", ap_sweep(F.col("gt"), F.col("pred"), F.col("scores"), thresholds))


def summary(measured: DataFrame, thresholds=IOU_THRESHOLDS) -> DataFrame:
    """One row: means over pages (every page counts the same)."""
    means = [F.avg(f"{m}.{k}").alias(f"{m}_{k}") for m in ("deteval", "area") for k in ("precision", "recall", "f1")]
    return measured.agg(F.count(F.lit(1)).alias("n_pages"), *means, *[F.avg(F.col("ap")[float(v)]).alias(f"ap_{int(round(100 * v))}") for v in thresholds])
