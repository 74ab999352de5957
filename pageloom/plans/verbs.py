"""The library's jobs: evaluate, prepare training targets, cache pages, infer, and audit, each from tables to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import audit, detection, filters, mixture, recognition, serialize, tasks
from ..predict import infer
from ..sources import cache, sinks


def evaluate(manifest: DataFrame, predicted: DataFrame, key: str = "image", expand_px: int = 0, cer_thresholds=recognition.CER_THRESHOLDS, max_docs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """manifest(key, ref, lines, has_boxes, img_w, img_h), predicted(key, lines) -> (one-row summary, rows per document).

    The reference text is the joined box texts. A document without a prediction counts with an empty one. Recognition pools over
    documents, detection averages over those with boxes. A fallback line at (0, 0, 0, 0) counts as ground truth.
    """
    docs = manifest.orderBy(key).limit(max_docs) if max_docs is not None else manifest
    hyp = predicted.select(key, F.col("lines").alias("found"))
    empty = F.expr("cast(array() as array<struct<text: string, x1: int, y1: int, x2: int, y2: int>>)")
    rows = docs.join(hyp, key, "left").withColumn("found", F.coalesce("found", empty))
    rows = rows.withColumn("ref", t.joined(F.col("lines"))).withColumn("hyp", t.joined(F.col("found")))
    rows = rows.withColumn("cer", recognition.doc_cer(F.col("ref"), F.col("hyp"))).withColumn("wer", recognition.word_errors(F.col("ref"), F.col("hyp")) / F.greatest(F.lit(1), F.size(t.words(F.col("ref")))))
    boxes = lambda c: F.transform(c, lambda x: F.struct(*[x[k].alias(k) for k in ("x1", "y1", "x2", "y2")]))
    paged = rows.filter("has_boxes").select(key, "img_w", "img_h", boxes("lines").alias("gt"), boxes("found").alias("pred"), F.transform("found", lambda _: F.lit(1.0)).alias("scores"))
    seen = detection.summary(detection.page_metrics(paged, F.col("img_w"), F.col("img_h"), expand_px))
    ap = recognition.cer_ap(rows, cer_thresholds).agg(F.map_from_entries(F.collect_list(F.struct(F.col("threshold").cast("string"), "ap"))).alias("cer_ap"))  # a row per threshold
    return recognition.summary(rows, key).crossJoin(ap).crossJoin(seen), rows.select(key, "ref", "hyp", "cer", "wer")  # one row each


def training_targets(sources: dict[str, tuple[float, DataFrame | None]], task_weights: dict[str, float], grid: serialize.Grid | None = None, seed: int = 0, limit: int = serialize.MAX_TOKENS, tokens: serialize.Tokens = t.words) -> DataFrame:
    """Mixed, relabelled and serialised pages of several sources, in drawing order by mix_time."""
    mixed = mixture.loader(sources, seed)
    return serialize.targets(tasks.relabelled(mixed, task_weights, seed=seed), grid, tokens, limit)


def check_shards(train: list[str], validation: list[str]) -> None:
    """Stops where training reads a locked shard or validation reads the test shard."""
    filters.guard_training(train)
    filters.guard_training(validation, ("train", "val"))


def cache_pages(pages: DataFrame, path: str, canvas: tuple[int, int], dpi: int = 200, min_score: float = 0.5, source: str = "pages") -> int:
    """Fits pages and boxes to a canvas (height, width) and adds the new ones to a cache."""
    geometry = {"canvas_h": canvas[0], "canvas_w": canvas[1], "dpi": dpi, "min_score": min_score, "source": source}
    return cache.write(cache.resized(pages, *canvas), path, geometry)


def infer_folder(images: DataFrame, load: Callable, path: str, meta: dict) -> None:
    """images(path, content) -> inference records beside a header."""
    sinks.inference(infer(images, load).select(F.col("path").alias("image"), "hyp"), path, meta)


def shard_report(records: DataFrame, threshold: float = 0.9) -> tuple[str, int]:
    """Markdown report of a shard audit and its exit code."""
    found = audit.shard_audit(records)
    return audit.markdown(found.orderBy("shard"), "Shard audit"), audit.gate(found, threshold)


def ablate(rows: DataFrame, variants: list[dict], run: Callable, schema: str) -> DataFrame:
    """Runs a function per variant over all rows in groups: variants are a small list, each row meets every one."""
    import json

    tagged = rows.withColumn("variant", F.explode(F.array(*[F.lit(json.dumps(v, sort_keys=True)) for v in variants])))
    return tagged.groupBy("variant").applyInPandas(run, schema)
