"""Sinks: JSON sidecars, prediction and inference records, corpora, provenance, distributions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import useful_line


def sidecar(summary: DataFrame, path: str | None = None) -> dict:
    """A one-row summary as a JSON object; null blocks are dropped."""
    row = summary.select(F.to_json(F.struct("*")).alias("j")).first()
    found = json.loads(row[0])
    if path:
        summary.coalesce(1).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    return found


def predictions(rows: DataFrame, path: str) -> None:
    """image, ref, hyp, cer, wer of every document as JSON lines."""
    rows.select("image", "ref", "hyp", "cer", "wer").write.json(path)


def inference(rows: DataFrame, path: str, meta: dict) -> None:
    """Records of an inference run beside a header of its own; a failed page has an empty hypothesis."""
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps({"_meta": meta}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/_meta")
    rows.withColumn("hyp", F.coalesce("hyp", F.lit(""))).write.json(f"{path}/records")


def corpus(lines: DataFrame, path: str) -> tuple[int, int]:
    """Writes useful stripped lines; returns how many were kept and dropped."""
    rows = lines.select(F.trim("text").alias("value"))
    ok = F.coalesce(useful_line(F.col("value")), F.lit(False))
    rows.filter(ok).write.text(path)
    kept, n = rows.agg(F.count_if(ok), F.count(F.lit(1))).first()
    return kept, n - kept


def json_table(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
