"""Command line: ``python -m pageloom VERB``. Each verb is a function of ``plans.verbs`` or ``streaming.telemetry`` on files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import audit
from .plans import verbs
from .sources import annotations, files, manifest, shards, sinks, tar
from .streaming import telemetry


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Sidecar of a manifest (JSON lines) against predictions (Parquet: image, lines, img_w, img_h)."""
    found = spark.read.parquet(a.predictions)
    records = manifest.read(spark, a.manifest).join(found.select("image", "img_w", "img_h"), "image", "left")
    summary, docs = verbs.evaluate(records, found, expand_px=a.expand, max_docs=a.max_docs)
    print(json.dumps(sinks.sidecar(summary), sort_keys=True))
    if a.out:
        sinks.predictions(docs, a.out)
    return 0


def events(spark: SparkSession, a: argparse.Namespace) -> int:
    """Events of a training log as JSON lines; a line's time is the first found in it, or that of the lines before."""
    lines = telemetry.timed(annotations.text_lines(spark, a.log).select(F.col("id").alias("log"), F.col("line_no").cast("long").alias("seq"), F.col("value").alias("line")), a.seconds_per_line)
    telemetry.events(lines).orderBy("log", "seq", "sub").write.json(a.out)
    return 0


def audit_shards(spark: SparkSession, a: argparse.Namespace) -> int:
    """Line figures of tar shards by shard, as Markdown."""
    paths = files.shard_paths(a.shards)
    verbs.check_shards(paths, [])
    texts = shards.line_texts(tar.payloads(spark, paths, shards_schema(a.layout)), a.layout == "nested")
    measured = texts.select("shard", F.length("text").alias("chars"))
    print(audit.markdown(audit.percentiles(measured, ["shard"], "chars").orderBy("shard"), "Characters a line"))
    return 0


def shards_schema(layout: str) -> str:
    from .schema import FLAT_PAGES, NESTED_PAGES

    return NESTED_PAGES if layout == "nested" else FLAT_PAGES


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pageloom")
    sub = parser.add_subparsers(required=True)
    p = sub.add_parser("eval", help=evaluate.__doc__)
    p.add_argument("manifest")
    p.add_argument("predictions")
    p.add_argument("--out")
    p.add_argument("--expand", type=int, default=0)
    p.add_argument("--max-docs", type=int)
    p.set_defaults(run=evaluate)
    p = sub.add_parser("events", help=events.__doc__)
    p.add_argument("log")
    p.add_argument("out")
    p.add_argument("--seconds-per-line", type=float, default=0.0, help="time between lines of logs without times")
    p.set_defaults(run=events)
    p = sub.add_parser("audit", help=audit_shards.__doc__)
    p.add_argument("shards")
    p.add_argument("--layout", choices=("nested", "flat"), default="nested")
    p.set_defaults(run=audit_shards)
    a = parser.parse_args(argv)
    return a.run(SparkSession.builder.appName("pageloom").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
