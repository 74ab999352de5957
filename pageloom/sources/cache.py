"""Materialised page caches: Parquet pages beside a one-row manifest of the geometry they were made with."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.mixture import geometry_differences

VERSION = 1


def resized(pages: DataFrame, canvas_h: int, canvas_w: int) -> DataFrame:
    """Pages fitted to a canvas with their lines; never enlarged."""
    fit = g.fit_size(F.col("img_w"), F.col("img_h"), canvas_w, canvas_h)
    rows = pages.withColumn("_f", fit).withColumn("lines", g.scaled_lines(F.col("lines"), F.col("_f.scale")))
    return rows.withColumn("img_w", F.col("_f.w")).withColumn("img_h", F.col("_f.h")).drop("_f")


def write(pages: DataFrame, path: str, geometry: dict, key: str = "page_id") -> int:
    """Adds the pages whose key the cache lacks; returns how many. A cache of another geometry is refused.

    Keys are met by a shuffled anti join, so resuming costs a scan of one column. All columns are kept.
    """
    spark = pages.sparkSession
    held = geometry_of(spark, path)
    if held is not None:
        if wrong := geometry_differences(held, geometry):
            raise ValueError(f"the cache has another geometry in {', '.join(wrong)}")
        pages = pages.join(spark.read.parquet(f"{path}/pages").select(key), key, "left_anti")
    else:
        row = spark.createDataFrame([(json.dumps(geometry | {"loader_version": VERSION}, sort_keys=True),)], "manifest string")
        row.coalesce(1).write.text(f"{path}/_manifest")
    before = spark.read.parquet(f"{path}/pages").count() if held is not None else 0
    pages.write.mode("append").parquet(f"{path}/pages")
    return spark.read.parquet(f"{path}/pages").count() - before


def geometry_of(spark: SparkSession, path: str) -> dict | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return json.loads(spark.read.text(f"{path}/_manifest").first()[0])


def read(spark: SparkSession, path: str, geometry: dict | None = None) -> DataFrame:
    held = geometry_of(spark, path)
    if held is None:
        raise FileNotFoundError(f"no cache at {path}")
    if geometry and (wrong := geometry_differences(held, geometry)):
        raise ValueError(f"the cache has another geometry in {', '.join(wrong)}")
    return spark.read.parquet(f"{path}/pages")


def orphans(images: DataFrame, sidecars: DataFrame, key: str = "id") -> DataFrame:
    """Images without a sidecar."""
    return images.join(sidecars.select(key), key, "left_anti")
