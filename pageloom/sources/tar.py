"""Tar shards as a Python data source: one input partition per shard, members streamed one by one.

``spark.read.format("tarshards").option("paths", json list).option("ext", "json").load()`` gives shard, key, ext, member_no,
content, error. Only members of the asked endings are read into memory, so a scan of sidecars never holds a page image. Where a
shard breaks off, a row with the error and the number of the member it was at ends it; the other shards go on.
"""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import checkpoint

SCHEMA = "shard string, key string, ext string, member_no int, content binary, error string"


class Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.wanted = {e.strip().lower() for e in options.get("ext", "").split(",") if e.strip()}
        missing = [p for p in self.paths if not os.path.exists(p)]
        if missing:
            raise FileNotFoundError(f"missing shards: {missing[:5]}")

    def partitions(self) -> list[Shard]:
        return [Shard(p) for p in self.paths]

    def read(self, partition: Shard) -> Iterator[tuple]:
        """Members in order; the key is the name up to the first dot of the file name."""
        number = 0
        try:
            with tarfile.open(partition.path, "r|*") as tar:
                for member in tar:
                    if not member.isfile():
                        continue
                    folder, _, name = member.name.rpartition("/")
                    base, _, ext = name.partition(".")
                    if not self.wanted or ext.lower() in self.wanted:
                        key = f"{folder}/{base}" if folder else base
                        content = tar.extractfile(member).read()
                        if len(content) < member.size:
                            raise tarfile.ReadError("unexpected end of data")
                        yield partition.path, key, ext.lower(), number, content, None
                    number += 1
        except (tarfile.TarError, EOFError, OSError, zlib.error) as fault:
            yield partition.path, None, None, number, None, f"{type(fault).__name__}: {fault}"


class TarShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)


def scan(spark: SparkSession, paths: list[str], ext: str = "") -> DataFrame:
    """Members and the faults of broken shards."""
    spark.dataSource.register(TarShards)
    return spark.read.format("tarshards").option("paths", json.dumps(sorted(paths))).option("ext", ext).load()


def members(spark: SparkSession, paths: list[str], ext: str = "") -> DataFrame:
    return scan(spark, paths, ext).filter("error is null").drop("error")


def records(spark: SparkSession, paths: list[str], exts: list[str]) -> DataFrame:
    """One row per key with a binary column per ending; absent members are null."""
    rows = members(spark, paths, ",".join(exts))
    return rows.groupBy("shard", "key").agg(*[F.first(F.when(F.col("ext") == e, F.col("content")), ignorenulls=True).alias(e) for e in exts])


def complete(rows: DataFrame, exts: list[str]) -> DataFrame:
    """Records that have a member of every ending."""
    return rows.dropna(subset=exts)


def _decoded(rows: DataFrame, schema: str) -> DataFrame:
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    payload = F.from_json("json", schema, {"mode": "PERMISSIVE"})
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("json").isNull(), "not UTF-8").when(F.col("payload").isNull() | F.col("payload.pages").isNull(), "no JSON of pages")
    return rows.withColumn("json", text).withColumn("payload", payload).withColumn("reason", reason).drop("content", "error", "json")


def payloads(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON members alone: shard, key, member_no, page payload; those that aren't UTF-8 or JSON of pages are in ``quarantine``."""
    return _decoded(scan(spark, paths, "json"), schema).filter("reason is null").select("shard", "key", "member_no", "payload")


def quarantine(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """shard, key, member_no, reason of what ``payloads`` leaves out: broken shards and members that can't be decoded."""
    return _decoded(scan(spark, paths, "json"), schema).filter("reason is not null").select("shard", "key", "member_no", "reason")


def write(rows: DataFrame, folder: str) -> DataFrame:
    """rows(shard, key, ext, content) -> shard, n_members of the tar files written to a shared folder.

    The folder is on a file system that all executors mount. A shard is one task's work; it gets its name when it is whole, so that a lost task's half file is never read.
    """
    folder = re.sub("^file:(//)?", "", folder)
    if "://" in folder:
        raise ValueError(f"{folder} isn't a mounted folder")
    os.makedirs(folder, exist_ok=True)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, path, n = None, None, "", 0

        def close() -> pd.DataFrame:
            out.close()
            os.replace(path, os.path.join(folder, name))
            return pd.DataFrame({"shard": [os.path.join(folder, name)], "n_members": [n]})

        for batch in batches:
            for shard, key, ext, content in zip(batch["shard"], batch["key"], batch["ext"], batch["content"], strict=True):
                if shard != name:
                    if out:
                        yield close()
                    name, path, n = shard, os.path.join(folder, f".{uuid.uuid4().hex}"), 0
                    out = tarfile.open(path, "w")
                info = tarfile.TarInfo(f"{key}.{ext}")
                info.size = len(content)
                out.addfile(info, io.BytesIO(content))
                n += 1
        if out:
            yield close()

    cols = rows.select("shard", "key", "ext", F.col("content").cast("binary").alias("content"))
    written = cols.repartition("shard").sortWithinPartitions("shard", "key", "ext").mapInPandas(pack, "shard string, n_members long")
    return checkpoint(written)  # written once, whatever reads the list


