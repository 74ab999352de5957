"""Problem 2: token totals per source, language and domain, kept up to date by signed deltas.

The state is a count table keyed by content hash and tokenizer hash, the slice and content of each record, and the cube. An update
encodes each content that the count table lacks once, so one over unchanged records encodes nothing; it adds to the cube what came,
subtracts what left, and does both for what changed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GreedyTokenizer, label_languages, token_size, trimmed, written

SLICE = ["source", "lang", "domain"]


def tokenizer_hash(tokenizer: GreedyTokenizer) -> str:
    return hashlib.sha256("\0".join(sorted(tokenizer.pieces)).encode()).hexdigest()[:16]


def hashed(records: DataFrame) -> DataFrame:
    """Adds h1, h2: 128 bits of content hash. Null text hashes as the empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return records.withColumn("h1", F.xxhash64(text)).withColumn("h2", F.xxhash64(text, F.lit(1)))


def count_tokens(records: DataFrame, tokenizer: GreedyTokenizer, counts: DataFrame | None = None) -> DataFrame:
    """records(..., text) -> the same rows without text, with h1, h2, n_tokens.

    ``counts`` is the count table of earlier runs; contents found there under this tokenizer aren't encoded again. Null and empty
    texts have 0 tokens; an empty table gives an empty result; repeated rows are kept.
    """
    rows, size = hashed(records), token_size(tokenizer, records.sparkSession)
    if counts is None:
        return rows.withColumn("n_tokens", size("text")).drop("text")
    known = counts.filter(F.col("tokenizer") == tokenizer_hash(tokenizer)).select("h1", "h2", F.col("n_tokens").alias("known"))
    keyed = rows.join(known, ["h1", "h2"], "left")
    old = keyed.filter("known is not null").withColumnRenamed("known", "n_tokens").drop("text")
    new = keyed.filter("known is null").drop("known").withColumn("n_tokens", size("text")).drop("text")
    return old.unionByName(new)


def count_table(counted: DataFrame, tokenizer: GreedyTokenizer, counts: DataFrame | None = None) -> DataFrame:
    """The count table (h1, h2, tokenizer, n_tokens) after a run, one row per content and tokenizer."""
    new = counted.groupBy("h1", "h2").agg(F.max("n_tokens").alias("n_tokens")).withColumn("tokenizer", F.lit(tokenizer_hash(tokenizer)))
    new = new.select("h1", "h2", "tokenizer", "n_tokens")
    return new if counts is None else counts.select(*new.columns).unionByName(new).dropDuplicates(["h1", "h2", "tokenizer"])


def cube(counted: DataFrame) -> DataFrame:
    """Records and tokens of every slice; partial sums before the shuffle, so a hot slice sends one row per task."""
    return counted.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))


def rollup(slices: DataFrame) -> DataFrame:
    """Totals by source, language and domain and all their coarser groupings; null stands for all."""
    return slices.cube(*SLICE).agg(F.sum("n_records").alias("n_records"), F.sum("n_tokens").alias("n_tokens"))


def deltas(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Signed rows between two counted states of the same records: -1 what left or changed, +1 what came or changed."""
    cols = [*SLICE, "n_tokens"]
    a = old.select(key, F.struct("h1", "h2", *cols).alias("o"))
    b = new.select(key, F.struct("h1", "h2", *cols).alias("n"))
    both = a.join(b, key, "full").filter(~F.col("o").eqNullSafe(F.col("n")))
    minus = both.filter("o is not null").select(*[F.col(f"o.{c}").alias(c) for c in cols], F.lit(-1).alias("sign"))
    plus = both.filter("n is not null").select(*[F.col(f"n.{c}").alias(c) for c in cols], F.lit(1).alias("sign"))
    return minus.unionByName(plus)


def apply_deltas(slices: DataFrame, changes: DataFrame) -> DataFrame:
    """The cube after signed deltas; slices left without records go."""
    change = changes.groupBy(*SLICE).agg(F.sum("sign").alias("n_records"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
    both = slices.select(*SLICE, "n_records", "n_tokens").unionByName(change)
    return both.groupBy(*SLICE).agg(F.sum("n_records").alias("n_records"), F.sum("n_tokens").alias("n_tokens")).filter("n_records > 0")


@dataclass
class Budget:
    """The kept state. counts: h1, h2, tokenizer, n_tokens; records: rec_id, h1, h2, slice, n_tokens; slices: the cube."""

    counts: DataFrame
    records: DataFrame
    slices: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Budget:
        slices = ", ".join(f"{c} string" for c in SLICE)
        return cls(
            spark.createDataFrame([], "h1 long, h2 long, tokenizer string, n_tokens long"),
            spark.createDataFrame([], f"rec_id long, h1 long, h2 long, {slices}, n_tokens long"),
            spark.createDataFrame([], f"{slices}, n_records long, n_tokens long"),
        )

    def updated(self, records: DataFrame, families: DataFrame, tokenizer: GreedyTokenizer) -> Budget:
        """The state for these records (rec_id unique, text, lang, domain) and their families (rec_id, source); written as tables.

        Only hashes and slices of all records are compared with the state; texts are read for contents it lacks, one record of each.
        A record that isn't among them any more, or has lost its source, is subtracted.
        """
        name = tokenizer_hash(tokenizer)
        keyed = hashed(records).select(F.col("rec_id").cast("long").alias("rec_id"), "h1", "h2", "lang", "domain").join(families, "rec_id").select("rec_id", "h1", "h2", *SLICE)
        known = self.counts.filter(F.col("tokenizer") == name).select("h1", "h2")
        unseen = keyed.select("rec_id", "h1", "h2").join(known, ["h1", "h2"], "left_anti").groupBy("h1", "h2").agg(F.min("rec_id").alias("rec_id"))
        size = token_size(tokenizer, records.sparkSession)
        new = records.select(F.col("rec_id").cast("long").alias("rec_id"), "text").join(unseen, "rec_id").select("h1", "h2", F.lit(name).alias("tokenizer"), size(F.coalesce("text", F.lit(""))).alias("n_tokens"))
        counts = self.counts.unionByName(written(new))
        held = written(keyed.join(counts.filter(F.col("tokenizer") == name).select("h1", "h2", "n_tokens"), ["h1", "h2"]).select(*self.records.columns))
        return Budget(counts, held, written(apply_deltas(self.slices, deltas(self.records, held, "rec_id"))))


def sliced_records(manifest: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, families): rec_id, text, lang, domain of each manifest record; rec_id, source of those with a sourced sample.

    The source family is the leading letters and underscores of the trimmed source in lower case; of several families of one
    record the first in order counts. Blank sources are none. Null domains are ``unknown``, labels without language ``und``.
    """
    source = F.lower(trimmed(F.col("source")))
    families = (
        samples.select("rec_id", source.alias("s")).filter("s <> '' and rec_id is not null")
        .groupBy("rec_id").agg(F.min(F.regexp_extract("s", r"^[\p{L}_]+", 0)).alias("source"))
    )
    langs = F.array_join(label_languages(F.col("lang")), "+")
    records = manifest.filter("rec_id is not null").select(
        "rec_id",
        F.col("ref").alias("text"),
        F.when(langs == "", "und").otherwise(langs).alias("lang"),
        F.coalesce(F.lower(trimmed(F.col("domain"))), F.lit("unknown")).alias("domain"),
    )
    return records, families


def short_slices(slices: DataFrame, needs: DataFrame) -> DataFrame:
    """Rows of the needs whose slice holds fewer tokens than its share of the total; a slice without records holds 0."""
    total = slices.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    held = needs.select(*SLICE, "need_per_mille").join(slices.select(*SLICE, "n_tokens"), SLICE, "left").crossJoin(F.broadcast(total))
    return held.filter("coalesce(n_tokens, 0) * 1000.0D < need_per_mille * total").select(*SLICE)
