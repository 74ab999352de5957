"""Problem 5: records of the evaluation splits whose text or image is also in the training split.

Exact prefix-filter join of two sides on rare shingles. Shingles have one order for all records, from the rarest (by document
frequency over all records, in a sketch of fixed size) to the most common; two texts of likeness 0.5 share at least half the
shingles of the larger, so their first shared shingle lies in the first half of both. Evaluation prefixes are indexed; training
prefixes probe them, with filters on length (sizes within a factor of two), position (what can still be shared after the first
match), and bitmap; what passes is verified on the texts. Equal texts meet as one class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, split_join, trimmed, written
from .shingles import BITMAP, content_key, may_match, needed, prefixes, sketch, verify

POSTINGS = "sig long, id long, n int, place int, " + ", ".join(f"{x} long" for x in BITMAP)
#: Log2 of the bits of the filter of indexed shingles that training tasks look into before they shuffle a posting; fixed.
FILTER_BITS = 24
EVALUATION = ("val", "validation", "dev", "test")


def side(split: Column) -> Column:
    """``train``, ``eval`` or null."""
    name = F.lower(trimmed(split))
    return F.when(name == "train", "train").when(name.isin(*EVALUATION), "eval")


def image_name(image: Column) -> Column:
    """File name without folder, ending and case; null where nothing is left."""
    name = F.lower(F.regexp_replace(F.regexp_replace(trimmed(image), r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", ""))
    return F.when(name != "", name)


def filter_bit(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << FILTER_BITS) - 1)).astype("int64")


def index_filter(evaluation: DataFrame, sk) -> np.ndarray:
    """Bits of all shingles in evaluation prefixes: 2 MB whatever the number of records."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in bounded(batches):
            seen[filter_bit(prefixes(batch.column(0), sk.value)[0])] = True
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([zlib.compress(np.packbits(seen).tobytes(), 1)], pa.binary())], ["k", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for b in batch.column(1).to_pylist():
                x = np.frombuffer(zlib.decompress(b), dtype="uint8")
                total = x if total is None else total | x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["k", "bits"])

    schema = "k long, bits binary"
    parts = evaluation.select("text").mapInArrow(bits, schema).repartition(8).mapInArrow(joined, schema).collect()
    total = np.zeros(1 << (FILTER_BITS - 3), dtype="uint8")
    for r in parts:
        total = total | np.frombuffer(zlib.decompress(r[1]), dtype="uint8")
    return total


def cross_split(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records(id, text, split) -> (links, members).

    links: a, b, likeness >= 0.5 of text classes, a with records in evaluation and b in training; a = b where one comparable text
    is in both. members: id, rep, side of the records on either side. Records of no known split are left out; null, empty and
    short texts match nothing; repeated ids and extra columns do no harm; empty tables give empty results.
    """
    records = records.select(F.col("id").cast("long").alias("id"), "text", side(F.col("split")).alias("side")).filter("id is not null and side is not null")
    keyed = records.select("id", "side", *content_key())
    least = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max(F.col("side") == "eval").alias("in_eval"), F.max(F.col("side") == "train").alias("in_train"))
    members = written(keyed.join(least, ["h1", "h2"]).select("id", "rep", "side"))  # read several times
    reps = written(records.select("id", "text").join(least.select(F.col("rep").alias("id"), "in_eval", "in_train"), "id"))
    context = records.sparkSession.sparkContext
    sk = context.broadcast(sketch(reps))
    seen = context.broadcast(index_filter(reps.filter("in_eval"), sk))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            ids = batch.column(0).to_numpy()
            sig, text, place, n, maps = prefixes(batch.column(1), sk.value)
            at = filter_bit(sig)
            hit = (seen.value[at >> 3] >> (7 - (at & 7)).astype("uint8")) & 1 > 0
            sig, text, place = sig[hit], text[hit], place[hit]
            cols = [pa.array(sig.view("int64")), pa.array(ids[text]), pa.array(n[text].astype("int32")), pa.array(place.astype("int32")), *(pa.array(maps[text, k].view("int64")) for k in range(len(BITMAP)))]
            yield pa.RecordBatch.from_arrays(cols, ["sig", "id", "n", "place", *BITMAP])

    index = reps.filter("in_eval").select("id", "text").mapInArrow(emit, POSTINGS).alias("e")
    probes = reps.filter("in_train").select("id", "text").mapInArrow(emit, POSTINGS).alias("t")
    room = F.least(F.col("e.n") - F.col("e.place"), F.col("t.n") - F.col("t.place"))
    met = index.join(probes, (F.col("e.sig") == F.col("t.sig")) & (room >= needed(F.col("e.n"), F.col("t.n"))) & may_match("e", "t"))
    copies = reps.filter("in_eval and in_train").select(F.col("id").alias("a"), F.col("id").alias("b"))
    pairs = met.filter("e.id <> t.id").select(F.col("e.id").alias("a"), F.col("t.id").alias("b")).distinct().unionByName(copies)
    return verify(pairs, reps), members


def text_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """eval_id, train_id of all linked records."""
    e = members.filter("side = 'eval'").select(F.col("id").alias("eval_id"), F.col("rep").alias("a"))
    t = members.filter("side = 'train'").select(F.col("id").alias("train_id"), F.col("rep").alias("b"))
    return links.select("a", "b").join(e, "a").join(t, "b").select("eval_id", "train_id")


def image_pairs(records: DataFrame) -> DataFrame:
    """records(id, image, split) -> eval_id, train_id of records on both sides that name the same image."""
    named = records.select(F.col("id").cast("long").alias("id"), image_name(F.col("image")).alias("name"), side(F.col("split")).alias("side")).filter("id is not null and name is not null")
    e = named.filter("side = 'eval'").select(F.col("id").alias("eval_id"), "name")
    t = named.filter("side = 'train'").select(F.col("id").alias("train_id"), "name")
    return split_join(e, t, "name", "train_id").select("eval_id", "train_id")


def report(records: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """records(id, split, image, source) -> evaluation records and those with a text or image in training, by split and source."""
    by_text = members.filter("side = 'eval'").join(links.select(F.col("a").alias("rep")).distinct(), "rep", "left_semi").select("id").withColumn("by_text", F.lit(1))
    trained = records.filter(side(F.col("split")) == "train").select(image_name(F.col("image")).alias("name")).filter("name is not null").distinct()
    held = records.filter(side(F.col("split")) == "eval").select("id", F.lower(trimmed(F.col("split"))).alias("split"), "source", image_name(F.col("image")).alias("name"))
    by_image = held.join(trained, "name", "left_semi").select("id").distinct().withColumn("by_image", F.lit(1))
    both = held.drop("name").join(by_text.distinct(), "id", "left").join(by_image, "id", "left").na.fill(0, ["by_text", "by_image"])
    return both.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("by_text").alias("n_by_text"), F.sum("by_image").alias("n_by_image"), F.sum(F.greatest("by_text", "by_image")).alias("n_overlap"))
