"""Problem 4: groups of near-duplicate records, by the generalised pigeonhole over the bits of shingle sets.

A record is a sparse bit vector, one bit per shingle. Of two records of likeness 0.5 each lacks at most half of its own bits. Cut a
record's bits into partitions with thresholds whose sum of (threshold + 1) is one more than it may lack, and some partition has no
more lacking bits than its threshold. The partitions here are single bits, the smallest there are, with unequal thresholds: 0 for
the bits with the fewest estimated candidates, just as many as needed, and -1 (not probed) for all others. As one bit costs its
document frequency whatever the others do, taking them in ascending order is the best allocation, and no program is run. The search
is then that of a prefix filter. Probes pass bounds on size and on bitmaps and are verified on the texts, so no pair is lost.

Larger partitions of correlated bits, allocated by a dynamic program, gave more candidates; the README has the figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, split_join, written
from .shingles import BITMAP, MIN_DISTINCT, MIN_WORDS, classes, may_match, prefixes, sketch, verify

SIGNATURES = "sig long, id long, n int, " + ", ".join(f"{x} long" for x in BITMAP)


def near_duplicates(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records(id, text) -> (links, members).

    links: a < b, likeness: every pair of class representatives of likeness at least 0.5. members: id, rep, class: every record
    with the representative (smallest id) of its exact copies. Null, empty and short texts (under 15 words or 10 distinct ones)
    have no links and are classes of their own normalised text. Repeated ids are read as one record. Other columns are left out.
    """
    records = records.select(F.col("id").cast("long").alias("id"), "text").filter("id is not null")
    members, reps = classes(records)
    reps = written(reps)
    level = records.sparkSession.sparkContext.broadcast(sketch(reps))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            ids = batch.column(0).to_numpy()
            sig, text, _, n, maps = prefixes(batch.column(1), level.value)
            cols = [pa.array(sig.view("int64")), pa.array(ids[text]), pa.array(n[text].astype("int32")), *(pa.array(maps[text, k].view("int64")) for k in range(len(BITMAP)))]
            yield pa.RecordBatch.from_arrays(cols, ["sig", "id", "n", *BITMAP])

    sigs = reps.select("id", "text").mapInArrow(emit, SIGNATURES)
    a, b = sigs.alias("a"), sigs.alias("b")
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.id") < F.col("b.id")) & may_match("a", "b"))
    pairs = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    return verify(pairs, reps), members


def grouped(links: DataFrame, members: DataFrame) -> DataFrame:
    """id, rep, n_links of every record; links between different texts are counted for its class."""
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    return members.join(ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links")), "rep", "left").select("id", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def comparable(records: DataFrame, members: DataFrame) -> DataFrame:
    """rep of the classes with more than one member whose text is long enough to be compared."""
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep")
    words = F.filter(F.split(F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    texts = records.select(F.col("id").alias("rep"), "text").join(several, "rep", "left_semi")
    return texts.filter((F.size(words) >= MIN_WORDS) & (F.size(F.array_distinct(words)) >= MIN_DISTINCT)).select("rep").distinct()


def expanded(links: DataFrame, members: DataFrame, comparable: DataFrame) -> DataFrame:
    """All pairs of records: those of linked classes, and those within a class of comparable texts (comparable: rep)."""
    x, y = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    between = links.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    copies = members.join(comparable, "rep").select("id", "rep")
    within = split_join(copies.select(F.col("id").alias("x"), "rep"), copies.select(F.col("id").alias("y"), "rep"), "rep", "y").filter("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b"))
