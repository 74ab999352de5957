"""Registered queries of the training-data operators and, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_kinds, mixing, near_dup, overlap, packing, reading_level, token_budget
from .oracle import ORACLE  # noqa: F401 - registered beside QUERIES
from .common import checkpoint, label_languages, load_tokenizer, small_rows, table, token_size


def sized_documents(spark: SparkSession, d: str) -> DataFrame:
    """item_id, source, n_tokens of all documents; sized once, as packing and mixing read the sizes several times."""
    size = token_size(load_tokenizer(table(spark, d, "tokenizer_vocab")), spark)
    return checkpoint(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source", size(F.coalesce("text", F.lit(""))).alias("n_tokens")))


def token_slices(spark: SparkSession, d: str) -> DataFrame:
    """The token cube of manifest after two updates: with the samples that had arrived by the middle of their time, then with all.

    Late samples bring records in, and give others another family: the second update works by signed deltas.
    """
    manifest, samples, tokenizer = table(spark, d, "manifest"), table(spark, d, "samples"), load_tokenizer(table(spark, d, "tokenizer_vocab"))
    first, last = samples.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    budget = token_budget.Budget.empty(spark)
    if first is not None:
        arrived = samples.filter(F.col("arrived_at") <= F.lit(first + (last - first) / 2))
        budget = budget.updated(*token_budget.sliced_records(manifest, arrived), tokenizer)
    return budget.updated(*token_budget.sliced_records(manifest, samples), tokenizer).slices


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.short_slices(token_slices(spark, d), table(spark, d, "token_needs"))


def p2_budget_cube(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.rollup(token_slices(spark, d))


def packed_documents(spark: SparkSession, d: str) -> DataFrame:
    sizes = sized_documents(spark, d).select("item_id", "n_tokens")
    rows = small_rows(table(spark, d, "containers").select("container", "capacity_tokens").dropna(), "containers")
    parts = [packing.pack(sizes, int(r["capacity_tokens"])).withColumn("container", F.lit(r["container"])) for r in rows]
    return reduce(DataFrame.unionByName, parts)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing put into more than one container."""
    placed = packed_documents(spark, d).groupBy("container", "item_id").agg(F.min("container_no").alias("first"), F.max("container_no").alias("last"))
    return placed.filter("first < last").select("container", F.col("item_id").alias("doc_id"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    sizes = sized_documents(spark, d).select("item_id", "n_tokens")
    rows = small_rows(table(spark, d, "containers").select("container", "capacity_tokens").dropna(), "containers")
    parts = [packing.fill_report(packing.pack(sizes, int(r[1])), int(r[1])).withColumn("container", F.lit(r[0])) for r in rows]
    return reduce(DataFrame.unionByName, parts)


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of each container size: pieces and tokens placed, pieces that occur twice, and containers that hold too much."""
    packed = packed_documents(spark, d).join(table(spark, d, "containers").select("container", "capacity_tokens"), "container").filter("container_no is not null")
    used = packed.groupBy("container", "container_no", "capacity_tokens").agg(F.sum("piece_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    full = used.groupBy("container").agg(F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.count_if(F.col("used") > F.col("capacity_tokens")).alias("n_overfull"))
    twice = packed.groupBy("container", "item_id", "piece_no").count().groupBy("container").agg(F.count_if(F.col("count") > 1).alias("n_twice"))
    return full.join(twice, "container")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix(sized_documents(spark, d), table(spark, d, "mixture_sources"))
    return report.filter("short").select("mix_name", "source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(sized_documents(spark, d), table(spark, d, "mixture_sources"))[1]


def document_items(spark: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.trim("source"))
    return table(spark, d, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("label"), F.regexp_extract(host, r"^([^_]*)", 1).alias("kind"), host.alias("host"))


def manifest_items(spark: SparkSession, d: str) -> DataFrame:
    """Refs of manifest; the host is the shard without its number, as addresses end in one."""
    host = F.regexp_extract(F.lower(F.trim("shard")), r"^(.*?)[-_0-9]*(\.\w+)?$", 1)
    return table(spark, d, "manifest").select(F.lit("manifest").alias("src"), F.col("rec_id").alias("item_id"), F.col("ref").alias("text"), F.col("lang").alias("label"), F.regexp_extract(host, r"^([^-_]*)", 1).alias("kind"), host.alias("host"))


def page_items(spark: SparkSession, d: str) -> DataFrame:
    text = F.array_join(F.transform("lines", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return table(spark, d, "maurdor_pages").select(F.lit("maurdor_pages").alias("src"), F.col("page_id").alias("item_id"), text.alias("text"), F.col("lang").alias("label"), F.lit("maurdor").alias("kind"), F.lower(F.trim("split")).alias("host"))


def all_items(spark: SparkSession, d: str) -> DataFrame:
    return document_items(spark, d).unionByName(manifest_items(spark, d)).unionByName(page_items(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language_id.mislabelled(language_id.identify(all_items(spark, d)))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every item with its confidence."""
    return language_id.identify(all_items(spark, d)).select("src", "item_id", F.explode("segments").alias("s")).select("src", "item_id", "s.*")


def lined_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and manifest records with boxes: a box is a line."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("item_id"), "text", F.lit(None).cast("long").alias("n_units"))
    boxes = F.filter("bboxes", lambda b: b.isNotNull())
    lines = F.transform(boxes, lambda b: F.regexp_replace(F.coalesce(b["text"], F.lit("")), r"\s+", " "))
    records = table(spark, d, "manifest").filter("size(bboxes) > 0")
    return docs.unionByName(records.select(F.lit("manifest").alias("src"), F.col("rec_id").alias("item_id"), F.array_join(lines, "\n").alias("text"), F.size(boxes).cast("long").alias("n_units")))


def described_items(spark: SparkSession, d: str) -> DataFrame:
    model = line_kinds.train(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), table(spark, d, "page_labels"))
    return line_kinds.describe(lined_items(spark, d), model)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return described_items(spark, d).filter("n_lines >= 4 and kind <> 'prose'").select("src", "item_id", "kind")


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return described_items(spark, d).drop("line_kinds")


def manifest_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").select(F.col("rec_id").alias("id"), F.col("ref").alias("text"), "split", "image")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = near_dup.near_duplicates(manifest_texts(spark, d))
    return near_dup.expanded(links, members, near_dup.comparable(manifest_texts(spark, d), members))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class of exact copies and the number of classes near it."""
    return near_dup.grouped(*near_dup.near_duplicates(manifest_texts(spark, d)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    records = manifest_texts(spark, d)
    pairs = overlap.text_pairs(*overlap.cross_split(records)).unionByName(overlap.image_pairs(records))
    return pairs.select(F.least("eval_id", "train_id").alias("rec_id_a"), F.greatest("eval_id", "train_id").alias("rec_id_b")).distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    records = manifest_texts(spark, d)
    _, families = token_budget.sliced_records(table(spark, d, "manifest"), table(spark, d, "samples"))
    sourced = records.join(families.withColumnRenamed("rec_id", "id"), "id", "left").fillna("none", ["source"])
    return overlap.report(sourced, *overlap.cross_split(records))


def levelled_documents(spark: SparkSession, d: str) -> DataFrame:
    items = document_items(spark, d)
    sample = language_id.sampled(items.withColumn("declared", label_languages(F.col("label"))))
    languages = language_id.fit([(text, langs) for _, text, langs in sample])
    lines = line_kinds.train(items, table(spark, d, "page_labels"))
    return reading_level.levels(items, languages, lines, reading_level.train(table(spark, d, "level_anchors"), sample, languages, lines))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.english_prose(levelled_documents(spark, d)).withColumnRenamed("item_id", "doc_id")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentences by kind and level."""
    return levelled_documents(spark, d).groupBy("kind", "level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_segments": p1_segments,
    "p2_found": p2_found,
    "p2_budget_cube": p2_budget_cube,
    "p3_found": p3_found,
    "p3_statistics": p3_statistics,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_fill": p6_fill,
    "p6_invariants": p6_invariants,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_profile": p8_profile,
}
