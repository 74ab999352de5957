"""Predicates and filters over lines and pages. Cheap ones come first; those that need pixels come last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..schema import LINES, MANIFEST_VERSIONS, TASKS

# Base names of the shards of the locked splits; languages of the default page set.
LOCKED_SHARDS = {"pdfa-eng-train-0118.tar": "val", "pdfa-eng-train-0119.tar": "test"}
DEFAULT_LANGUAGES = ("en", "en+fr")


def scored_lines(texts: Column, boxes: Column, scores: Column, img_w: Column, img_h: Column, min_score: float = 0.5) -> Column:
    """Parallel arrays to lines: scored high enough, with text and a usable box; arrays count up to the shortest.

    Missing scores are 1.
    """
    n = F.least(F.size(texts), F.size(boxes), F.when(scores.isNull() | (F.size(scores) == 0), F.size(texts)).otherwise(F.size(scores)))
    filled = F.when(scores.isNull() | (F.size(scores) == 0), F.transform(texts, lambda _: F.lit(1.0))).otherwise(scores)
    zipped = F.filter(F.arrays_zip(texts.alias("text"), boxes.alias("box"), filled.alias("score")), lambda x: F.lit(True))
    rows = F.transform(F.slice(zipped, 1, F.greatest(n, F.lit(0))), lambda x: F.struct(x["text"].alias("text"), g.wire_box(x["box"], img_w, img_h).alias("b"), x["score"].alias("score")))
    kept = F.filter(rows, lambda x: (x["score"] >= min_score) & (F.coalesce(x["text"], F.lit("")) != "") & x["b"].isNotNull())
    lines = F.transform(kept, lambda x: F.struct(x["text"].alias("text"), *[x["b"][k].alias(k) for k in g.AXES]))
    return F.coalesce(lines, F.array().cast(LINES))


def latin(c: Column) -> Column:
    """Every sign that isn't white space is at most U+024F; the empty text passes."""
    return ~c.rlike(r"(?U)[^\x{0000}-\x{024F}\s]")


def latin_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: latin(x["text"]))


def blank_image(mean_luminance: Column) -> Column:
    return (mean_luminance > 0.99) | (mean_luminance < 0.01)


def not_empty(pages: DataFrame) -> DataFrame:
    return pages.filter(F.size("lines") > 0)


def word_count(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.size(t.words(x["text"])))


def outliers(pages: DataFrame, max_lines: int | None = None, max_words: int | None = None) -> DataFrame:
    """Drops pages with more lines or words than a threshold; None is off. Applied before any cap."""
    if max_lines is not None:
        pages = pages.filter(F.size("lines") <= max_lines)
    if max_words is not None:
        pages = pages.filter(word_count(F.col("lines")) <= max_words)
    return pages


def capped(lines: Column, n: int = 200) -> Column:
    return F.slice(lines, 1, n)


def paragraph_lines(paragraphs: Column, handwritten: bool = True, printed: bool = True, skip_vertical: bool = True) -> Column:
    """Lines of paragraph annotations that pass their flags, have text and a polygon with extent."""
    flat = F.flatten(F.transform(paragraphs, lambda p: F.coalesce(p["lines"], F.expr("array()"))))

    def kept(x: Column) -> Column:
        by_hand = F.coalesce(x["handwritten"], F.lit(False))
        ok = F.coalesce(x["legible"], F.lit(True)) & ~t.blank(x["text"])
        if skip_vertical:
            ok = ok & ~F.coalesce(x["vertical"], F.lit(False))
        if not handwritten:
            ok = ok & ~by_hand
        return ok & by_hand if not printed else ok

    rows = F.transform(
        F.filter(flat, kept),
        lambda x: F.struct(t.stripped(x["text"]).alias("text"), g.quad_box(F.transform(x["vertices"], lambda v: v[0]), F.transform(x["vertices"], lambda v: v[1])).alias("b")),
    )
    return F.transform(F.filter(rows, lambda x: x["b"].isNotNull()), lambda x: F.struct(x["text"].alias("text"), *[x["b"][k].alias(k) for k in g.AXES]))


def at_least(pages: DataFrame, n: int) -> DataFrame:
    return pages.filter(F.size("lines") >= n)


def in_languages(lang: Column, languages=DEFAULT_LANGUAGES) -> Column:
    return lang.isin(*languages)


def useful_line(c: Column) -> Column:
    """At least three characters, half of them letters."""
    n = F.length(c)
    return (n >= 3) & (F.regexp_count(c, F.lit(r"\p{L}")) >= 0.5 * n)


def sentence_length(c: Column) -> Column:
    return F.length(c).between(5, 500) & ~c.startswith("==")


def manifest_error(r: Column, raw: Column) -> Column:
    """First fault of a manifest record, null where it is valid. r: fields as JSON texts and the version's kind (sources.manifest)."""
    quoted = lambda c: c.startswith('"')
    boxes = F.from_json(r["bboxes"], "array<string>")
    kind = lambda b, k: F.schema_of_variant(F.try_variant_get(F.try_parse_json(b), f"$[{k}]", "variant"))
    shaped = F.forall(boxes, lambda b: F.coalesce(b.startswith("[") & (F.size(F.from_json(b, "array<string>")) == 5), F.lit(False)))
    number = lambda b, k: F.coalesce(kind(b, k).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), F.lit(False))
    numeric = F.forall(boxes, lambda b: number(b, 0) & number(b, 1) & number(b, 2) & number(b, 3))
    texts = F.forall(boxes, lambda b: F.coalesce(kind(b, 4) == "STRING", F.lit(False)))
    return (
        F.when(~raw.rlike(r"^\s*\{") | r.isNull(), "not_an_object")
        .when(r["version"].isNotNull() & (r["version_kind"] != "BIGINT"), "version_not_an_integer")
        .when(~F.coalesce(r["version"], F.lit("1")).isin(*map(str, MANIFEST_VERSIONS)), "version_not_supported")
        .when(r["image"].isNull() | ~quoted(r["image"]) | (r["image"] == '""'), "image_missing")
        .when(r["ref"].isNull() | ~quoted(r["ref"]), "ref_missing")
        .when(r["task"].isNotNull() & ~r["task"].isin(*[f'"{x}"' for x in TASKS]), "task_unknown")
        .when(r["bboxes"].isNotNull() & (r["bboxes"] != "null") & ~r["bboxes"].startswith("["), "bboxes_not_a_list")
        .when(r["bboxes"].startswith("[") & ~shaped, "bbox_shape")
        .when(r["bboxes"].startswith("[") & ~numeric, "bbox_coordinates")
        .when(r["bboxes"].startswith("[") & ~texts, "bbox_text")
    )


def same_fields(records: DataFrame, raw: str = "value", order: str = "line_no") -> DataFrame:
    """Adds missing and extra: field names that the first record has and this one lacks, and the reverse."""
    keys = F.array_sort(F.json_object_keys(F.col(raw)))
    first = records.select(F.min_by(keys, F.col(order)).alias("_first"))
    joined = records.crossJoin(F.broadcast(first))  # one row
    return joined.withColumn("missing", F.array_except("_first", keys)).withColumn("extra", F.array_except(keys, F.col("_first"))).drop("_first")


def shard_split(path: Column) -> Column:
    """Split of a shard by its base name: that of a locked shard, else train."""
    table = F.create_map(*[F.lit(x) for kv in LOCKED_SHARDS.items() for x in kv])
    return F.coalesce(table[t.basename(path)], F.lit("train"))


def guard_training(paths: list[str], allowed: tuple[str, ...] = ("train",)) -> None:
    """Stops where a training list names a locked shard."""
    for p in paths:
        base = p.rsplit("/", 1)[-1]
        split = LOCKED_SHARDS.get(base, "train")
        if split not in allowed:
            raise SystemExit(f"{base} belongs to the locked {split} split")


def without_locked(shards: DataFrame, locked: DataFrame, mode: str = "drop") -> DataFrame:
    """Shards not in the locked list; mode ``refuse`` raises where one is."""
    if mode == "refuse" and (bad := shards.join(locked, "shard", "left_semi").first()):
        raise ValueError(f"locked shard {bad['shard']}")
    return shards.join(locked, "shard", "left_anti")


def visible(original: Column, moved: Column, w: Column, h: Column, min_visibility: float = 0.5) -> Column:
    """Whether a moved box keeps enough of its area inside the page; degenerate boxes never do."""
    inside = g.clipped(moved, w, h)
    return ~g.degenerate(original) & ~g.degenerate(inside) & (g.area(inside) >= min_visibility * g.area(moved))


def covered(needed: Column, available: Column) -> Column:
    return F.size(F.array_except(needed, available)) == 0


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def main_share(*others: float) -> float:
    """Share left for the main source; it must be positive."""
    left = 1.0 - sum(others)
    if min(others, default=0.0) < 0 or left <= 0:
        raise ValueError(f"the shares {others} leave nothing for the main source")
    return left
