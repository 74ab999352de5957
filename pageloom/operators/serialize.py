"""Pages to token sequences and back. Tokens are strings; a tokenizer column function turns text into its tokens.

By default text is split into words; ``predict.tokens`` gives subword tokens of a public tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..storage import checkpoint

# Special tokens in order of their ids, and the names of the control tokens.
SPECIAL_TOKENS = ("<task=ocr>", "<task=ocr_layout>", "<task=region_ocr>", "<task=find_it>", "</text>", "</location>", "<find_it>")
PAD, UNK, BOS, EOS = "<pad>", "<unk>", "<s>", "</s>"
SCHEMES = ("original", "segmented", "unified")
MAX_TOKENS = 2048

Tokens = Callable[[Column], Column]


@dataclass(frozen=True)
class Grid:
    canvas_h: int = 3508
    canvas_w: int = 2480
    quantizer: int = 10

    @property
    def n_x(self) -> int:
        return g.cells(self.canvas_w, self.quantizer)

    @property
    def n_y(self) -> int:
        return g.cells(self.canvas_h, self.quantizer)

    def x(self, px: Column) -> Column:
        return g.axis_token(px, "x", self.quantizer, self.n_x)

    def y(self, px: Column) -> Column:
        return g.axis_token(px, "y", self.quantizer, self.n_y)

    def xy(self, px: Column) -> Column:
        return g.axis_token(px, "xy", self.quantizer, max(self.n_x, self.n_y))

    def tokens(self, unified: bool = False) -> Column:
        return g.grid_tokens(self.canvas_w, self.canvas_h, self.quantizer, unified)


def vocabulary(grid: Grid, unified: bool = False) -> Column:
    return F.concat(F.array(*map(F.lit, SPECIAL_TOKENS)), grid.tokens(unified))


def reading_order(lines: Column) -> Column:
    """Top to bottom, left to right; lines of equal corner keep their order."""
    numbered = F.transform(lines, lambda x, k: F.struct(x["y1"].alias("a"), x["x1"].alias("b"), k.alias("k"), x.alias("line")))
    return F.transform(F.array_sort(numbered), lambda s: s["line"])


def _four(x: Column, first: Callable, second: Callable) -> tuple[Column, Column]:
    return F.array(first(x["x1"]), second(x["y1"])), F.array(first(x["x2"]), second(x["y2"]))


def serialised(lines: Column, grid: Grid, scheme: str = "original", tokens: Tokens = t.words) -> Column:
    """Token array of a page's lines in reading order.

    original: near corner, text, far corner of each line; segmented: all texts, </text>, all corners, </location>; unified: as
    original with one coordinate vocabulary for both axes.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}")
    ordered = reading_order(lines)
    if scheme == "segmented":
        text = F.flatten(F.transform(ordered, lambda x: tokens(x["text"])))
        corners = F.flatten(F.transform(ordered, lambda x: F.concat(*_four(x, grid.x, grid.y))))
        return F.concat(text, F.array(F.lit("</text>")), corners, F.array(F.lit("</location>")))
    first, second = (grid.xy, grid.xy) if scheme == "unified" else (grid.x, grid.y)

    def one(x: Column) -> Column:
        near, far = _four(x, first, second)
        return F.concat(near, tokens(x["text"]), far)

    return F.flatten(F.transform(ordered, one))


def prompt(task: Column, query_text: Column, query_bbox: Column, tokens: Tokens = t.words) -> Column:
    """Token array that asks for a task."""
    b = query_bbox
    where = F.format_string("Read at %d,%d,%d,%d", b["x1"], b["y1"], b["x2"], b["y2"])
    tag = F.array(F.concat(F.lit("<task="), task, F.lit(">")))
    return (
        F.when(task == "region_ocr", F.concat(tag, tokens(where)))
        .when(task == "find_it", F.concat(tag, F.array(F.lit("<find_it>")), tokens(F.coalesce(query_text, F.lit("")))))
        .otherwise(tag)
    )


def answer(task: Column, lines: Column, query_text: Column, query_bbox: Column, grid: Grid, tokens: Tokens = t.words) -> Column:
    """Token array that a task is answered with.

    ocr: texts in input order; ocr_layout: the original scheme; region_ocr: texts of the lines inside the query box, which must be
    given; find_it: four corner tokens of every line that holds the trimmed query.
    """
    wanted = t.stripped(F.coalesce(query_text, F.lit("")))
    inside = F.filter(lines, lambda x: g.contains(query_bbox, x))
    holding = F.filter(lines, lambda x: F.contains(x["text"], wanted))
    texts = lambda ls: F.flatten(F.transform(ls, lambda x: tokens(x["text"])))
    return (
        F.when(task == "ocr", texts(lines))
        .when(task == "ocr_layout", serialised(lines, grid, "original", tokens))
        .when(task == "region_ocr", F.when(query_bbox.isNull(), F.raise_error(F.lit("region_ocr without query_bbox")).cast("array<string>")).otherwise(texts(inside)))
        .when(task == "find_it", F.flatten(F.transform(holding, lambda x: F.concat(*_four(x, grid.x, grid.y)))))
        .otherwise(F.raise_error(F.concat(F.lit("unknown task "), F.coalesce(task, F.lit("null")))).cast("array<string>"))
    )


def framed(prompt_tokens: Column, output: Column, limit: int | None = MAX_TOKENS) -> Column:
    """tokens, prompt_len, full_len: begin, prompt, output, end; clipped in the output so that the end mark stays."""
    n_prompt = 1 + F.size(prompt_tokens)
    room = output if limit is None else F.slice(output, 1, F.greatest(F.lit(0), F.lit(limit - 1) - n_prompt))
    return F.struct(
        F.concat(F.array(F.lit(BOS)), prompt_tokens, room, F.array(F.lit(EOS))).alias("tokens"),
        n_prompt.alias("prompt_len"),
        (n_prompt + F.size(output) + 1).alias("full_len"),
    )


def targets(pages: DataFrame, grid: Grid | None = None, tokens: Tokens = t.words, limit: int | None = MAX_TOKENS) -> DataFrame:
    """Adds tokens, prompt_len and full_len of every page's task."""
    grid, c = grid or Grid(), F.col
    f = framed(prompt(c("task"), c("query_text"), c("query_bbox"), tokens), answer(c("task"), c("lines"), c("query_text"), c("query_bbox"), grid, tokens), limit)
    return pages.withColumn("_f", f).select(*pages.columns, "_f.*")


def teacher_forced(rows: DataFrame, width: Column | int) -> DataFrame:
    """Adds input, label (one later) and prompt_mask, filled to ``width`` on the right."""
    n = F.size("tokens") - 1
    width = F.lit(width) if isinstance(width, int) else width
    fill = lambda a, v: F.concat(a, F.array_repeat(v, F.greatest(F.lit(0), width - n)))
    return (
        rows.withColumn("input", fill(F.slice("tokens", 1, n), F.lit(PAD)))
        .withColumn("label", fill(F.slice("tokens", 2, n), F.lit(PAD)))
        .withColumn("prompt_mask", fill(F.transform(F.sequence(F.lit(0), n - 1), lambda j: j < F.col("prompt_len") - 1), F.lit(False)))
    )


def numbered_globally(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a 0-based global rank by ``order`` without one task seeing all rows; rows of equal order get ranks in any order.

    Range partitions are sorted and numbered once and kept in the shared folder: planned twice they would be cut at other bounds.
    Their sizes, one row a partition, then give each partition its offset.
    """
    spark = rows.sparkSession
    kept = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()))
    part = F.shiftright("_i", 33).cast("int")
    offsets, at = [], 0
    for p, n in sorted(kept.groupBy(part).count().collect()):
        offsets.append((p, at))
        at += n
    table = F.broadcast(spark.createDataFrame(offsets, "_p int, _o long"))
    return kept.withColumn("_p", part).join(table, "_p").withColumn(name, F.col("_i").bitwiseAND((1 << 33) - 1) + F.col("_o")).drop("_p", "_o", "_i")


def micro_batches(rows: DataFrame, size: int, order: list[str], lane: list[str] | None = None) -> DataFrame:
    """Adds batch_no and batch_row: groups of ``size`` in order, the last one partial; within each lane (shard) if given."""
    if lane:
        rank = F.row_number().over(Window.partitionBy(*lane).orderBy(*order)) - 1
        rows = rows.withColumn("_n", rank)
    else:
        rows = numbered_globally(rows, order, "_n")
    return rows.withColumn("batch_no", F.floor(F.col("_n") / size)).withColumn("batch_row", (F.col("_n") % size).cast("int")).drop("_n")


def padded_batch_size(rows: DataFrame, multiple: int = 32, batch: str = "batch_no") -> DataFrame:
    """Adds pad_w and pad_h: the largest page of the batch, up to a multiple."""
    w = Window.partitionBy(batch)
    return rows.withColumn("pad_w", g.up_to_multiple(F.max("img_w").over(w), multiple)).withColumn("pad_h", g.up_to_multiple(F.max("img_h").over(w), multiple))


def token_class(token: Column) -> Column:
    return F.when(token.rlike(r"^<(x|y|xy)_\d+>$"), "spatial").when(token.isin(*SPECIAL_TOKENS, PAD, UNK, BOS, EOS), "special").otherwise("text")


def class_counts(tokens: Column, mask: Column) -> Column:
    """n_text and n_loc of the label tokens that are neither filling nor prompt."""
    valid = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: ~x["m"] & (x["t"] != PAD))
    loc = F.size(F.filter(valid, lambda x: token_class(x["t"]) == "spatial"))
    return F.struct((F.size(valid) - loc).alias("n_text"), loc.alias("n_loc"))


def plain_text(tokens: Column, sep: str = " ") -> Column:
    """Text of an answer without marks and coordinates."""
    return F.array_join(F.filter(tokens, lambda x: token_class(x) == "text"), sep)


def answer_boxes(tokens: Column, quantizer: int = 10) -> Column:
    """Boxes of a find_it answer: spatial tokens by fours; an incomplete rest is dropped."""
    spatial = F.filter(tokens, lambda x: token_class(x) == "spatial")
    n = F.floor(F.size(spatial) / 4).cast("int")
    px = lambda k: g.token_px(F.element_at(spatial, k), quantizer)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: g.box(px(4 * k + 1), px(4 * k + 2), px(4 * k + 3), px(4 * k + 4)))).otherwise(F.expr("cast(array() as array<struct<x1: int, y1: int, x2: int, y2: int>>)"))


def parse(tokens: list[str], quantizer: int = 10) -> list[dict]:
    """Lines of a sequence in the original scheme; a small machine over corners and text.

    A corner is an x token followed by a y token. What precedes the first corner is skipped; a line ends at the next x token, which
    must begin a corner, or it is tried as the start of a new line; an unfinished line at the end is dropped.
    """
    number = lambda s: int(s[3:-1]) * quantizer
    out: list[dict] = []
    near, text, k, end = None, [], 0, len(tokens or ())
    while k < end:
        token = tokens[k]
        corner = token.startswith("<x_") and k + 1 < end and tokens[k + 1].startswith("<y_")
        if near is None:
            if corner:
                near, text = (number(token), number(tokens[k + 1])), []
            k += 2 if corner else 1
        elif not token.startswith("<x_"):
            text.append(token)
            k += 1
        elif corner:
            out.append({"text": " ".join(text), "x1": near[0], "y1": near[1], "x2": number(token), "y2": number(tokens[k + 1])})
            near, k = None, k + 2
        else:
            near = None  # a broken corner: look for a new line from here
    return out


def parsed(rows: DataFrame, column: str = "tokens", quantizer: int = 10) -> DataFrame:
    """Adds parsed_lines by an Arrow UDF; null sequences give no lines."""
    from ..schema import LINES

    @F.pandas_udf(LINES)
    def machine(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda seq: parse([] if seq is None else list(seq), quantizer))

    return rows.withColumn("parsed_lines", machine(column))
