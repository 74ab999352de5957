"""Scans of annotation files: paragraph polygons, form XML, language pages, quad text, and eval sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import filters
from ..schema import LANGUAGE_PAGE, LINES, PARAGRAPHS
from .shards import as_pages

# Image endings in the order they are tried.
IMAGE_ENDINGS = (".tif", ".tiff", ".png", ".jpg", ".jpeg")


def paragraph_pages(rows: DataFrame, handwritten: bool = True, printed: bool = True, skip_vertical: bool = True, min_lines: int = 1, family: str = "hiertext") -> DataFrame:
    """rows(image_id, annotations, img_w, img_h) -> pages. Annotations are a struct, a JSON string or its bytes."""
    kind = dict(rows.dtypes)["annotations"]
    if not kind.startswith("struct"):
        rows = rows.withColumn("annotations", F.from_json(F.col("annotations").cast("string"), PARAGRAPHS))
    lines = filters.paragraph_lines(F.coalesce("annotations.paragraphs", F.expr("array()")), handwritten, printed, skip_vertical)
    rows = filters.at_least(rows.withColumn("lines", F.coalesce(lines, F.array().cast(LINES))), min_lines)
    return as_pages(rows, F.concat(F.lit(f"{family}:"), F.col("image_id")), F.col("image_id").cast("string"))


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers of a split list, one per line; blank lines are skipped and a missing file is an error."""
    return spark.read.text(path).select(t.stripped(F.col("value")).alias("id")).filter("id <> ''")


def listed_images(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, id, ending of the files below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select("path", t.stem(F.col("path")).alias("id"), t.extension(F.col("path")).alias("ending"), "length")


def folder_images(spark: SparkSession, root: str) -> DataFrame:
    return listed_images(spark, root).filter(F.col("ending").isin(*IMAGE_ENDINGS)).orderBy("path")


def best_image(images: DataFrame) -> DataFrame:
    """One file per id, by the order of endings."""
    rank = F.array_position(F.array(*map(F.lit, IMAGE_ENDINGS)), F.col("ending"))
    return images.filter(rank > 0).groupBy("id").agg(F.min_by("path", rank).alias("image"))


_XML = "array<struct<_text: string, _asx: int, _asy: int, _asw: int, _ash: int, word: array<struct<cmp: array<struct<_x: int, _y: int, _width: int, _height: int>>>>>>"
FORM = f"struct<`handwritten-part`: struct<line: {_XML}>>"


def form_lines(xml: Column) -> Column:
    """Lines of a form's XML: the line's own box, else the box around its words' parts; blank texts are left out.

    Null where the XML can't be parsed.
    """
    parsed = F.from_xml(xml, FORM, {"rowTag": "form", "attributePrefix": "_"})
    rows = parsed["handwritten-part"]["line"]
    parts = lambda x: F.flatten(F.transform(F.coalesce(x["word"], F.expr("array()")), lambda w: F.coalesce(w["cmp"], F.expr("array()"))))

    def line(x: Column) -> Column:
        p = parts(x)
        edge = lambda f, pick: pick(F.transform(p, f))
        own = x["_asx"].isNotNull() & x["_asy"].isNotNull() & x["_asw"].isNotNull() & x["_ash"].isNotNull()
        around = g.box(edge(lambda c: c["_x"], F.array_min), edge(lambda c: c["_y"], F.array_min), edge(lambda c: c["_x"] + c["_width"], F.array_max), edge(lambda c: c["_y"] + c["_height"], F.array_max))
        b = F.when(own, g.from_extent(x["_asx"], x["_asy"], x["_asw"], x["_ash"])).otherwise(around)
        return F.struct(t.stripped(F.coalesce(x["_text"], F.lit(""))).alias("text"), *[b[k].alias(k) for k in g.AXES])

    made = F.filter(F.transform(rows, line), lambda x: (x["text"] != "") & x["x1"].isNotNull())
    return F.when(parsed.isNotNull(), F.coalesce(made, F.array().cast(LINES)))


def form_pages(forms: DataFrame, ids: DataFrame, images: DataFrame, drop_empty: bool = True, family: str = "iam") -> tuple[DataFrame, DataFrame]:
    """forms(id, xml), ids(id), images(id, img_w, img_h) -> (pages, skipped ids with the reason)."""
    joined = ids.join(forms, "id", "left").join(images, "id", "left").withColumn("lines", form_lines(F.col("xml")))
    reason = F.when(F.col("xml").isNull(), "no annotation").when(F.col("img_w").isNull(), "no image").when(F.col("lines").isNull(), "not parsed")
    marked = joined.withColumn("reason", reason)
    good = marked.filter("reason is null")
    pages = as_pages(filters.not_empty(good) if drop_empty else good, F.concat(F.lit(f"{family}:"), F.col("id")), F.col("id"))
    return pages, marked.filter("reason is not null").select("id", "reason")


def language_lines(lines: Column) -> Column:
    """Lines with a box of four numbers (``bbox``, else ``box``) and a text that isn't blank; boxes without extent stay."""
    b = lambda x: F.coalesce(x["bbox"], x["box"])
    kept = F.filter(lines, lambda x: (F.coalesce(F.size(b(x)), F.lit(0)) == 4) & ~t.blank(x["text"]))
    return F.transform(kept, lambda x: F.struct(x["text"].alias("text"), *[b(x)[k].cast("int").alias(n) for k, n in enumerate(g.AXES)]))


def language_pages(rows: DataFrame, images: DataFrame, languages=filters.DEFAULT_LANGUAGES, family: str = "maurdor") -> DataFrame:
    """rows(id, json), images(id, path, ending, img_w, img_h) -> pages in the wanted languages that have a line and an image."""
    page = rows.select("id", F.from_json("json", LANGUAGE_PAGE).alias("p")).filter(filters.in_languages(F.col("p.lang"), languages))
    rank = F.array_position(F.array(*map(F.lit, IMAGE_ENDINGS)), F.col("ending"))
    best = images.filter(rank > 0).groupBy("id").agg(F.min_by(F.struct("path", "img_w", "img_h"), rank).alias("i"))
    made = page.withColumn("lines", language_lines(F.col("p.lines"))).join(best, "id").select("id", "lines", "i.img_w", "i.img_h")
    return as_pages(filters.not_empty(made), F.concat(F.lit(f"{family}:"), F.col("id")), F.col("id"))


def quad_line(value: Column) -> Column:
    """``x1,y1,..,x4,y4,text`` to a line; the text may hold commas. Null for blank texts, no extent and unreadable numbers."""
    parts = F.split(value, ",", 9)
    numbers = F.transform(F.slice(parts, 1, 8), lambda x: F.trim(x).try_cast("double"))
    text = t.stripped(F.element_at(parts, 9))
    at = lambda k: F.transform(F.filter(numbers, lambda _, i: i % 2 == k), lambda x: x.cast("int"))
    b = g.quad_box(at(0), at(1))
    ok = (F.size(parts) == 9) & ~F.exists(numbers, lambda x: x.isNull()) & (text != "") & b.isNotNull()
    return F.when(ok, F.struct(text.alias("text"), *[b[k].alias(k) for k in g.AXES]))


def quad_pages(rows: DataFrame, images: DataFrame, drop_empty: bool = False, family: str = "sroie") -> DataFrame:
    """rows(id, line_no, value), images(id, img_w, img_h) -> pages of the files that have an image."""
    lines = rows.withColumn("line", quad_line(F.col("value")))
    made = lines.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line_no", "line")))), lambda x: x["line"]).alias("lines"))
    made = made.join(images, "id")
    return as_pages(filters.not_empty(made) if drop_empty else made, F.concat(F.lit(f"{family}:"), F.col("id")), F.col("id"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """id, line_no, value of all lines of text files below a path; a file is one row until it is cut, so lines keep their order."""
    rows = spark.read.text(path, wholetext=True).select(t.stem(F.input_file_name()).alias("id"), "value")
    return rows.select("id", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of image and lines -> image, lines."""
    rows = spark.read.schema("image string, lines array<struct<text: string, bbox: array<int>>>").option("multiLine", "true").json(path)
    lines = F.transform("lines", lambda x: F.struct(x["text"].alias("text"), *[x["bbox"][k].alias(n) for k, n in enumerate(g.AXES)]))
    return rows.select("image", lines.alias("lines"))


def first_kept(pages: DataFrame) -> DataFrame:
    """The first page of each document."""
    w = Window.partitionBy("source").orderBy("page_no")
    return pages.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def single_lines(pages: DataFrame) -> DataFrame:
    """One row per usable line of a page: crop, and a line whose box is the whole crop."""
    crop = g.line_crop(F.col("line"), F.col("img_w"), F.col("img_h"))
    rows = pages.select("page_id", "source", "img_w", "img_h", F.posexplode("lines").alias("line_no", "line")).withColumn("c", crop).filter("c is not null")
    return rows.select("page_id", "source", "line_no", "line.text", "c.crop", F.col("c.box").alias("box"))
