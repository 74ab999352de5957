"""Registered queries of sources and sinks: the tables are brought into a source's format, read by it, and compared with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FLAT_PAGES, NESTED_PAGES
from ..sources import annotations, manifest, shards, sinks, tar
from ..storage import scratch
from . import fixtures as x
from .fixtures import GT
from .suite import query

LATIN = r"not regexp_matches(text, '[^\x{0000}-\x{024F}\s\p{Z}]')"
BACK = """n as (select doc_id, line_no, text, x1 / 1700.0::double as nx, y1 / 2200.0::double as ny, (x2 - x1) / 1700.0::double as nw, (y2 - y1) / 2200.0::double as nh from gt),
 b as (select doc_id, line_no, text, greatest(0, round_even(nx * 1700, 0))::int as x1, greatest(0, round_even(ny * 2200, 0))::int as y1, least(1700, round_even((nx + nw) * 1700, 0))::int as x2, least(2200, round_even((ny + nh) * 2200, 0))::int as y2 from n),
 c as (select doc_id, line_no, text, x1, y1, greatest(x1, x2) as x2, greatest(y1, y2) as y2 from b), k as (select * from c where x2 - x1 >= 1 and y2 - y1 >= 1)"""


def sidecars(spark: SparkSession, d: str, nested: bool) -> tuple[list[str], DataFrame]:
    """Paths of tar shards with a JSON sidecar and a page file of each document, and the sizes of the pages."""
    pages = x.pages(spark, d)
    relative = F.transform("lines", lambda v: F.array(v["x1"] / 1700.0, v["y1"] / 2200.0, (v["x2"] - v["x1"]) / 1700.0, (v["y2"] - v["y1"]) / 2200.0))
    scores = F.transform("lines", lambda v: F.when((F.col("page_id") + v["y1"]) % 5 == 0, 0.4).otherwise(0.9))
    page = F.struct(F.col("lines.text").alias("text"), relative.alias("bbox"), scores.alias("score"))
    payload = F.to_json(F.struct(F.array(F.struct(page.alias("lines")) if nested else page).alias("pages")))
    shard = F.format_string("part-%04d.tar", F.col("page_id") % 8)
    key = F.col("page_id").cast("string")
    records = pages.select(shard.alias("shard"), key.alias("key"), F.lit("json").alias("ext"), payload.cast("binary").alias("content"))
    images = pages.select(shard.alias("shard"), key.alias("key"), F.lit("pdf").alias("ext"), F.lit("%PDF").cast("binary").alias("content"))
    written = tar.write(records.unionByName(images), scratch(spark, "shards"))
    return [r["shard"] for r in written.collect()], pages.select(key.alias("key"), F.lit(0).alias("page_no"), "img_w", "img_h")  # eight paths


def figures(lines: Column) -> list[Column]:
    """n_lines, corners and chars of a page's lines."""
    total = lambda f: F.aggregate(lines, F.lit(0).cast("long"), lambda a, v: a + f(v))
    return [F.size(lines).alias("n_lines"), total(lambda v: v["x1"] + v["y1"] + v["x2"] + v["y2"]).alias("corners"), total(lambda v: F.length(v["text"])).alias("chars")]


FIGURES = "count(*)::int as n_lines, sum(x1 + y1 + x2 + y2)::bigint as corners, sum(length(text))::bigint as chars"


@query(f"with {GT}, {BACK} select doc_id::varchar as name, {FIGURES} from k where (doc_id + 20 + 24 * line_no) % 5 <> 0 and {LATIN} group by 1")
def q_tar_pages(spark: SparkSession, d: str) -> DataFrame:
    """SC1 to SC4, J5, J6, F1, F2, U2: tar shards of JSON sidecars beside page files, to pages of scored Latin lines."""
    paths, sizes = sidecars(spark, d, True)
    both = tar.complete(tar.records(spark, paths, ["json", "pdf"]), ["json", "pdf"]).select("shard", "key")
    found = tar.payloads(spark, paths, NESTED_PAGES).join(both, ["shard", "key"], "left_semi")
    pages = shards.scan(found, sizes, shards.Scan(max_lines=None))
    return pages.select(F.substring_index("source", ":", -1).alias("name"), *figures(F.col("lines")))


@query(f"with {GT}, {BACK} select doc_id::varchar as name, {FIGURES} from k where (doc_id + 20 + 24 * line_no) % 5 <> 0 and {LATIN} group by 1")
def q_tar_flat_pages(spark: SparkSession, d: str) -> DataFrame:
    """SC6: the same in parallel arrays."""
    paths, sizes = sidecars(spark, d, False)
    pages = shards.scan(tar.payloads(spark, paths, FLAT_PAGES), sizes, shards.FLAT)
    return pages.select(F.substring_index("source", ":", -1).alias("name"), *figures(F.col("lines")))


@query(f"with {GT} select doc_id::varchar as name, count(*) as n, md5(string_agg(text, chr(10) order by line_no)) as digest from gt group by 1")
def q_tar_texts(spark: SparkSession, d: str) -> DataFrame:
    """SC5, SC5a, SC5b: texts of JSON members alone, with nothing in quarantine."""
    paths, _ = sidecars(spark, d, True)
    texts = shards.line_texts(tar.payloads(spark, paths, NESTED_PAGES))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda v: v["text"])
    return texts.groupBy(F.col("key").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(ordered, "\n")).alias("digest"))


@query(f"with {GT} select doc_id::varchar as page_id, {FIGURES} from gt where doc_id % 7 <> 0 and (doc_id + line_no) % 6 <> 0 and (doc_id + line_no) % 10 <> 0 group by 1 having count(*) >= 2")
def q_paragraph_pages(spark: SparkSession, d: str) -> DataFrame:
    """SC7, F8, P12: paragraph annotations as JSON, without illegible and vertical lines; pages of two lines and more."""
    vertices = lambda v: F.array(*[F.array(v[a].cast("double"), v[b].cast("double")) for a, b in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    rows = x.spread(x.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", x.boxed(F.col("text"), F.col("doc_id")).alias("l")).filter("size(l) > 0")
    k = lambda v: F.col("doc_id") + v["line_no"]
    lines = F.transform("l", lambda v: F.struct(vertices(v).alias("vertices"), v["text"].alias("text"), (k(v) % 6 != 0).alias("legible"), (k(v) % 2 == 0).alias("handwritten"), (k(v) % 10 == 0).alias("vertical")))
    made = rows.select(F.col("doc_id").cast("string").alias("image_id"), F.to_json(F.struct(F.array(F.struct(lines.alias("lines"))).alias("paragraphs"))).alias("annotations"), F.lit(1700).alias("img_w"), F.lit(2200).alias("img_h"))
    pages = annotations.paragraph_pages(made.filter("image_id % 7 <> 0"), min_lines=2)
    return pages.select("page_id", *figures(F.col("lines")))


PLAIN = "trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"""with {GT}, q as (select doc_id, line_no, {PLAIN} as text, x1, y1, x2, y2 from gt), f as (select distinct doc_id from q where doc_id % 9 <> 0)
 select f.doc_id::varchar as id, case when f.doc_id % 11 = 0 then 'no image' else 'page' end as state, case when f.doc_id % 11 = 0 then null else (select count(*) from q where q.doc_id = f.doc_id and text <> '') end::int as n_lines,
  case when f.doc_id % 11 = 0 then null else (select sum(x1 + y1 + x2 + y2) from q where q.doc_id = f.doc_id and text <> '') end::bigint as corners from f where f.doc_id % 11 = 0 or exists (select 1 from q where q.doc_id = f.doc_id and text <> '')
 union all select distinct doc_id::varchar, 'no annotation', null::int, null::bigint from q where doc_id % 9 = 0""")
def q_form_pages(spark: SparkSession, d: str) -> DataFrame:
    """SC8, SC8a, SC8b, J1, F10: forms as XML joined with a list of ids and the images; every second line has its box on its words."""
    rows = x.spread(x.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", x.boxed(F.col("text"), F.col("doc_id")).alias("l")).filter("size(l) > 0")
    plain = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v["text"], "[^A-Za-z0-9 ]", ""), " +", " "))
    w, h = lambda v: v["x2"] - v["x1"], lambda v: v["y2"] - v["y1"]
    own = lambda v: F.format_string('<line text="%s" asx="%d" asy="%d" asw="%d" ash="%d"/>', plain(v), v["x1"], v["y1"], w(v), h(v))
    words = lambda v: F.format_string('<line text="%s"><word><cmp x="%d" y="%d" width="%d" height="1"/></word><word><cmp x="%d" y="%d" width="1" height="%d"/></word></line>', plain(v), v["x1"], v["y1"], w(v), v["x1"], v["y1"], h(v))
    xml = F.concat(F.lit("<form><handwritten-part>"), F.array_join(F.transform("l", lambda v: F.when(v["line_no"] % 2 == 0, own(v)).otherwise(words(v))), ""), F.lit("</handwritten-part></form>"))
    named = rows.select(F.col("doc_id").cast("string").alias("id"), xml.alias("xml"))
    images = named.filter("id % 11 <> 0").select("id", F.lit(1700).alias("img_w"), F.lit(2200).alias("img_h"))
    pages, skipped = annotations.form_pages(named.filter("id % 9 <> 0"), named.select("id"), images)
    size, corners, _ = figures(F.col("lines"))
    kept = pages.select(F.col("page_id").alias("id"), F.lit("page").alias("state"), size, corners)
    return kept.unionByName(skipped.select("id", F.col("reason").alias("state"), F.lit(None).cast("int").alias("n_lines"), F.lit(None).cast("long").alias("corners")))


@query(f"with {GT} select 'doc-' || doc_id as image, md5(string_agg(text, ' ' order by line_no)) as ref, {FIGURES} from gt where x2 > x1 and y2 > y1 and doc_id % 5 <> 0 group by doc_id")
def q_quad_pages(spark: SparkSession, d: str) -> DataFrame:
    """SC10, SC10a, J3, SK2: quad text to pages that have an image, then to manifest records, written and read again."""
    c = lambda n: F.col(n).cast("string")
    value = F.concat_ws(",", c("x1"), c("y1"), c("x2"), c("y1"), c("x2"), c("y2"), c("x1"), c("y2"), F.col("text"))
    rows = x.gt_lines(spark, d).select(F.col("doc_id").cast("string").alias("id"), "line_no", value.alias("value"))
    images = rows.filter("id % 5 <> 0").select("id", F.lit(1700).alias("img_w"), F.lit(2200).alias("img_h")).distinct()
    at = scratch(spark, "quads")
    manifest.write(manifest.from_quads(annotations.quad_pages(rows, images), F.concat(F.lit("doc-"), F.col("page_id"))), at)
    return manifest.read(spark, at).select("image", F.md5("ref").alias("ref"), *figures(F.col("lines")))


@query(f"""with {GT} select doc_id::varchar as page_id, line_no, (greatest(0, least(x2 + 4, 1700)) - greatest(0, least(x1 - 4, 1700)))::int as w, (greatest(0, least(y2 + 4, 2200)) - greatest(0, least(y1 - 4, 2200)))::int as h
 from (select *, row_number() over (partition by doc_id order by line_no) - 1 as line_at from gt) where y2 - y1 between 12 and 96 and x2 - x1 >= 32""".replace("line_no, (greatest", "line_at::int as line_no, (greatest"))
def q_single_lines(spark: SparkSession, d: str) -> DataFrame:
    """SC13: one row per usable line of a page."""
    pages = x.pages(spark, d).withColumn("page_id", F.col("page_id").cast("string"))
    return annotations.single_lines(pages).select("page_id", "line_no", F.col("box.x2").alias("w"), F.col("box.y2").alias("h"))


@query(f"with {GT}, {x.HYP} select doc_id || '-' || line_no as image, md5(ref) as ref, md5(hyp) as hyp, round(levenshtein(ref, hyp) / length(ref)::double, 6) as cer, 0.0::double as wer from hyp")
def q_prediction_files(spark: SparkSession, d: str) -> DataFrame:
    """SK5: prediction records written as JSON lines and read again."""
    from ..operators import recognition

    rows = x.hypotheses(spark, d).select(F.concat_ws("-", "doc_id", "line_no").alias("image"), "ref", "hyp", recognition.doc_cer(F.col("ref"), F.col("hyp")).alias("cer"), F.lit(0.0).alias("wer"))
    at = scratch(spark, "predictions")
    sinks.predictions(rows, at)
    back = spark.read.schema("image string, ref string, hyp string, cer double, wer double").json(at)
    return back.select("image", F.md5("ref").alias("ref"), F.md5("hyp").alias("hyp"), F.round("cer", 6).alias("cer"), "wer")


@query(rf"""with {GT}, u as (select text, length(text) >= 3 and length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= 0.5 * length(text) as ok from gt)
 select count(*) filter (ok) as kept, count(*) filter (not ok) as dropped, (count(*) filter (ok))::bigint as n_lines, (sum(length(text)) filter (ok))::bigint as chars from u""")
def q_corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """SK7, F16: useful lines written as a text corpus and read again."""
    at = scratch(spark, "corpus")
    kept, dropped = sinks.corpus(x.gt_lines(spark, d), at)
    back = spark.read.text(at)
    return back.agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("chars")).select(F.lit(kept).cast("long").alias("kept"), F.lit(dropped).cast("long").alias("dropped"), "n_lines", "chars")
