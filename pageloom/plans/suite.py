"""The registered queries of the document-layout operators and their SQL counterparts, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import schedules
from ..functions import text as t
from ..operators import audit, detection, filters, mixture, ordering, recognition, serialize, tasks
from ..sources import annotations, cache, manifest
from ..streaming import early_stop, telemetry
from ..storage import scratch
from . import fixtures as x
from .fixtures import GT, HYP, PRED, table

GRID = serialize.Grid(canvas_h=x.CANVAS_H, canvas_w=x.CANVAS_W, quantizer=10)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def own_box():
    return F.struct("x1", "y1", "x2", "y2")

PCT = ", ".join(f"v[least(n - 1, cast(floor({q} * n / 100) as bigint)) + 1] as p{q}" for q in audit.QS)
WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"


@query(
    f"""with {GT}, l as (select source, {WORDS} as words, length(text) as chars, y2 - y1 as h, x2 - x1 as w, x1, y1, x2, y2, doc_id from gt),
 p as (select doc_id, any_value(source) as source, count(*) as n_lines, sum(words) as n_words, sum(chars) as n_chars, sum(w * h) / (1700 * 2200)::double as density from l group by doc_id),
 m as (select source, 'line_height' as measure, h::double as v from l union all select source, 'words', words::double from l union all select source, 'chars', chars::double from l
   union all select source, 'aspect', w / h::double from l union all select source, 'n_lines', n_lines::double from p union all select source, 'n_words', n_words::double from p
   union all select source, 'n_chars', n_chars::double from p union all select source, 'density', density from p),
 a as (select source, measure, count(*) as n, list_sort(list(v)) as v, round(avg(v), 6) as mean, min(v) as min, max(v) as max from m group by 1, 2)
 select source, measure, n, mean, min, max, {PCT} from a"""
)
def q_line_distribution(spark: SparkSession, d: str) -> DataFrame:
    """SC5b, P6, A13, A20: line and page measures per source with floor-index percentiles."""
    return audit.layout_report(x.pages(spark, d), "source").withColumn("mean", F.round("mean", 6))


@query(
    f"""with {GT}, p as (select doc_id, any_value(source) as source, count(*) as n_lines, sum({WORDS})::bigint as n_words from gt group by doc_id),
 a as (select source, count(*) as n, round(avg(n_words), 6) as mean, min(n_words) as min, max(n_words) as max, list_sort(list(n_words)) as v from p group by 1)
 select source, n, mean, min, max, {", ".join(f"v[cast(round_even({q / 100.0}::double * (n - 1), 0) as bigint) + 1] as p{q}" for q in audit.QS)} from a"""
)
def q_words_per_page(spark: SparkSession, d: str) -> DataFrame:
    """Words per page with rounded-rank percentiles."""
    return audit.percentiles(audit.page_measures(x.pages(spark, d), "source"), ["source"], "n_words", rule="rounded").withColumn("mean", F.round("mean", 6))


@query(
    """with a as (select l_returnflag, l_linestatus, count(*) as n, list_sort(list(l_extendedprice)) as v, median(l_extendedprice) as median from lineitem group by 1, 2)
 select l_returnflag, l_linestatus, n, v[least(n - 1, cast(floor(0.95::double * n) as bigint)) + 1] as p95, median from a"""
)
def q_price_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Truncated-index percentile and median."""
    rows, by = table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]
    top = audit.percentiles(rows, by, "l_extendedprice", (95,), "truncated").select(*by, "n", "p95")
    return top.join(audit.medians(rows, by, "l_extendedprice"), by)


@query(
    f"""with {GT}, n as (select doc_id, line_no, x1 / 1700.0::double as nx, y1 / 2200.0::double as ny, (x2 - x1) / 1700.0::double as nw, (y2 - y1) / 2200.0::double as nh from gt),
 b as (select doc_id, line_no, greatest(0, round_even(nx * 1700, 0))::int as x1, greatest(0, round_even(ny * 2200, 0))::int as y1, least(1700, round_even((nx + nw) * 1700, 0))::int as x2, least(2200, round_even((ny + nh) * 2200, 0))::int as y2 from n),
 c as (select doc_id, line_no, x1, y1, greatest(x1, x2) as x2, greatest(y1, y2) as y2 from b)
 select doc_id, line_no, x1, y1, x2, y2, round_even(x1 * 0.37::double, 0)::int as sx1, round_even(y2 * 0.41::double, 0)::int as sy2, least(x2, 1000) as cx2, (y2 - y1) * (x2 - x1)::bigint as area
 from c where x2 - x1 >= 1 and y2 - y1 >= 1"""
)
def q_wire_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Relative boxes to pixels; what leaves the page is dropped."""
    norm = F.array(F.col("x1") / 1700.0, F.col("y1") / 2200.0, (F.col("x2") - F.col("x1")) / 1700.0, (F.col("y2") - F.col("y1")) / 2200.0)
    rows = x.gt_lines(spark, d).select("doc_id", "line_no", g.wire_box(norm, F.lit(1700), F.lit(2200)).alias("b")).filter("b is not null")
    b = F.col("b")
    s, c = g.scaled(b, 0.37, 0.41), g.clipped(b, F.lit(1000), F.lit(2200))
    return rows.select("doc_id", "line_no", "b.*", s["x1"].alias("sx1"), s["y2"].alias("sy2"), c["x2"].alias("cx2"), g.area(b).alias("area"))


@query(f"with {GT} select doc_id, line_no, text, x1, y1, x2, y2 from gt where x2 > x1 and y2 > y1")
def q_quad_lines(spark: SparkSession, d: str) -> DataFrame:
    """SC10a, P12: comma-separated quads, texts with commas, to boxes."""
    c = lambda n: F.col(n).cast("string")
    value = F.concat_ws(",", c("x1"), c("y1"), c("x2"), F.concat(c("y1"), F.lit(".9")), c("x2"), c("y2"), F.concat(c("x1"), F.lit(" ")), c("y2"), F.col("text"))
    return x.gt_lines(spark, d).select("doc_id", "line_no", annotations.quad_line(value).alias("q")).filter("q is not null").select("doc_id", "line_no", "q.*")


@query(rf"""with {GT} select source, count(*) as n, count(*) filter (not regexp_matches(text, '[^\x{{0000}}-\x{{024F}}\s\p{{Z}}]')) as n_latin,
 count(*) filter (length(text) >= 3 and length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= 0.5 * length(text)) as n_useful,
 count(*) filter (length(text) between 5 and 500 and not starts_with(text, '==')) as n_sized from gt group by source""")
def q_line_filters(spark: SparkSession, d: str) -> DataFrame:
    """Lines that pass the text filters, per source."""
    c = F.col("text")
    return x.gt_lines(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(filters.latin(c)).alias("n_latin"), F.count_if(filters.useful_line(c)).alias("n_useful"), F.count_if(filters.sentence_length(c)).alias("n_sized"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as raw from documents where text is not null),
 c as (select doc_id, unnest(string_split(regexp_replace(trim(raw, chr(9) || ' ' || chr(13)), '([.!?])\s+([A-Z"''])', '\1' || chr(1) || '\2', 'g'), chr(1))) as s from l where trim(raw) <> '' and not starts_with(trim(raw), '=='))
 select doc_id, count(*) as n, sum(length(trim(s)))::bigint as chars from c where length(trim(s)) between 5 and 500 group by doc_id""")
def q_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of whole texts."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(t.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars"))


@query(
    f"""with {GT}, p as (select doc_id, any_value(source) as source, count(*) as n, sum({WORDS}) as words from gt group by doc_id)
 select source, count(*) as n_pages, sum(least(n, 40))::bigint as n_lines from p where n <= 60 and words <= 800 group by source"""
)
def q_page_filters(spark: SparkSession, d: str) -> DataFrame:
    """empty pages and outliers dropped, lines capped."""
    rows = filters.outliers(filters.not_empty(x.pages(spark, d)), 60, 800).withColumn("lines", filters.capped(F.col("lines"), 40))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.size("lines")).alias("n_lines"))


@query(
    f"""with {GT} select doc_id, line_no, greatest(0, least(x1 - 4, 1700))::int as cx1, greatest(0, least(y1 - 4, 2200))::int as cy1, (greatest(0, least(x2 + 4, 1700)) - greatest(0, least(x1 - 4, 1700)))::int as w,
 (greatest(0, least(y2 + 4, 2200)) - greatest(0, least(y1 - 4, 2200)))::int as h from gt where y2 - y1 between 12 and 96 and x2 - x1 >= 32"""
)
def q_line_crops(spark: SparkSession, d: str) -> DataFrame:
    """SC13, P9, P13: crops of usable lines."""
    rows = x.gt_lines(spark, d).select("doc_id", "line_no", g.line_crop(own_box(), F.lit(1700), F.lit(2200)).alias("c")).filter("c is not null")
    return rows.select("doc_id", "line_no", F.col("c.crop.x1").alias("cx1"), F.col("c.crop.y1").alias("cy1"), F.col("c.box.x2").alias("w"), F.col("c.box.y2").alias("h"))


INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1))::bigint * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query(
    f"""with {GT}, {PRED}, j as (select a.doc_id, a.line_no, b.line_no as pred_line, b.k, {INTER} as i, (a.x2 - a.x1)::bigint * (a.y2 - a.y1) as ga, (b.x2 - b.x1)::bigint * (b.y2 - b.y1) as pa from gt a join pred b using (doc_id))
 select doc_id, line_no, pred_line, k, i as inter, i / (ga + pa - i)::double as iou from j where i > 0"""
)
def q_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping boxes of a page."""
    a = x.gt_lines(spark, d).select("doc_id", "line_no", own_box().alias("a"))
    b = x.predictions(spark, d).select("doc_id", F.col("line_no").alias("pred_line"), "k", own_box().alias("b"))
    return detection.overlapping(a, b, "doc_id").select("doc_id", "line_no", "pred_line", "k", "inter", g.iou(F.col("a"), F.col("b")).alias("iou"))


def box_pages(spark: SparkSession, d: str) -> DataFrame:
    return detection.paged(x.gt_lines(spark, d), x.predictions(spark, d), "doc_id", ["line_no"])


MATCH = f"""m as (select a.doc_id, a.line_no as gi, b.line_no * 2 + b.k as pj from gt a join pred b using (doc_id)
  where {INTER} >= 0.8 * ((a.x2 - a.x1)::bigint * (a.y2 - a.y1)) and {INTER} >= 0.4 * ((b.x2 - b.x1)::bigint * (b.y2 - b.y1)))"""
# Predictions lie within two pixels of their line, and lines are 24 apart: only a line and its own copies can match, so the greedy
# pass takes copy 0 of each matched line and the counts have a closed form.
DETEVAL = f"""with {GT}, {PRED}, {MATCH}, c as (select doc_id, gi, count(*) as n from m group by 1, 2), o as (select count(distinct gi) as k from m group by doc_id, pj having count(distinct gi) > 1),
 g as (select doc_id, count(*) as ng from gt group by 1), p as (select doc_id, count(*) as np from pred group by 1), s as (select doc_id, count(*) as one from c group by 1),
 r as (select doc_id, case when coalesce(np, 0) = 0 then 0.0 else coalesce(one, 0) / np::double end as precision, case when coalesce(np, 0) = 0 then 0.0 else coalesce(one, 0) / ng::double end as recall from g left join p using (doc_id) left join s using (doc_id)),
 f as (select doc_id, precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from r)"""


@query(DETEVAL + " select doc_id, precision, recall, f1 from f where (select count(*) from o) >= 0")
def q_deteval(spark: SparkSession, d: str) -> DataFrame:
    """DetEval of every page."""
    return box_pages(spark, d).select("doc_id", detection.deteval(F.col("gt"), F.col("pred")).alias("m")).select("doc_id", "m.*")


@query(DETEVAL + " select count(*) as n_pages, round(avg(precision), 9) as precision, round(avg(recall), 9) as recall, round(avg(f1), 9) as f1 from f")
def q_deteval_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means over pages."""
    return q_deteval(spark, d).agg(F.count(F.lit(1)).alias("n_pages"), *[F.round(F.avg(c), 9).alias(c) for c in ("precision", "recall", "f1")])


CLIP = "greatest(0, least(x1, 1700)) as x1, greatest(0, least(y1, 2200)) as y1, greatest(0, least(x2, 1700)) as x2, greatest(0, least(y2, 2200)) as y2"


@query(
    f"""with {GT}, {PRED}, b as (select doc_id, 'g' as s, {CLIP} from gt union all select doc_id, 'p', {CLIP} from pred),
 u as (select * from b union all select doc_id, 'u', x1, y1, x2, y2 from b),
 e as (select doc_id, s, y, lead(y) over (partition by doc_id, s order by y) as y_end from (select doc_id, s, y1 as y from u union select doc_id, s, y2 from u)),
 i as (select e.doc_id, e.s, e.y, e.y_end, u.x1, u.x2, max(u.x2) over (partition by e.doc_id, e.s, e.y order by u.x1, u.x2 rows between unbounded preceding and 1 preceding) as before
   from e join u on u.doc_id = e.doc_id and u.s = e.s and u.y1 <= e.y and u.y2 >= e.y_end where e.y_end is not null and u.x2 > u.x1),
 a as (select doc_id, s, sum((y_end - y) * greatest(0, x2 - greatest(x1, coalesce(before, x1)))) as area from i group by 1, 2),
 w as (select d.doc_id, coalesce(ga.area, 0) as ga, coalesce(pa.area, 0) as pa, coalesce(ga.area, 0) + coalesce(pa.area, 0) - coalesce(ua.area, 0) as shared from (select distinct doc_id from gt) d
   left join a ga on ga.doc_id = d.doc_id and ga.s = 'g' left join a pa on pa.doc_id = d.doc_id and pa.s = 'p' left join a ua on ua.doc_id = d.doc_id and ua.s = 'u'),
 r as (select doc_id, case when ga = 0 and pa = 0 then 1.0 when pa > 0 then shared / pa::double else 0.0 end as precision, case when ga = 0 and pa = 0 then 1.0 when ga > 0 then shared / ga::double else 0.0 end as recall from w)
 select doc_id, precision::double as precision, recall::double as recall, (case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end)::double as f1 from r"""
)
def q_area_f1(spark: SparkSession, d: str) -> DataFrame:
    """Exact area overlap of boxes clipped to the page."""
    return box_pages(spark, d).select("doc_id", detection.area_f1(F.col("gt"), F.col("pred"), F.lit(1700), F.lit(2200)).alias("m")).select("doc_id", "m.*")


@query()
def q_ap_at_iou(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of every page at four thresholds; tested against a brute-force version."""
    rows = box_pages(spark, d).select("doc_id", detection.ap_sweep(F.col("gt"), F.col("pred"), F.col("scores")).alias("ap"))
    return rows.select("doc_id", F.explode("ap").alias("threshold", "ap"))


CER = "case when ref = '' and hyp = '' then 0.0 when ref = '' or hyp = '' then 1.0 else levenshtein(ref, hyp) / length(ref)::double end"


@query(f"with {GT}, {HYP} select doc_id, line_no, ({CER})::double as cer from hyp")
def q_cer_per_line(spark: SparkSession, d: str) -> DataFrame:
    """A3: character error rate of every line."""
    return x.hypotheses(spark, d).select("doc_id", "line_no", recognition.doc_cer(F.col("ref"), F.col("hyp")).alias("cer"))


@query(f"with {GT}, {HYP} select sum(levenshtein(ref, hyp)) / sum(length(ref))::double as cer from hyp")
def q_cer_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A1: pooled character error rate."""
    return recognition.corpus_cer(x.hypotheses(spark, d))


@query(f"with {GT}, {HYP}, c as (select ({CER})::double as cer from hyp) select t::double as threshold, count(*) filter (cer <= t) / count(*)::double as ap from c, (values (0.0::double), (0.1), (0.2), (0.3)) v(t) group by t")
def q_cer_ap(spark: SparkSession, d: str) -> DataFrame:
    """A5: share of lines within each error rate."""
    return recognition.cer_ap(x.hypotheses(spark, d))


BAG = rf"""{GT}, {HYP}, r as (select doc_id, w, count(*) as n from (select doc_id, unnest(string_split_regex(ref, '\s+')) as w from hyp) where w <> '' group by 1, 2),
 h as (select doc_id, w, count(*) as n from (select doc_id, unnest(string_split_regex(hyp, '\s+')) as w from hyp) where w <> '' group by 1, 2),
 b as (select coalesce(r.doc_id, h.doc_id) as doc_id, sum(least(coalesce(r.n, 0), coalesce(h.n, 0))) as tp, sum(greatest(coalesce(h.n, 0) - coalesce(r.n, 0), 0)) as fp, sum(greatest(coalesce(r.n, 0) - coalesce(h.n, 0), 0)) as fn
   from r full join h on r.doc_id = h.doc_id and r.w = h.w group by 1)"""


@query(f"with {BAG} select doc_id, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn from b")
def q_word_matches(spark: SparkSession, d: str) -> DataFrame:
    """Multiset word matches of every document."""
    return recognition.word_matches(x.doc_texts(spark, d), "doc_id")


@query(f"""with {BAG}, s as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from b), q as (select *, tp / (tp + fp)::double as precision, tp / (tp + fn)::double as recall from s)
 select tp, fp, fn, precision, recall, 2 * precision * recall / (precision + recall) as f1 from q""")
def q_word_prf(spark: SparkSession, d: str) -> DataFrame:
    """A4: precision, recall and F1 over the corpus."""
    return recognition.word_prf(x.doc_texts(spark, d), "doc_id")


@query()
def q_wer(spark: SparkSession, d: str) -> DataFrame:
    """A2: word edit distance of every document; tested against a brute-force version."""
    return x.doc_texts(spark, d).select("doc_id", recognition.word_errors(F.col("ref"), F.col("hyp")).alias("errors"), F.size(t.words(F.col("ref"))).alias("n_words"))


@query()
def q_recognition_summary(spark: SparkSession, d: str) -> DataFrame:
    """All recognition metrics of lines in one row."""
    rows = x.hypotheses(spark, d).withColumn("line_id", F.concat_ws("-", "doc_id", "line_no"))
    return recognition.summary(rows, "line_id")


XT = "'<x_' || least(169, x{0} // 10) || '>'"
YT = "'<y_' || least(219, y{0} // 10) || '>'"
NEAR, FAR = f"{XT.format(1)} || ' ' || {YT.format(1)}", f"{XT.format(2)} || ' ' || {YT.format(2)}"
TEXT = r"array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), ' ')"
XYT = lambda v: f"'<xy_' || least(219, {v} // 10) || '>'"


def tokens_of(spark: SparkSession, d: str, scheme: str) -> DataFrame:
    rows = x.pages(spark, d).select(F.col("page_id").alias("doc_id"), serialize.serialised(F.col("lines"), GRID, scheme).alias("tokens"))
    return rows.select("doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def _scheme_sql(one: str, before: str = "", after: str = "") -> str:
    return f"with {GT}, s as (select doc_id, string_agg({one}, ' ' order by y1, x1, line_no) as s from gt group by doc_id) select doc_id, len(string_split(s, ' '))::int as n, md5(s) as digest from s"


@query(_scheme_sql(f"{NEAR} || ' ' || {TEXT} || ' ' || {FAR}"))
def q_serialize_original(spark: SparkSession, d: str) -> DataFrame:
    """T7, P23, O1."""
    return tokens_of(spark, d, "original")


@query(f"""with {GT}, s as (select doc_id, string_agg({TEXT}, ' ' order by y1, x1, line_no) || ' </text> ' || string_agg({NEAR} || ' ' || {FAR}, ' ' order by y1, x1, line_no) || ' </location>' as s from gt group by doc_id)
 select doc_id, len(string_split(s, ' '))::int as n, md5(s) as digest from s""")
def q_serialize_segmented(spark: SparkSession, d: str) -> DataFrame:
    """T8."""
    return tokens_of(spark, d, "segmented")


@query(_scheme_sql(f"{XYT('x1')} || ' ' || {XYT('y1')} || ' ' || {TEXT} || ' ' || {XYT('x2')} || ' ' || {XYT('y2')}"))
def q_serialize_unified(spark: SparkSession, d: str) -> DataFrame:
    """T9."""
    return tokens_of(spark, d, "unified")


@query(f"""with {GT} select doc_id, count(*)::int as n_lines, sum(least(169, x1 // 10) * 10)::bigint as x1, sum(least(219, y2 // 10) * 10)::bigint as y2, sum(length({TEXT}))::bigint as chars from gt group by doc_id""")
def q_parse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Sequences parsed back to lines on the grid."""
    rows = x.pages(spark, d).select(F.col("page_id").alias("doc_id"), serialize.serialised(F.col("lines"), GRID).alias("tokens"))
    back = serialize.parsed(rows).select("doc_id", F.col("parsed_lines").alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0).cast("long"), lambda a, v: a + f(v))
    return back.select("doc_id", F.size("p").alias("n_lines"), total(lambda v: v["x1"]).alias("x1"), total(lambda v: v["y2"]).alias("y2"), total(lambda v: F.length(v["text"])).alias("chars"))


@query("""select 'special' as kind, 7::bigint as n union all select 'x', 170 union all select 'y', 220""")
def q_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the grid and the special ones."""
    rows = spark.range(1).select(F.explode(serialize.vocabulary(GRID)).alias("token"))
    kind = F.when(serialize.token_class(F.col("token")) == "spatial", F.regexp_extract("token", "^<([xy]+)_", 1)).otherwise("special")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


MIX = {"ocr": 0.25, "ocr_layout": 0.5, "region_ocr": 0.125, "find_it": 0.125}
DRAWN = "case when u < 0.25 then 'ocr' when u < 0.75 then 'ocr_layout' when u < 0.875 then 'region_ocr' else 'find_it' end"


@query(f"with {GT}, p as (select doc_id, any_value(source) as source, ((doc_id * 7919 + 104729) % 1000) / 1000.0::double as u from gt group by doc_id) select source, {DRAWN} as task, count(*) as n from p group by 1, 2")
def q_task_mix(spark: SparkSession, d: str) -> DataFrame:
    """Tasks drawn by weight."""
    u = ((F.col("page_id") * 7919 + 104729) % 1000) / 1000.0
    return x.pages(spark, d).groupBy("source", tasks.drawn_task(u, MIX).alias("task")).agg(F.count(F.lit(1)).alias("n"))


def posed(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a task by number: 0 ocr, 1 ocr_layout, 2 region_ocr in a box, 3 find_it for the first line's first word."""
    k = F.col("page_id") % 4
    region = g.box(F.lit(0), F.lit(0), F.lit(900), F.lit(500))
    word = F.get(t.words(F.get(F.col("lines"), F.lit(0))["text"]), F.lit(0))
    names = F.array(*map(F.lit, ("ocr", "ocr_layout", "region_ocr", "find_it")))
    return x.pages(spark, d).withColumn("task", F.get(names, k.cast("int"))).withColumn("query_text", F.when(k == 3, word)).withColumn("query_bbox", F.when(k == 2, region))


@query(f"""with {GT}, f as (select doc_id, min_by(text, line_no) as t0 from gt group by doc_id), q as (select doc_id, string_split_regex(t0, '\\s+')[1] as w from f),
 o as (select gt.doc_id, gt.doc_id % 4 as k, sum(case gt.doc_id % 4 when 0 then {WORDS} when 1 then {WORDS} + 4 when 2 then case when x2 <= 900 and y2 <= 500 then {WORDS} else 0 end else case when contains(text, w) then 4 else 0 end end) as n from gt join q using (doc_id) group by 1, 2)
 select doc_id, (case k when 2 then 5 when 3 then 4 else 2 end)::int as prompt_len, (case k when 2 then 5 when 3 then 4 else 2 end + n + 1)::int as full_len,
  least(case k when 2 then 5 when 3 then 4 else 2 end + n + 1, 512)::int as kept from o""")
def q_targets(spark: SparkSession, d: str) -> DataFrame:
    """Prompts and answers of four tasks, clipped at 512 tokens."""
    rows = serialize.targets(posed(spark, d), GRID, limit=512)
    return rows.select(F.col("page_id").alias("doc_id"), "prompt_len", "full_len", F.size("tokens").alias("kept"))


@query(f"""with {GT}, o as (select doc_id, any_value(source) as source, sum({WORDS} + 4) + 3 as n from gt group by 1), a as (select source, count(*) as n, round(avg(n), 6) as mean, min(n) as min, max(n) as max, list_sort(list(n)) as v, count(*) filter (n > 512) as n_over from o group by 1)
 select source, n, mean, min::int as min, max::int as max, {", ".join(f"v[least(n - 1, cast(floor({q} * n / 100) as bigint)) + 1]::int as p{q}" for q in audit.QS)}, n_over from a""")
def q_truncation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of layout targets before clipping."""
    rows = x.pages(spark, d).withColumn("task", F.lit("ocr_layout")).withColumn("query_text", F.lit(None).cast("string")).withColumn("query_bbox", F.lit(None).cast("struct<x1: int, y1: int, x2: int, y2: int>"))
    by_source = serialize.targets(rows, GRID, limit=None).withColumn("source", F.coalesce("source", F.lit("none")))
    out = audit.truncation_audit(by_source, ["source"], 512).withColumn("mean", F.round("mean", 6))
    return out.withColumn("source", F.nullif(F.col("source"), F.lit("none")))


@query(rf"""with {GT}, w as (select source, text, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') as ws from gt), c as (select source, length(text) as c, len(ws) as n, len(list_filter(ws, lambda w: regexp_matches(w, '[0-9]'))) as u from w)
 select source, count(*) as n_lines, sum(n)::bigint as total_tokens, sum(u)::bigint as unk_tokens, count(*) filter (u > 0) as unk_lines, sum(c)::bigint as total_chars, count(*) filter (u > 0) / greatest(count(*), 1)::double as unk_line_share, sum(u) / greatest(sum(n), 1)::double as unk_token_share, sum(c) / greatest(sum(n), 1)::double as chars_per_token from c group by source""")
def q_tokenizer_audit(spark: SparkSession, d: str) -> DataFrame:
    """Words with a digit count as unknown."""
    rows = x.gt_lines(spark, d).withColumn("tokens", F.transform(t.words(F.col("text")), lambda w: F.when(w.rlike("[0-9]"), "<unk>").otherwise(w)))
    return audit.tokenizer_audit(rows, ["source"])


@query(f"""with {GT}, s as (select doc_id, string_agg({NEAR} || ' ' || {TEXT} || ' ' || {FAR}, ' ' order by y1, x1, line_no) as s, count(*) as lines from gt group by doc_id), l as (select doc_id, lines, len(string_split(s, ' ')) as n from s)
 select doc_id, (n - 4 * lines + 1)::int as n_text, (4 * lines)::int as n_loc, (n + 2)::int as width, 1::int as n_prompt from l""")
def q_teacher_forcing(spark: SparkSession, d: str) -> DataFrame:
    """Shifted sequences with prompt mask, and label tokens by class (the end mark counts as text)."""
    rows = x.pages(spark, d).withColumn("task", F.lit("ocr_layout")).withColumn("query_text", F.lit(None).cast("string")).withColumn("query_bbox", F.lit(None).cast("struct<x1: int, y1: int, x2: int, y2: int>"))
    made = serialize.teacher_forced(serialize.targets(rows, GRID, limit=None), F.size("tokens") - 1)
    return made.select(F.col("page_id").alias("doc_id"), serialize.class_counts(F.col("label"), F.col("prompt_mask")).alias("c"), F.size("input").alias("width"), F.size(F.filter("prompt_mask", lambda m: m)).alias("n_prompt")).select("doc_id", "c.*", "width", "n_prompt")


@query("""with r as (select doc_id, row_number() over (order by doc_id) - 1 as k, n_pages from documents) select k // 32 as batch_no, count(*) as n, max(coalesce(n_pages, 1) * 100 + 31)::bigint // 32 * 32 as pad_w from r group by 1""")
def q_micro_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 32 in global order, the last one partial, with the size all their pages are filled up to."""
    rows = table(spark, d, "documents").select("doc_id", (F.coalesce("n_pages", F.lit(1)) * 100).alias("img_w"))
    made = serialize.padded_batch_size(serialize.micro_batches(rows.withColumn("img_h", F.lit(32)), 32, ["doc_id"]))
    return made.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"), F.max("pad_w").cast("long").alias("pad_w"))


WEIGHTS = {"pdfa_letters": 7.0, "idl_memos": 2.0, "iam_forms": 1.0, "wiki_pages": 0.0}


@query("select source, count(*) as n from documents where source in ('pdfa_letters', 'idl_memos', 'iam_forms') group by 1")
def q_mixture_counts(spark: SparkSession, d: str) -> DataFrame:
    """What an exhausted mixture has drawn."""
    mixed = mixture.interleaved(table(spark, d, "documents").select("doc_id", "source"), WEIGHTS)
    return mixture.sample_counts(mixed)


@query("""select source, count(*) as n, (count(*) - 1)::bigint as last, count(*) as n_ranks, 0::bigint as n_late from documents where source in ('pdfa_letters', 'idl_memos', 'iam_forms') group by 1""")
def q_mixture_order(spark: SparkSession, d: str) -> DataFrame:
    """M1, M3: every row of a source is drawn once, ranks without a gap, the k-th between k and k + 1 over its weight."""
    mixed = mixture.interleaved(table(spark, d, "documents").select("doc_id", "source"), WEIGHTS)
    at = F.col("mix_time") * F.create_map(*[F.lit(v) for kv in WEIGHTS.items() for v in kv])[F.col("source")]
    late = (at < F.col("mix_rank") - 1e-6) | (at > F.col("mix_rank") + 1 + 1e-6)
    return mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("mix_rank").cast("long").alias("last"), F.countDistinct("mix_rank").alias("n_ranks"), F.count_if(late).alias("n_late"))


@query("select count(*) as n, (count(*) - 1)::bigint as last, count(*) as n_positions, true as ordered from documents where source in ('pdfa_letters', 'idl_memos', 'iam_forms')")
def q_global_order(spark: SparkSession, d: str) -> DataFrame:
    """M1: positions of the mixture without a gap, in the order of their times."""
    mixed = mixture.interleaved(table(spark, d, "documents").select("doc_id", "source"), WEIGHTS)
    placed = mixture.global_order(mixed, ["mix_time", "source", "doc_id"])
    ends = placed.groupBy(F.floor(F.col("position") / 1000).alias("block")).agg(F.min("mix_time").alias("low"), F.max("mix_time").alias("high"), F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("k"), F.max("position").alias("last"))
    turned = F.coalesce(F.col("low") < F.max("high").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))  # a row per thousand
    return ends.withColumn("turned", turned).agg(F.sum("n").alias("n"), F.max("last").cast("long").alias("last"), F.sum("k").alias("n_positions"), F.coalesce(~F.max("turned"), F.lit(True)).alias("ordered"))


SHARDS = "s as (select shard, row_number() over (order by shard) - 1 as k, count(*) over () as n from (select distinct shard from manifest where shard is not null))"


@query(f"with {SHARDS}, w as (select shard, case when n < 8 then r.i else k % 8 end as worker from s, range(0, 8) r(i) where n < 8 or r.i = 0) select shard, worker, xor(20 * 100003, worker * 31)::bigint as seed from w")
def q_shard_workers(spark: SparkSession, d: str) -> DataFrame:
    """M5, M6: shards dealt to eight workers, and the workers' seeds."""
    rows = mixture.worker_slices(table(spark, d, "manifest").filter("shard is not null").select("shard"), 8)
    return rows.withColumn("seed", mixture.worker_seed(F.lit(20), F.col("worker")))


@query(f"with {SHARDS} select shard, (k % 100000)::bigint as worker from s")
def q_shard_workers_cap(spark: SparkSession, d: str) -> DataFrame:
    """M5: with fewer shards than workers, one each."""
    return mixture.worker_slices(table(spark, d, "manifest").filter("shard is not null").select("shard"), 100_000, "cap")


@query(r"""select case regexp_extract(shard, '[^/]*$') when 'pdfa-eng-train-0118.tar' then 'val' when 'pdfa-eng-train-0119.tar' then 'test' else 'train' end as locked, count(*) as n, count(distinct shard) as n_shards from manifest where shard is not null group by 1""")
def q_locked_split(spark: SparkSession, d: str) -> DataFrame:
    """Splits locked by the shard's base name."""
    rows = table(spark, d, "manifest").filter("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("k"))
    return rows.groupBy(filters.shard_split(F.col("shard")).alias("locked")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_shards"))


@query(r"""select shard, count(*) as n from manifest where shard is not null and regexp_extract(shard, '[^/]*$') not in ('pdfa-eng-train-0118.tar', 'pdfa-eng-train-0119.tar') group by 1""")
def q_unlocked_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards that aren't locked."""
    rows = table(spark, d, "manifest").filter("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    return filters.without_locked(rows, rows.filter(filters.shard_split(F.col("shard")) != "train").select("shard"))


@query(rf"""with {GT}, p as (select doc_id, count(*) as n, count(*) filter (x1 >= 0 and x1 < x2 and x2 <= 1700 and y1 >= 0 and y1 < y2 and y2 <= 2200) as inside, count(*) filter (regexp_matches(text, '[^\x{{0000}}-\x{{024F}}\s\p{{Z}}]')) as foreign_lines from gt group by 1),
 r as (select coalesce(d.source, 'none') as shard, d.mean_score is null as failed, coalesce(p.n, 0) as n, coalesce(inside, 0) as inside, coalesce(foreign_lines, 0) as fl from documents d left join p using (doc_id)),
 k as (select shard, failed, n, not failed and n > 0 as ok, inside, fl from r),
 a as (select shard, count(*) as n_attempted, count(*) filter (ok) as decode_ok, count(*) filter (not failed and n = 0) as zero_line, count(*) filter (failed) as render_fail, coalesce(sum(n) filter (ok), 0) as bbox_total, coalesce(sum(inside) filter (ok), 0) as bbox_inside, coalesce(sum(fl) filter (ok), 0) as non_latin_lines,
   coalesce(median(n) filter (ok), 0) as median_lines, list_sort(list(n) filter (ok)) as v from k group by 1)
 select shard, n_attempted, decode_ok, zero_line, render_fail, bbox_total::bigint as bbox_total, bbox_inside::bigint as bbox_inside, non_latin_lines::bigint as non_latin_lines, decode_ok / greatest(n_attempted, 1)::double as decode_ok_frac, bbox_inside / greatest(bbox_total, 1)::double as bbox_inside_frac,
  non_latin_lines / greatest(bbox_total, 1)::double as non_latin_frac, median_lines::double as median_lines, coalesce(v[least(len(v) - 1, cast(floor(0.95::double * len(v)) as bigint)) + 1], 0)::int as p95_lines, decode_ok / greatest(n_attempted, 1)::double < 0.9 as is_flagged from a""")
def q_shard_audit(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source as records of shards; those without a score count as failed."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.coalesce("source", F.lit("none")).alias("shard"), F.col("mean_score").isNull().alias("failed"))
    rows = docs.join(x.pages(spark, d).drop("source"), "page_id", "left").withColumn("lines", F.coalesce("lines", F.expr("cast(array() as array<struct<text: string, x1: int, y1: int, x2: int, y2: int>>)")))
    found = audit.shard_audit(rows)
    return found.join(audit.flagged(found).select("shard", F.lit(True).alias("is_flagged")), "shard", "left").na.fill(False, ["is_flagged"])


@query("select d.doc_id, l.kind, l.labelled_by from documents d join page_labels l using (doc_id)")
def q_sidecar_join(spark: SparkSession, d: str) -> DataFrame:
    """Records with their sidecars, a plain join."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "page_labels"), "doc_id")


@query("select doc_id, kind, labelled_by from page_labels where doc_id not in (select doc_id from documents)")
def q_sidecar_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Sidecars without a record."""
    return cache.orphans(table(spark, d, "page_labels"), table(spark, d, "documents"), "doc_id")


@query("""select rec_id, case when coalesce(version, 1) <> 1 then 'version_not_supported' when coalesce(image, '') = '' then 'image_missing' when ref is null then 'ref_missing'
  when task is not null and task not in ('ocr', 'ocr_layout', 'region_ocr', 'find_it') then 'task_unknown' end as error,
  case when coalesce(version, 1) = 1 and coalesce(image, '') <> '' and ref is not null and coalesce(task, 'ocr') in ('ocr', 'ocr_layout', 'region_ocr', 'find_it') then greatest(1, coalesce(len(bboxes), 0)) end::int as n_lines from manifest""")
def q_manifest_validate(spark: SparkSession, d: str) -> DataFrame:
    """SC11, SC11a, F12: records written as JSON lines and read again."""
    boxes = F.concat(F.lit("["), F.array_join(F.transform("bboxes", lambda b: F.to_json(F.array(*[b[k].cast("string") for k in ("x1", "y1", "x2", "y2")], F.coalesce(b["text"], F.lit(""))))), ","), F.lit("]"))
    boxes = F.regexp_replace(boxes, r'"(-?\d+)","(-?\d+)","(-?\d+)","(-?\d+)",', "$1,$2,$3,$4,")
    head = F.to_json(F.struct("version", "image", "ref", "task"))
    comma = F.when(F.length(head) > 2, ",").otherwise("")
    value = F.when(F.col("bboxes").isNull(), head).otherwise(F.concat(F.regexp_replace(head, r"\}$", ""), comma, F.lit('"bboxes":'), boxes, F.lit("}")))
    rows = manifest.parsed(table(spark, d, "manifest").select("rec_id", value.alias("value")))
    return rows.select("rec_id", "error", F.size("lines").alias("n_lines")).withColumn("n_lines", F.when(F.col("n_lines") >= 0, F.col("n_lines")))


@query("""with k as (select rec_id, list_sort(list_filter([case when image is not null then 'image' end, case when ref is not null then 'ref' end, case when task is not null then 'task' end, case when version is not null then 'version' end], lambda v: v is not null)) as f from manifest),
 f as (select min_by(f, rec_id) as first from k) select rec_id, array_to_string(list_sort(list_filter(first, lambda v: not list_contains(f, v))), ',') as missing, array_to_string(list_sort(list_filter(f, lambda v: not list_contains(first, v))), ',') as extra from k, f""")
def q_manifest_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that differ from the first record's."""
    rows = table(spark, d, "manifest").select("rec_id", F.to_json(F.struct("version", "image", "ref", "task")).alias("value"))
    found = filters.same_fields(rows, "value", "rec_id")
    return found.select("rec_id", F.array_join(F.array_sort("missing"), ",").alias("missing"), F.array_join(F.array_sort("extra"), ",").alias("extra"))


@query("""with b as (select rec_id, unnest(bboxes) as b from manifest) select rec_id, count(*) as n, count(*) filter (b.x2 < b.x1 or b.y2 < b.y1) as inverted, count(*) filter (b.x2 - b.x1 < 1 or b.y2 - b.y1 < 1) as flat, sum(greatest(0, b.x2 - b.x1)::bigint * greatest(0, b.y2 - b.y1))::bigint as area from b group by 1""")
def q_box_faults(spark: SparkSession, d: str) -> DataFrame:
    """Inverted and flat boxes of manifest records."""
    b = F.col("b")
    rows = table(spark, d, "manifest").select("rec_id", F.explode("bboxes").alias("b"))
    return rows.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((b["x2"] < b["x1"]) | (b["y2"] < b["y1"])).alias("inverted"), F.count_if(g.degenerate(b)).alias("flat"), F.sum(g.safe_area(b)).alias("area"))


@query("""select page_id, len(list_filter(lines, lambda l: l.bbox is not null and len(l.bbox) = 4 and trim(coalesce(l.text, '')) <> ''))::int as n_lines from maurdor_pages where lang in ('en', 'en+fr')""")
def q_language_pages(spark: SparkSession, d: str) -> DataFrame:
    """SC9, SC9a, F9: pages of the wanted languages with their decoded lines."""
    lines = F.transform("lines", lambda v: F.struct(v["text"].alias("text"), v["bbox"].alias("bbox"), F.lit(None).cast("array<int>").alias("box")))
    rows = table(spark, d, "maurdor_pages").filter(filters.in_languages(F.col("lang")))
    return rows.select("page_id", F.size(annotations.language_lines(lines)).alias("n_lines"))


@query("""select doc_id::varchar as name, case when doc_id % 13 = 0 then 'new' when doc_id % 7 = 0 then 'drift' else 'match' end as state from documents where text is not null""")
def q_provenance_drift(spark: SparkSession, d: str) -> DataFrame:
    """Recorded against present digests."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("name"), "text")
    now = docs.select("name", t.digest(F.col("text")).alias("sha"))
    then = docs.filter("doc_id % 13 <> 0").select("name", t.digest(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("sha"))
    return mixture.drift(then, now)


@query(f"with {GT}, s as (select doc_id, string_agg(text || '|' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || chr(10), '' order by line_no) as s from gt group by 1) select doc_id, sha256(s) as digest from s")
def q_stream_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every page's lines."""
    return audit.stream_digest(x.pages(spark, d)).withColumnRenamed("page_id", "doc_id")


@query("""with l as (select doc_id, p.z[2] as line_no, trim(p.z[1]) as text from (select doc_id, unnest(list_zip(string_split(text, chr(10)), range(0, len(string_split(text, chr(10)))))) as z from documents where text is not null) p),
 g as (select *, sum((text = '')::int) over (partition by doc_id order by line_no) as grp from l), a as (select doc_id, grp, string_agg(text, ' ' order by line_no) as text from g where text <> '' group by 1, 2)
 select doc_id, row_number() over (partition by doc_id order by grp) - 1 as paragraph_no, md5(text) as digest from a""")
def q_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """W7, SC16: lines between blank lines."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return ordering.paragraphs(rows, ["doc_id"], "line_no").select("doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), F.md5("text").alias("digest"))


HEAD = "case when event_id % 10 = 0 then (event_id % 3 + 1)::int end"


@query(f"""with e as (select user_id, event_id, {HEAD} as stage from events), a as (select *, last_value(stage ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as prev from e)
 select user_id, event_id, coalesce(last_value(stage ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row), 0)::int as stage,
  (1 + sum(case when stage is not null and prev is not null and stage <= prev then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and current row))::int as attempt from a""")
def q_attempts(spark: SparkSession, d: str) -> DataFrame:
    """W9, W10, ST3: stage filled forward, attempts counted."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 10 == 0, (F.col("event_id") % 3 + 1).cast("int")).alias("stage"))
    return ordering.with_attempts(rows, "stage", ["user_id"], ["event_id"])


@query("""with e as (select user_id, event_id, event_id % 3 <> 0 as f from events), g as (select *, sum((not f)::int) over (partition by user_id order by event_id) as grp from e)
 select user_id, event_id, (sum(f::int) over (partition by user_id, grp order by event_id rows between unbounded preceding and current row))::bigint as streak from g""")
def q_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of runs."""
    rows = table(spark, d, "events").select("user_id", "event_id")
    return ordering.with_streak(rows, F.col("event_id") % 3 != 0, ["user_id"], ["event_id"])


@query("""with w as (select user_id, event_id, list(coalesce(value, 0)) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) as l from events)
 select user_id, event_id, round(list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i] * (case when i = 1 then 1.0::double else 2.0::double / (len(l) + 1) end) * pow(1 - 2.0::double / (len(l) + 1), len(l) - i))), 6) as ema from w""")
def q_ema(spark: SparkSession, d: str) -> DataFrame:
    """Exponential mean of the last five values."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.coalesce("value", F.lit(0.0)).alias("value"))
    return rows.select("user_id", "event_id", F.round(ordering.tail_ema("value", ["user_id"], ["ts", "event_id"]), 6).alias("ema"))


EARLY = """with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as k from events where value is not null and user_id is not null and event_id is not null),
 s as (select user_id, event_id, k, value, [value] as tail, value as smoothed, value as best, 0 as waited, 0 as spiked from e where k = 1
  union all select user_id, event_id, k, value, tail, smoothed, case when better then smoothed else best end, case when better then 0 else waited + 1 end, case when (case when better then smoothed else best end) - value > 50 then spiked + 1 else 0 end
   from (select *, smoothed - best > 0.5 as better from (select *, list_sum(list_transform(range(1, len(tail) + 1), lambda i: tail[i] * (case when i = 1 then 1.0::double else 2.0::double / (len(tail) + 1) end) * pow(1 - 2.0::double / (len(tail) + 1), len(tail) - i))) as smoothed
    from (select e.user_id, e.event_id, e.k, e.value, list_append(s.tail, e.value)[-5:] as tail, s.best, s.waited, s.spiked from s join e on e.user_id = s.user_id and e.k = s.k + 1))))
 select user_id::varchar as run, event_id as step, round(smoothed, 6) as smoothed, round(best, 6) as best, waited::int as waited, spiked::int as spiked, case when k <= 5 then null when waited >= 10 then 'patience_exceeded' when spiked >= 3 then 'spike_detected' end as reason from s"""


@query(EARLY)
def q_early_stop(spark: SparkSession, d: str) -> DataFrame:
    """W3, W4, ST7: the early-stop fold of every user's values."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value")
    found = early_stop.decisions(rows, early_stop.Rule(spike=50.0, min_delta=0.5))
    return found.select("run", "step", F.round("smoothed", 6).alias("smoothed"), F.round("best", 6).alias("best"), "waited", "spiked", "reason")


@query("""with r as (select i, case when i < 50 then 0.001::double * (i + 1) / 50 when i >= 900 then 0.0001::double else 0.001::double * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * ((i - 50) / 850.0::double)))) end as lr from range(0, 1000) t(i))
 select i::bigint as step, round(lr, 12) as lr, round(1 - exp(-(i::double) / 50000), 12) as dropout from r""")
def q_schedules(spark: SparkSession, d: str) -> DataFrame:
    """Learning-rate and dropout schedules over a thousand steps."""
    s = F.col("id")
    return spark.range(1000).select(s.alias("step"), F.round(schedules.warmup_cosine(s, 50, 900, 0.001, 0.1), 12).alias("lr"), F.round(schedules.saturating(s), 12).alias("dropout"))


@query("""with e as (select *, event_id % 10 as m from events where user_id is not null and ts is not null), b as (select case when m = 0 then 'stage_header' when m <= 5 then 'train_step' when m = 6 then 'val' when m = 7 then 'checkpoint' when m = 8 then 'supervisor_restart' end as kind from e where m < 9)
 select kind, count(*) as n from b group by 1""")
def q_log_parse(spark: SparkSession, d: str) -> DataFrame:
    """ST2: kinds of log lines."""
    return telemetry.parsed(x.log_lines(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def q_log_events(spark: SparkSession, d: str) -> DataFrame:
    """ST2 to ST6: events with attempts, streaks, stalls and restarts; tested on golden logs."""
    return telemetry.events(x.log_lines(spark, d))


@query("select 0::bigint as only_batch, 0::bigint as only_stream")
def q_log_stream(spark: SparkSession, d: str) -> DataFrame:
    """ST1 to ST6, SK9, SC19: events of a stream of files, written as JSON lines, against the batch form: rows that one of them lacks."""
    at = scratch(spark, "stream")
    lines = x.log_lines(spark, d)
    lines.repartition(4, "log").sortWithinPartitions("log", "seq").write.json(f"{at}/in")
    telemetry.write_jsonl(telemetry.stream_events(telemetry.stream(spark, f"{at}/in")), f"{at}/out", f"{at}/state").awaitTermination()
    cols = ("log", "seq", "sub", "event", "attempt", "stage", "step", "streak", "restart_streak", "alert", "rate")
    streamed, batch = spark.read.schema(telemetry.OUTPUT).json(f"{at}/out").select(*cols), telemetry.events(lines).select(*cols)
    sides = batch.withColumn("b", F.lit(1)).unionByName(streamed.withColumn("b", F.lit(-1))).groupBy(*cols).agg(F.sum("b").alias("b"))
    return sides.agg(F.coalesce(F.sum(F.greatest("b", F.lit(0))), F.lit(0)).alias("only_batch"), F.coalesce(F.sum(F.greatest(-F.col("b"), F.lit(0))), F.lit(0)).alias("only_stream"))


@query(f"""with {GT}, b as (select doc_id, x1, x2, max(x2) over (partition by doc_id order by x1, x2 rows between unbounded preceding and 1 preceding) as m from gt)
 select doc_id, sum(greatest(0, x2 - greatest(x1, coalesce(m, x1))))::bigint as covered from b group by 1""")
def q_interval_union(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a page covered by any line."""
    return ordering.interval_union(x.gt_lines(spark, d), ["doc_id"])


@query(f"""with {GT}, r as (select doc_id, line_no, (doc_id + line_no) % 3 <> 0 as hit, count(*) over (partition by doc_id) as n_truth from gt), c as (select *, sum(hit::int) over w as tp, count(*) over w as n from r window w as (partition by doc_id order by line_no rows between unbounded preceding and current row))
 select doc_id, line_no, tp / n::double as precision, tp / n_truth::double as recall from c""")
def q_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """Running precision and recall."""
    rows = x.gt_lines(spark, d).select("doc_id", "line_no", ((F.col("doc_id") + F.col("line_no")) % 3 != 0).alias("hit"))
    rows = rows.join(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_truth")), "doc_id")
    return ordering.precision_recall(rows, ["doc_id"], ["line_no"]).select("doc_id", "line_no", "precision", "recall")


@query(f"with {GT} select doc_id, line_no, (20 + coalesce(sum(y2 - y1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0))::bigint as y from gt")
def q_layout_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Where each line begins below those above."""
    rows = x.gt_lines(spark, d).select("doc_id", "line_no", (F.col("y2") - F.col("y1")).alias("h"))
    return ordering.layout_cursor(rows, ["doc_id"], "line_no", "h").select("doc_id", "line_no", F.col("y").cast("long").alias("y"))


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as r from events) where r <= 3")
def q_last_three(spark: SparkSession, d: str) -> DataFrame:
    """The newest three of each user."""
    return ordering.last_k(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 3)


@query("""with r as (select user_id, event_id, coalesce(value, 0) as value, row_number() over w as f, count(*) over (partition by user_id) as n from events window w as (partition by user_id order by event_id))
 select user_id, count(*) as n_steps, round(avg(value) filter (f <= 50), 6) as loss_first, round(avg(value) filter (f > n - 50), 6) as loss_last from r group by 1""")
def q_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """First and last fifty values of a run."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.coalesce("value", F.lit(0.0)).alias("value"))
    return audit.run_summary(rows, "user_id", "event_id", "value").select("user_id", "n_steps", F.round("loss_first", 6).alias("loss_first"), F.round("loss_last", 6).alias("loss_last"))


NEEDED = list("àâçéèêëîïôùûüœ€")


@query(f"""with {GT}, c as (select distinct unnest(string_split(text, '')) as c from gt), n as (select unnest([{", ".join(f"'{c}'" for c in NEEDED)}]) as c)
 select (select string_agg(c, '' order by c) from n where c in (select c from c)) as present, coalesce((select string_agg(c, '' order by c) from n where c not in (select c from c)), '') as missing""")
def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    """French signs that occur."""
    found = audit.coverage(x.gt_lines(spark, d), NEEDED)
    return found.select(F.array_join("present", "").alias("present"), F.array_join("missing", "").alias("missing"))


@query(f"""with {GT} select doc_id, line_no, x1 - 3 as ex1, y2 + 3 as ey2, (x1 <= 60 and y1 <= 500 and x2 >= 100 and y2 >= 30)::boolean as holds, least(1700.0::double / (x2 + 100), 2200.0::double / (y2 + 100), 1.0) as scale, round_even((x2 + 100) * least(1700.0::double / (x2 + 100), 2200.0::double / (y2 + 100), 1.0::double), 0)::int as fit_w, ((y2 + 100 + 31) // 32 * 32)::int as padded from gt""")
def q_page_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Expansion, containment, fitting and filling."""
    b, w, h = own_box(), F.col("x2") + 100, F.col("y2") + 100
    e, f = g.expanded(b, 3), g.fit_size(w, h, F.lit(1700), F.lit(2200))
    return x.gt_lines(spark, d).select("doc_id", "line_no", e["x1"].alias("ex1"), e["y2"].alias("ey2"), g.contains(b, g.box(60, 500, 100, 30)).alias("holds"), f["scale"].alias("scale"), f["w"].alias("fit_w"), g.up_to_multiple(h, 32).alias("padded"))


@query(f"with {GT} select doc_id, doc_id % 5 = 0 as fixed, true as valid from gt group by 1")
def q_relabelled(spark: SparkSession, d: str) -> DataFrame:
    """Tasks drawn by key for whole pages. Fixed pages stay; a region is a line's box, a query stands in a line."""
    rows = posed(spark, d).withColumn("meta", F.create_map(F.lit("source_family"), F.when(F.col("page_id") % 5 == 0, "synth_handwritten").otherwise("other")))
    old = F.struct("task", "query_text", "query_bbox")
    made = tasks.relabelled(rows.withColumn("old", old), {k: 0.25 for k in MIX})
    fixed = tasks.fixed_task(F.col("meta"))
    boxes = F.exists("lines", lambda v: F.struct(*[v[k].alias(k) for k in g.AXES]) == F.col("query_bbox"))
    found = F.exists("lines", lambda v: F.contains(F.array_join(t.words(v["text"]), " "), F.col("query_text")))
    drawn = (
        F.when(F.col("task") == "region_ocr", boxes & F.col("query_text").isNull())
        .when(F.col("task") == "find_it", found & F.col("query_bbox").isNull() & F.size(t.words(F.col("query_text"))).between(1, 11))
        .otherwise(F.col("query_text").isNull() & F.col("query_bbox").isNull())
    )
    same = F.struct("task", "query_text", "query_bbox").eqNullSafe(F.col("old"))
    return made.select(F.col("page_id").alias("doc_id"), fixed.alias("fixed"), F.when(fixed, same).otherwise(drawn | same).alias("valid"))


@query()
def q_wrapped_pages(spark: SparkSession, d: str) -> DataFrame:
    """M14, SC23, SC24: whole texts wrapped to synthetic pages; tested on small texts."""
    from ..sources import synth

    pages = synth.paged_text(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), canvas_h=10_000_000)
    return pages.select("page_id", F.size("lines").alias("n_lines"))


@query("""with r as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as k from events)
 select user_id, count(*) filter (value is not null) as n_batches, count(*) filter (value is null) as n_skipped, round(avg(value), 6) as mean_loss from r where k <= 50 group by 1""")
def q_validation_summary(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty batches of each run."""
    rows = table(spark, d, "events").select("user_id", "event_id", "value")
    return audit.validation_summary(rows, "user_id", ["event_id"], "value").withColumn("mean_loss", F.round("mean_loss", 6))


@query("""select image, coalesce(task, 'ocr_layout') as task, ref, greatest(1, coalesce(len(bboxes), 0))::int as n_lines, coalesce(list_sum(list_transform(bboxes, lambda b: b.x1 + b.y2)), 0)::bigint as corners
 from manifest where coalesce(image, '') <> '' and ref is not null and coalesce(task, 'ocr') in ('ocr', 'ocr_layout', 'region_ocr', 'find_it')""")
def q_manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """SC11, SK1: valid records written as JSON lines and read strictly."""
    boxes = F.transform("bboxes", lambda b: F.struct(F.coalesce(b["text"], F.lit("")).alias("text"), *[b[k].alias(k) for k in g.AXES]))
    whole = F.array(F.struct(F.col("ref").alias("text"), *[F.lit(0).alias(k) for k in g.AXES]))
    rows = table(spark, d, "manifest").filter("coalesce(image, '') <> '' and ref is not null").filter(F.coalesce("task", F.lit("ocr")).isin(*tasks.TASKS))
    at = scratch(spark, "manifest")
    manifest.write(rows.select("image", "ref", "task", F.when(F.size("bboxes") > 0, boxes).otherwise(whole).alias("lines")), at)
    back = manifest.read(spark, at)
    return back.select("image", "task", "ref", F.size("lines").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, v: a + v["x1"] + v["y2"]).alias("corners"))


@query(f"""with {GT}, p as (select doc_id, max(x2) as w from gt group by 1), s as (select doc_id, w, least(1.0::double, 850 / w::double) as s from p)
 select s.doc_id, round_even(w * s, 0)::int as img_w, sum(round_even(gt.x2 * s, 0))::bigint as x2 from s join gt using (doc_id) group by 1, 2""")
def q_cache_pages(spark: SparkSession, d: str) -> DataFrame:
    """SC12, SK3, P20: pages fitted to a canvas, cached in two parts, read back."""
    from . import verbs

    pages = x.pages(spark, d).withColumn("img_w", F.array_max("lines.x2")).withColumn("img_h", F.lit(1))
    at = scratch(spark, "cache")
    verbs.cache_pages(pages.filter("page_id % 2 = 0"), at, (10, 850))
    verbs.cache_pages(pages, at, (10, 850))
    return cache.read(spark, at).select(F.col("page_id").alias("doc_id"), "img_w", F.aggregate("lines", F.lit(0).cast("long"), lambda a, v: a + v["x2"]).alias("x2"))
