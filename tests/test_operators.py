import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.operators import audit, detection, filters, mixture, ordering, recognition, serialize, tasks
from pageloom.schema import LINES

GRID = serialize.Grid(canvas_h=200, canvas_w=200, quantizer=10)


def lines(*rows):
    return [{"text": t, "x1": a, "y1": b, "x2": c, "y2": d} for t, a, b, c, d in rows]


def words_lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (x != y)))
        prev = now
    return prev[-1]


def test_recognition(spark):
    pairs = spark.createDataFrame([(1, "a a b", "a b b"), (2, "abc", ""), (3, "", ""), (4, None, "x")], "k int, ref string, hyp string")
    cer = {r["k"]: r["c"] for r in pairs.select("k", recognition.doc_cer(F.col("ref"), F.col("hyp")).alias("c")).collect()}
    assert cer[2] == 1.0 and cer[3] == 0.0 and cer[4] == 1.0 and cer[1] == pytest.approx(1 / 5)
    one = pairs.filter("k = 1")
    r = recognition.word_prf(one, "k").first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 1) and r["precision"] == pytest.approx(2 / 3)
    two = spark.createDataFrame([("same", "same"), ("abcd", "wxyz")], "ref string, hyp string")
    ap = {r["threshold"]: r["ap"] for r in recognition.cer_ap(two, (0.0, 1.0)).collect()}
    assert ap == {0.0: 0.5, 1.0: 1.0}
    nothing = pairs.filter("k > 9")
    assert recognition.corpus_cer(nothing).first()["cer"] == 0.0 and recognition.corpus_wer(nothing).first()["wer"] == 0.0
    assert recognition.empty_hypotheses(pairs).first()["n_empty"] == 2


def test_word_errors_brute_force(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice("abcdé") for _ in range(r.randint(0, 9))), " ".join(r.choice("abcdé") for _ in range(r.randint(0, 9)))) for k in range(200)]
    got = spark.createDataFrame(rows, "k int, ref string, hyp string").select("k", recognition.word_errors(F.col("ref"), F.col("hyp")).alias("e")).collect()
    for row in got:
        assert row["e"] == words_lev(rows[row["k"]][1].split(), rows[row["k"]][2].split())


def inter(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def area(a):
    return max(0, a[2] - a[0]) * max(0, a[3] - a[1])


def brute_deteval(gt, pred):
    if not gt or not pred:
        return (1.0, 1.0) if not gt and not pred else (0.0, 0.0)
    m = [[inter(a, p) >= 0.8 * max(area(a), 1e-9) and inter(a, p) >= 0.4 * max(area(p), 1e-9) for p in pred] for a in gt]
    used, one, half = set(), 0, 0
    for row in m:
        free = [j for j, ok in enumerate(row) if ok and j not in used]
        if free:
            used.add(free[0])
            one += 1
        elif sum(row) > 1:
            half += 1
    many = sum(1 for j in range(len(pred)) if j not in used and sum(row[j] for row in m) > 1)
    return (one + 0.5 * many) / len(pred), (one + 0.5 * half) / len(gt)


def brute_ap(gt, pred, scores, thr):
    if not gt or not pred:
        return 1.0 if not gt and not pred else 0.0
    used, tp, total = set(), 0, 0.0
    for n, j in enumerate(sorted(range(len(pred)), key=lambda j: (-scores[j], j)), 1):
        best = max(((inter(g, pred[j]) / (area(g) + area(pred[j]) - inter(g, pred[j])), -i) for i, g in enumerate(gt) if i not in used and inter(g, pred[j]) > 0), default=None)
        if best and best[0] >= thr:
            used.add(-best[1])
            tp += 1
            total += tp / n
    return total / len(gt)


def brute_area(gt, pred, w, h):
    cover = lambda bs: {(x, y) for b in bs for x in range(max(0, b[0]), min(w, b[2])) for y in range(max(0, b[1]), min(h, b[3]))}
    a, b = cover(gt), cover(pred)
    if not a and not b:
        return 1.0, 1.0
    return len(a & b) / len(b) if b else 0.0, len(a & b) / len(a) if a else 0.0


def test_detection_brute_force(spark):
    r = random.Random(7)

    def some(n):
        out = []
        for _ in range(n):
            x, y = r.randint(-3, 30), r.randint(-3, 30)
            out.append((x, y, x + r.randint(0, 12), y + r.randint(0, 12)))
        return out

    cases = []
    for k in range(150):
        gt = some(r.randint(0, 5))
        pred = [tuple(v + r.randint(-1, 1) for v in b) if r.random() < 0.7 else some(1)[0] for b in gt + some(r.randint(0, 2))]
        pred = [b for b in pred if b[2] >= b[0] and b[3] >= b[1]]
        cases.append((k, gt, pred, [r.choice((0.2, 0.5, 0.9)) for _ in pred]))
    cases += [(998, [(0, 0, 100, 100)], [(0, 0, 100, 50), (0, 50, 100, 100)], [1.0, 1.0]), (999, [(0, 0, 100, 100)], [(17, 0, 117, 100)], [1.0])]
    b = "array<struct<x1: int, y1: int, x2: int, y2: int>>"
    rows = spark.createDataFrame(cases, f"k int, gt {b}, pred {b}, scores array<double>")
    got = detection.page_metrics(rows, F.lit(25), F.lit(25)).collect()
    for row in got:
        k, gt, pred, scores = next(c for c in cases if c[0] == row["k"])
        assert (row["deteval"]["precision"], row["deteval"]["recall"]) == pytest.approx(brute_deteval(gt, pred)), k
        assert (row["area"]["precision"], row["area"]["recall"]) == pytest.approx(brute_area(gt, pred, 25, 25)), k
        for thr in detection.IOU_THRESHOLDS:
            assert row["ap"][thr] == pytest.approx(brute_ap(gt, pred, scores, thr)), (k, thr)
        if k == 998:
            assert row["deteval"]["recall"] == 0
        if k == 999:
            assert [row["ap"][t] for t in detection.IOU_THRESHOLDS] == [1.0, 1.0, 1.0, 0.0]
    assert detection.summary(detection.page_metrics(rows.limit(3), F.lit(25), F.lit(25))).first()["n_pages"] == 3


def test_serialisation_round_trip(spark):
    page = lines(("b c", 100, 50, 150, 60), ("a", 10, 20, 50, 30), ("same y", 5, 50, 20, 60))
    df = spark.createDataFrame([(1, page)], f"page_id int, lines {LINES}")
    tok = {s: df.select(serialize.serialised(F.col("lines"), GRID, s)).first()[0] for s in serialize.SCHEMES}
    assert tok["original"] == ["<x_1>", "<y_2>", "a", "<x_5>", "<y_3>", "<x_0>", "<y_5>", "same", "y", "<x_2>", "<y_6>", "<x_10>", "<y_5>", "b", "c", "<x_15>", "<y_6>"]
    assert tok["segmented"][:6] == ["a", "same", "y", "b", "c", "</text>"] and tok["segmented"][-1] == "</location>"
    assert tok["unified"][:3] == ["<xy_1>", "<xy_2>", "a"]
    back = serialize.parse(tok["original"])
    assert [x["text"] for x in back] == ["a", "same y", "b c"] and back[0]["x2"] == 50
    with pytest.raises(ValueError):
        serialize.serialised(F.col("lines"), GRID, "other")


@pytest.mark.parametrize(
    "tokens, texts",
    [
        ([], []),
        (["<x_1>"], []),
        (["x", "<x_1>", "<y_1>", "a", "<x_2>", "<y_2>"], ["a"]),
        (["<x_1>", "a", "<x_1>", "<y_1>", "b", "<x_2>", "<y_2>"], ["b"]),
        (["<x_1>", "<y_1>", "a", "<x_2>", "b", "<x_3>", "<y_3>", "c", "<x_4>", "<y_4>"], ["c"]),
        (["<x_1>", "<y_1>", "a", "<x_2>"], []),
        (["<x_1>", "<y_1>", "<x_2>", "<y_2>"], [""]),
    ],
)
def test_parser_recovers(tokens, texts):
    assert [x["text"] for x in serialize.parse(tokens)] == texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<x_1>", "<y_1>", "a", "b"]), max_size=12))
def test_parser_never_fails(tokens):
    for x in serialize.parse(tokens):
        assert "<x_" not in x["text"]


def test_targets(spark):
    page = lines(("one two", 0, 0, 50, 10), ("two three", 0, 20, 90, 30))
    b = "struct<x1: int, y1: int, x2: int, y2: int>"
    rows = [(1, "ocr", None, None), (2, "ocr_layout", None, None), (3, "region_ocr", None, (0, 0, 60, 15)), (4, "find_it", " two ", None), (5, "find_it", "none", None)]
    df = spark.createDataFrame([(*r, page) for r in rows], f"page_id int, task string, query_text string, query_bbox {b}, lines {LINES}")
    got = {r["page_id"]: r for r in serialize.targets(df, GRID).collect()}
    assert got[1]["tokens"] == ["<s>", "<task=ocr>", "one", "two", "two", "three", "</s>"] and got[1]["prompt_len"] == 2
    assert got[3]["tokens"] == ["<s>", "<task=region_ocr>", "Read", "at", "0,0,60,15", "one", "two", "</s>"]
    assert got[4]["tokens"][4:] == ["<x_0>", "<y_0>", "<x_5>", "<y_1>", "<x_0>", "<y_2>", "<x_9>", "<y_3>", "</s>"]
    assert got[5]["tokens"] == ["<s>", "<task=find_it>", "<find_it>", "none", "</s>"]
    clipped = {r["page_id"]: r for r in serialize.targets(df, GRID, limit=5).collect()}
    assert clipped[1]["tokens"] == ["<s>", "<task=ocr>", "one", "two", "</s>"] and clipped[1]["full_len"] == 7
    with pytest.raises(Exception, match="query_bbox"):
        serialize.targets(df.withColumn("query_bbox", F.lit(None).cast(b)).filter("page_id = 3"), GRID).collect()
    forced = serialize.teacher_forced(serialize.targets(df.filter("page_id = 1"), GRID), 9).first()
    assert forced["input"][0] == "<s>" and forced["label"][5] == "</s>" and forced["label"][8] == "<pad>" and forced["prompt_mask"][:2] == [True, False]
    boxes = df.limit(1).select(serialize.answer_boxes(F.array(*map(F.lit, ("<x_1>", "<y_2>", "<x_3>", "<y_4>", "<x_5>")))).alias("b")).first()["b"]
    assert [tuple(x) for x in boxes] == [(10, 20, 30, 40)]


def test_tasks(spark):
    page = lines(("one two three", 0, 0, 50, 10))
    rows = [(k, page if k % 10 else [], "ocr", None, None, {"source_family": "synth_handwritten" if k % 4 == 0 else "x"}) for k in range(2000)]
    df = spark.createDataFrame(rows, f"page_id int, lines {LINES}, task string, query_text string, query_bbox struct<x1: int, y1: int, x2: int, y2: int>, meta map<string, string>")
    got = tasks.relabelled(df, {"ocr_layout": 1, "region_ocr": 1, "find_it": 2}).collect()
    free = [r for r in got if r["page_id"] % 4 and r["page_id"] % 10]
    assert all(r["task"] == "ocr" for r in got if r["page_id"] % 4 == 0)
    assert 0.42 < sum(r["task"] == "find_it" for r in free) / len(free) < 0.58
    assert all(r["query_text"] in ("one two", "two three", "one two three") for r in free if r["task"] == "find_it")
    assert all((r["query_bbox"] is not None) == (r["task"] == "region_ocr") for r in free)
    assert all(r["task"] in ("ocr", "ocr_layout") for r in got if r["page_id"] % 10 == 0)
    assert got == tasks.relabelled(df, {"ocr_layout": 1, "region_ocr": 1, "find_it": 2}).collect()
    with pytest.raises(ValueError):
        tasks.normalised({"ocr": 0})
    with pytest.raises(ValueError):
        tasks.normalised({"other": 1})


def test_filters(spark):
    texts = [("abc", True, True), ("مرحبا", False, True), ("é ü", True, True), ("12", True, False), ("", True, False), ("a11", True, False), ("ab1", True, True)]
    got = spark.createDataFrame([(t,) for t, _, _ in texts], "t string").select("t", filters.latin(F.col("t")).alias("l"), filters.useful_line(F.col("t")).alias("u")).collect()
    for (t, latin, useful), r in zip(texts, got, strict=True):
        assert (r["t"], r["l"], r["u"]) == (t, latin, useful)
    df = spark.createDataFrame([(["a", "", "c", "d"], [[0.1, 0.1, 0.5, 0.1]] * 3, [0.9, 0.9, 0.1])], "t array<string>, b array<array<double>>, s array<double>")
    keep = lambda s: [x["text"] for x in df.select(filters.scored_lines(F.col("t"), F.col("b"), s, F.lit(100), F.lit(100)).alias("l")).first()["l"]]
    assert keep(F.col("s")) == ["a"] and keep(F.lit(None).cast("array<double>")) == ["a", "c"]
    assert filters.main_share(0.3, 0.2) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        filters.main_share(0.7, 0.3)
    filters.guard_training(["a-0117.tar"])
    filters.guard_training(["x/a-0119.tar", "x-90118.tar"])  # other families aren't locked
    with pytest.raises(SystemExit):
        filters.guard_training(["x/pdfa-eng-train-0119.tar"])
    with pytest.raises(SystemExit):
        filters.guard_training(["pdfa-eng-train-0118.tar"])
    filters.guard_training(["pdfa-eng-train-0118.tar"], ("train", "val"))
    named = spark.createDataFrame([("a/pdfa-eng-train-0118.tar",), ("pdfa-eng-train-0119.tar",), ("x-90118.tar",), ("idl-train-0119.tar",)], "s string")
    assert [r[0] for r in named.select(filters.shard_split(F.col("s"))).collect()] == ["val", "test", "train", "train"]


def test_mixture(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"))
    mixed = mixture.interleaved(rows, {"a": 7, "b": 2, "c": 1})
    first = [r["source"] for r in mixture.first_draws(mixed, 1000).collect()]
    assert abs(first.count("a") - 700) <= 2 and abs(first.count("b") - 200) <= 2
    assert {r["source"]: r["n"] for r in mixture.sample_counts(mixed).collect()} == {"a": 1000, "b": 1000, "c": 1000}
    ranks = sorted(r["mix_rank"] for r in mixed.filter("source = 'a'").collect())
    assert ranks == list(range(1000))
    tiny = mixture.interleaved(rows.filter("source <> 'a' or doc_id < 6"), {"a": 1, "b": 1})
    draws = [r["source"] for r in mixture.first_draws(tiny, 20).collect()]
    assert draws.count("a") == 2 and draws.count("b") == 18
    for bad in ([], [("a", -1)], [("a", 0)], [("a", 1), ("a", 2)]):
        with pytest.raises(ValueError):
            mixture.check_mixture(bad)
    shards = spark.createDataFrame([(f"s{k}",) for k in range(3)], "shard string")
    assert mixture.worker_slices(shards, 2).count() == 3 and mixture.worker_slices(shards, 5).count() == 15 and mixture.worker_slices(shards, 5, "cap").count() == 3
    with pytest.raises(ValueError):
        mixture.worker_slices(shards, 2, "other")


def test_percentiles_match_sorted_lists(spark):
    r = random.Random(3)
    data = [(k % 3, r.randint(0, 30)) for k in range(500)] + [(9, None), (8, 5)]
    df = spark.createDataFrame(data, "g int, v int")
    for rule, at in (("floor", lambda n, q: min(n - 1, q * n // 100)), ("rounded", lambda n, q: round(q / 100 * (n - 1))), ("truncated", lambda n, q: min(n - 1, int(q / 100 * n)))):
        for row in audit.percentiles(df, ["g"], "v", rule=rule).collect():
            own = sorted(v for g, v in data if g == row["g"] and v is not None)
            assert [row[f"p{q}"] for q in audit.QS] == [own[at(len(own), q)] for q in audit.QS] and row["n"] == len(own)
    mids = {x["g"]: x["median"] for x in audit.medians(df, ["g"], "v").collect()}
    assert mids[8] == 5.0 and 9 not in mids
    assert audit.percentiles(df.filter("g > 99"), ["g"], "v").count() == 0


def test_ordering(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([1, None, None, 2, 2, None, 1])], "run int, k int, stage int")
    got = ordering.with_attempts(df, "stage", ["run"], ["k"]).orderBy("k").collect()
    assert [(r["stage"], r["attempt"]) for r in got] == [(1, 1), (1, 1), (1, 1), (2, 1), (2, 2), (2, 2), (1, 3)]
    s = ordering.with_streak(df, F.col("stage").isNull(), ["run"], ["k"]).orderBy("k").collect()
    assert [r["streak"] for r in s] == [0, 1, 2, 0, 0, 1, 0]
    text = spark.createDataFrame([(1, k, t) for k, t in enumerate(["a", "b", "", " ", "c", None, "d"])], "id int, k int, text string")
    assert [r["text"] for r in ordering.paragraphs(text, ["id"], "k").orderBy("paragraph_no").collect()] == ["a b", "c", "d"]
    spans = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 10, 12)], "id int, x1 int, x2 int")
    assert ordering.interval_union(spans, ["id"]).first()["covered"] == 10


def test_shard_audit_and_report(spark):
    ok = lines(("abc", 0, 0, 10, 10), ("مر", 5, 5, 500, 10))
    rows = [("s1", False, ok, 100, 100), ("s1", True, [], 100, 100), ("s2", False, [], 100, 100)]
    df = spark.createDataFrame(rows, f"shard string, failed boolean, lines {LINES}, img_w int, img_h int")
    found = audit.shard_audit(df)
    got = {r["shard"]: r for r in found.collect()}
    assert (got["s1"]["decode_ok"], got["s1"]["render_fail"], got["s2"]["zero_line"], got["s1"]["bbox_inside"], got["s1"]["non_latin_lines"]) == (1, 1, 1, 1, 1)
    assert audit.gate(found) == 1 and "| s1 |" in audit.markdown(found.orderBy("shard"), "Audit")


@pytest.mark.parametrize("wide", [False, True])
def test_global_numbers_of_millions_of_rows(spark, wide):
    n = 3_000_000
    rows = spark.range(n).select(F.xxhash64("id").alias("key"), "id")
    if wide:
        rows = rows.withColumn("text", F.repeat(F.lit("x"), 20))
    placed = serialize.numbered_globally(rows, ["key"], "position")
    blocks = placed.groupBy(F.floor(F.col("position") / 10_000).alias("b")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).orderBy("b").collect()
    assert [(r["b"], r["n"]) for r in blocks] == [(k, 10_000) for k in range(n // 10_000)]
    assert all(a["high"] < b["low"] for a, b in zip(blocks, blocks[1:], strict=False))
    assert placed.select("position").distinct().count() == n
    assert serialize.numbered_globally(rows.limit(0), ["key"], "position").count() == 0


def test_overlapping_boxes_equal_brute_force(spark):
    r = random.Random(5)
    make = lambda n: [(k % 4, k, (x := r.randint(0, 80)), (y := r.randint(0, 200)), x + r.randint(0, 40), y + r.randint(0, 90)) for k in range(n)]
    left, right = make(60), make(50)
    frame = lambda rows, c: spark.createDataFrame(rows, f"page long, {c}k long, x1 int, y1 int, x2 int, y2 int").select("page", f"{c}k", F.struct("x1", "y1", "x2", "y2").alias(c))
    got = {(x["ak"], x["bk"]): x["inter"] for x in detection.overlapping(frame(left, "a"), frame(right, "b"), "page").collect()}
    inter = lambda a, b: max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
    assert got == {(a[1], b[1]): inter(a, b) for a in left for b in right if a[0] == b[0] and inter(a, b) > 0}
