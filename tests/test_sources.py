import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from pageloom.operators import filters
from pageloom.plans import verbs
from pageloom.schema import FLAT_PAGES, LINES, NESTED_PAGES
from pageloom.sources import annotations, cache, corpora, files, manifest, shards, sinks, synth, tar


def make_tar(path, members):
    with tarfile.open(path, "w") as out:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))


def nested(*texts):
    return {"pages": [{"lines": {"text": list(t), "bbox": [[0.1, 0.1, 0.5, 0.1]] * len(t), "score": [0.9] * len(t)}} for t in texts]}


def test_tar_shards(spark, tmp_path):
    a, b = tmp_path / "x-0000.tar", tmp_path / "x-0001.tar"
    make_tar(a, [("k1.json", json.dumps(nested(["one"], ["two", "three"])).encode()), ("k1.pdf", b"%PDF"), ("bad.json", b"{oops"), ("raw.json", b"\xff\xfe")])
    make_tar(b, [("k2.json", json.dumps(nested(["four"])).encode())])
    rows = tar.payloads(spark, [str(a), str(b)], NESTED_PAGES)
    assert rows.count() == 2
    assert sorted(r["text"] for r in shards.line_texts(rows).collect()) == ["four", "one", "three", "two"]
    sizes = spark.createDataFrame([("k1", 0, 100, 200), ("k2", 0, 100, 200), ("k2", 1, 100, 200)], "key string, page_no int, img_w int, img_h int")
    pages = shards.scan(rows, sizes).orderBy("page_id").collect()
    assert [(p["source"], p["lines"][0]["text"], p["lines"][0]["x2"]) for p in pages] == [("pdfa:k1", "one", 60), ("pdfa:k2", "four", 60)]
    both = tar.records(spark, [str(a)], ["json", "pdf"]).filter("pdf is not null").first()
    assert both["key"] == "k1" and bytes(both["pdf"]) == b"%PDF"
    faults = {r["key"]: r["reason"] for r in tar.quarantine(spark, [str(a), str(b)], NESTED_PAGES).collect()}
    assert faults == {"bad": "no JSON of pages", "raw": "not UTF-8"}
    assert tar.complete(tar.records(spark, [str(a)], ["json", "pdf"]), ["json", "pdf"]).count() == 1
    (tmp_path / "x-0002.tar").write_bytes(b.read_bytes()[:560])
    (tmp_path / "x-0003.tar").write_bytes(b"no tar at all" * 100)
    broken = [str(a), str(tmp_path / "x-0002.tar"), str(tmp_path / "x-0003.tar")]
    assert tar.payloads(spark, broken, NESTED_PAGES).count() == 1  # whole shards are read on
    ends = {r["shard"][-8:]: r["reason"] for r in tar.quarantine(spark, broken, NESTED_PAGES).filter("key is null").collect()}
    assert sorted(ends) == ["0002.tar", "0003.tar"] and all("Error" in v for v in ends.values())
    with pytest.raises(Exception, match="missing shards"):
        tar.members(spark, [str(tmp_path / "none.tar")]).count()


def test_flat_pages_keep_scores_and_caps(spark):
    page = {"pages": [{"text": ["keep", "low", ""], "bbox": [[0.1, 0.2, 0.3, 0.05]] * 3, "score": [0.99, 0.2, 0.9]}]}
    rows = spark.createDataFrame([("s", "k", 0, json.dumps(page))], "shard string, key string, member_no int, j string").select("shard", "key", "member_no", F.from_json("j", FLAT_PAGES).alias("payload"))
    sizes = spark.createDataFrame([("k", 0, 1000, 800)], "key string, page_no int, img_w int, img_h int")
    (p,) = shards.scan(rows, sizes, shards.FLAT).collect()
    assert [(x["text"], x["x1"], x["y1"], x["x2"], x["y2"]) for x in p["lines"]] == [("keep", 100, 160, 400, 200)]


def test_paragraphs_in_three_forms(spark):
    line = {"vertices": [[10, 20], [30, 25], [28, 50], [12, 45]], "text": " t ", "legible": True, "handwritten": False, "vertical": False}
    doc = {"paragraphs": [{"lines": [line, line | {"vertical": True}, line | {"text": " "}, line | {"handwritten": True, "text": "h"}, line | {"legible": False}]}]}
    text = spark.createDataFrame([("i", json.dumps(doc), 100, 100)], "image_id string, annotations string, img_w int, img_h int")
    for rows in (text, text.withColumn("annotations", F.col("annotations").cast("binary"))):
        (p,) = annotations.paragraph_pages(rows).collect()
        assert [x["text"] for x in p["lines"]] == ["t", "h"] and p["lines"][0]["y2"] == 50
    assert [x["text"] for x in annotations.paragraph_pages(text, handwritten=False).first()["lines"]] == ["t"]
    assert annotations.paragraph_pages(text, printed=False, min_lines=2).count() == 0


def test_forms(spark):
    xml = '<form><handwritten-part><line text="own" asx="10" asy="20" asw="100" ash="30"/><line text="made"><word><cmp x="5" y="6" width="10" height="4"/><cmp x="20" y="4" width="5" height="9"/></word></line><line text=" "/></handwritten-part></form>'
    forms = spark.createDataFrame([("f0", xml), ("f1", "<form><oops")], "id string, xml string")
    ids = spark.createDataFrame([("f0",), ("f1",), ("f2",)], "id string")
    images = spark.createDataFrame([("f0", 200, 100), ("f1", 200, 100)], "id string, img_w int, img_h int")
    pages, skipped = annotations.form_pages(forms, ids, images)
    (p,) = pages.collect()
    assert [tuple(x) for x in p["lines"]] == [("own", 10, 20, 110, 50), ("made", 5, 4, 25, 13)]
    assert {r["id"] for r in skipped.collect()} >= {"f2"}


def test_language_pages_and_quads(spark):
    doc = lambda lang, lines: json.dumps({"lang": lang, "lines": lines})
    good = [{"text": "a", "bbox": [0, 0, 5, 5]}, {"text": "b", "box": [1, 1, 1, 1]}, {"text": " ", "bbox": [0, 0, 5, 5]}, {"text": "c", "bbox": [0, 0]}]
    rows = spark.createDataFrame([("1", doc("en", good)), ("2", doc("ar", good)), ("3", doc("en+fr", good)), ("4", doc("en", []))], "id string, json string")
    images = spark.createDataFrame([("1", "1.png", ".png", 9, 9), ("1", "1.tif", ".tif", 8, 8), ("3", "3.jpg", ".jpg", 9, 9), ("4", "4.jpg", ".jpg", 9, 9)], "id string, path string, ending string, img_w int, img_h int")
    got = {r["page_id"]: r for r in annotations.language_pages(rows, images).collect()}
    assert set(got) == {"1", "3"} and got["1"]["img_w"] == 8 and [x["text"] for x in got["1"]["lines"]] == ["a", "b"]
    quads = [("10,20,30,15,30,40,5,45,a, b", ("a, b", 5, 15, 30, 45)), ("1,1,1,1,1,1,1,1,flat", None), ("1,2,x,4,5,6,7,8,bad", None), ("1,2,3", None), ("0,0,9,0,9,9,0,9,  ", None)]
    out = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(quads)], "k int, v string").select("k", annotations.quad_line(F.col("v")).alias("q")).orderBy("k").collect()
    assert [None if r["q"] is None else tuple(r["q"]) for r in out] == [w for _, w in quads]


@pytest.mark.parametrize(
    "record, error",
    [
        ('{"image": "a.png", "ref": "x"}', None),
        ('{"image": "a.png", "ref": "x", "version": 1, "bboxes": [[1, 2, 3.7, 4, "t, [u]"]]}', None),
        ("[1]", "not_an_object"),
        ("{bad", "not_an_object"),
        ('{"image": "a", "ref": "x", "version": 1.0}', "version_not_an_integer"),
        ('{"image": "a", "ref": "x", "version": "1"}', "version_not_an_integer"),
        ('{"image": "a", "ref": "x", "version": true}', "version_not_an_integer"),
        ('{"image": "a", "ref": "x", "version": 2}', "version_not_supported"),
        ('{"ref": "x"}', "image_missing"),
        ('{"image": "", "ref": "x"}', "image_missing"),
        ('{"image": "a"}', "ref_missing"),
        ('{"image": "a", "ref": 3}', "ref_missing"),
        ('{"image": "a", "ref": "x", "task": "caption"}', "task_unknown"),
        ('{"image": "a", "ref": "x", "bboxes": 3}', "bboxes_not_a_list"),
        ('{"image": "a", "ref": "x", "bboxes": [[1, 2, 3, 4]]}', "bbox_shape"),
        ('{"image": "a", "ref": "x", "bboxes": [["1", 2, 3, 4, "t"]]}', "bbox_coordinates"),
        ('{"image": "a", "ref": "x", "bboxes": [[1, 2, 3, 4, 5]]}', "bbox_text"),
    ],
)
def test_manifest_errors(spark, record, error):
    row = manifest.parsed(spark.createDataFrame([("f", 3, record)], "file string, line_no int, value string")).first()
    assert row["error"] == error
    if not error:
        assert row["lines"][0]["text"] in ("x", "t, [u]") and (row["lines"][0]["x2"] in (0, 3))


def test_manifest_files(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('# note\n\n{"image": "a", "ref": "x y", "bboxes": [[0, 0, 5, 5, "x \\"q\\""]]}\n{"image": "b", "ref": "z", "task": "ocr"}\n')
    rows = manifest.read(spark, str(path))
    got = rows.orderBy("line_no").collect()
    assert [(r["line_no"], r["image"], r["task"], r["has_boxes"]) for r in got] == [(3, "a", "ocr_layout", True), (4, "b", "ocr", False)]
    assert manifest.write(rows.select("image", "ref", "task", "lines"), str(tmp_path / "out")) == 2
    again = manifest.parsed(manifest.numbered_lines(spark, str(tmp_path / "out"))).orderBy("image").collect()
    assert [r["error"] for r in again] == [None, None] and again[0]["lines"][0]["text"] == 'x "q"'
    with pytest.raises(ValueError):
        manifest.write(rows.select("image", F.lit(None).cast("string").alias("ref"), "lines"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    path.write_text('{"image": "a", "ref": "x"}\n{"image": "a"}\n')
    with pytest.raises(Exception, match="manifest line 2: ref_missing"):
        manifest.read(spark, str(path)).collect()
    good, bad = manifest.lenient(manifest.parsed(manifest.numbered_lines(spark, str(path))))
    assert good.count() == 1 and bad.first()["line_no"] == 2


def test_fields_differ(spark):
    rows = spark.createDataFrame([(1, '{"a":1,"b":2}'), (2, '{"a":1,"c":2}')], "line_no int, value string")
    got = filters.same_fields(rows).orderBy("line_no").collect()
    assert (got[0]["missing"], got[0]["extra"], got[1]["missing"], got[1]["extra"]) == ([], [], ["b"], ["c"])


def test_cache(spark, tmp_path):
    page = spark.createDataFrame([("p1", 200, 100, [("t", 0, 0, 100, 50)])], f"page_id string, img_w int, img_h int, lines {LINES}")
    at = str(tmp_path / "cache")
    assert verbs.cache_pages(page, at, (50, 100)) == 1
    assert verbs.cache_pages(page.unionByName(page.withColumn("page_id", F.lit("p2"))), at, (50, 100)) == 1
    got = cache.read(spark, at).orderBy("page_id").collect()
    assert [r["page_id"] for r in got] == ["p1", "p2"] and got[0]["img_w"] == 100 and tuple(got[0]["lines"][0]) == ("t", 0, 0, 50, 25)
    with pytest.raises(ValueError, match="canvas_w"):
        verbs.cache_pages(page, at, (50, 101))
    with pytest.raises(FileNotFoundError):
        cache.read(spark, str(tmp_path / "none"))


def test_shard_names(tmp_path):
    for k in (0, 1, 2, 10):
        (tmp_path / f"s-{k:04d}.tar").touch()
    name = lambda p: [x.rsplit("/", 1)[1] for x in files.shard_paths(str(tmp_path / p))]
    assert name("s-{0000..0002}.tar") == ["s-0000.tar", "s-0001.tar", "s-0002.tar"]
    assert name("s-{0010..0001}.tar") == ["s-0001.tar", "s-0002.tar", "s-0010.tar"]
    assert len(name("s-*.tar")) == 4
    for n in ("ckpt_2.pt", "ckpt_10.pt", "ckpt_best.pt", "ckpt_1.pt"):
        (tmp_path / n).touch()
    assert files.latest(str(tmp_path)).endswith("ckpt_10.pt") and [p.rsplit("/", 1)[1] for p in files.surplus(str(tmp_path), 1)] == ["ckpt_1.pt", "ckpt_2.pt"]


def test_corpora_and_sinks(spark, tmp_path):
    (tmp_path / "c.txt").write_text("first line\n  second\n\n= head =\n12 34\n")
    assert corpora.sentences(spark, str(tmp_path / "c.txt")).count() == 4
    assert [r["text"] for r in corpora.joined_paragraphs(spark, str(tmp_path / "c.txt")).orderBy("paragraph_no").collect()] == ["first line second", "= head = 12 34"]
    assert corpora.dump_paragraphs(spark, str(tmp_path / "c.txt")).count() == 3
    assert sinks.corpus(corpora.sentences(spark, str(tmp_path / "c.txt")), str(tmp_path / "kept")) == (3, 1)
    assert len(corpora.provenance(spark, str(tmp_path / "c.txt")).first()["sha"]) == 64
    assert sinks.sidecar(spark.createDataFrame([(1, None)], "a int, b int")) == {"a": 1}


def test_synthetic_pages(spark):
    a, b = synth.receipts(spark, 5, 1).orderBy("page_id").collect(), synth.receipts(spark, 5, 1).orderBy("page_id").collect()
    assert a == b and a != synth.receipts(spark, 5, 2).orderBy("page_id").collect()
    for p in a:
        tail = {x["text"].split()[0]: round(float(x["text"].split()[-1]) * 100) for x in p["lines"][-3:]}
        assert tail["TOTAL"] == tail["SUBTOTAL"] + tail["TAX"]
    hand = synth.handwritten(spark, 20, ["a fairly long sentence of a good many words to be cut somewhere at a space"], 0).collect()
    assert all(1 <= len(p["lines"]) <= 12 and all(len(x["text"]) <= 60 for x in p["lines"]) for p in hand)
    texts = spark.createDataFrame([(1, "aa bbb " * 30), (2, ""), (3, None)], "id int, text string")
    (p,) = synth.paged_text(texts, 164, 10_000).collect()
    assert " ".join(x["text"] for x in p["lines"]).split() == ("aa bbb " * 30).split() and max(len(x["text"]) for x in p["lines"]) <= 12
    assert all(len(r["lines"]) <= len(p["lines"]) for r in synth.turned(synth.paged_text(texts, 164, 10_000)).collect())


def test_evaluate(spark):
    page = [("a b", 0, 0, 100, 20), ("c", 0, 30, 50, 50)]
    m = spark.createDataFrame([("i1", "ignored", page, True, 200, 100), ("i2", "x", [("x", 0, 0, 0, 0)], False, 200, 100)], f"image string, ref string, lines {LINES}, has_boxes boolean, img_w int, img_h int")
    pred = spark.createDataFrame([("i1", page)], f"image string, lines {LINES}")
    total, docs = verbs.evaluate(m, pred)
    s = total.first()
    assert s["deteval_f1"] == 1.0 and s["ap_80"] == 1.0 and s["n_empty"] == 1 and s["cer"] == pytest.approx(1 / 6) and s["tp"] == 3 and s["fn"] == 1
    assert {r["image"]: r["cer"] for r in docs.collect()} == {"i1": 0.0, "i2": 1.0}
    targets = verbs.training_targets({"a": (1.0, m.select(F.col("image").alias("page_id"), "lines", "img_w", "img_h", F.lit("ocr").alias("task"), F.lit(None).cast("string").alias("query_text"), F.expr("cast(null as struct<x1: int, y1: int, x2: int, y2: int>)").alias("query_bbox"), F.expr("cast(map() as map<string, string>)").alias("meta"))), "b": (0.0, None)}, {"ocr": 1.0})
    assert {r["page_id"]: r["tokens"][1] for r in targets.collect()} == {"i1": "<task=ocr>", "i2": "<task=ocr>"}


def test_tar_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k % 3}.tar", f"k{k:02d}", e, f"{k}{e}".encode()) for k in range(10) for e in ("json", "bin")], "shard string, key string, ext string, content binary")
    made = tar.write(rows, str(tmp_path / "out"))
    assert sorted(r["n_members"] for r in made.collect()) == [6, 6, 8]
    back = tar.members(spark, [r["shard"] for r in made.collect()]).select("key", "ext", "content").collect()
    assert sorted((r["key"], r["ext"], bytes(r["content"])) for r in back) == sorted((r["key"], r["ext"], bytes(r["content"])) for r in rows.collect())
    assert tar.write(rows.limit(0), str(tmp_path / "none")).count() == 0
