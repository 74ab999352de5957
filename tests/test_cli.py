import io
import json
import tarfile

from pageloom.__main__ import main
from pageloom.schema import LINES


def test_eval(spark, tmp_path, capsys):
    (tmp_path / "m.jsonl").write_text('{"image": "a", "ref": "x y", "bboxes": [[0, 0, 50, 10, "x y"]]}\n')
    spark.createDataFrame([("a", [("x z", 0, 0, 50, 10)], 100, 100)], f"image string, lines {LINES}, img_w int, img_h int").write.parquet(str(tmp_path / "p"))
    assert main(["eval", str(tmp_path / "m.jsonl"), str(tmp_path / "p"), "--out", str(tmp_path / "docs")]) == 0
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert found["deteval_f1"] == 1.0 and abs(found["cer"] - 1 / 3) < 1e-9
    assert spark.read.json(str(tmp_path / "docs")).first()["hyp"] == "x z"


def test_events_and_audit(spark, tmp_path, capsys):
    (tmp_path / "run.log").write_text("STAGE 1: x\nnoise\nALL STAGES DONE\n")
    assert main(["events", str(tmp_path / "run.log"), str(tmp_path / "out")]) == 0
    assert sorted(r["event"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["chain_done", "stage_header"]
    page = json.dumps({"pages": [{"lines": {"text": ["abc"], "bbox": [[0.1, 0.1, 0.5, 0.1]], "score": [0.9]}}]}).encode()
    with tarfile.open(tmp_path / "s-0000.tar", "w") as out:
        info = tarfile.TarInfo("k.json")
        info.size = len(page)
        out.addfile(info, io.BytesIO(page))
    assert main(["audit", str(tmp_path / "s-{0000..0003}.tar")]) == 0
    assert "| 3.0000 | 3 | 3 |" in capsys.readouterr().out
