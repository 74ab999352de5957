import json
import os

import pytest

from pageloom.operators import ordering
from pageloom.streaming import early_stop, telemetry

LOG = """STAGE 1: go
step=10 loss=1.5 text=1.0 loc=2.0 lr=1e-4
step=11 loss=nan text=1.0 loc=2.0 lr=1e-4
step=12 loss=1.4 text=1.0 loc=2.0 lr=1e-4
noise
STAGE 2: go
validation step=6000 val_loss=2.0 cer=0.5 wer=0.6 word-f1=0.1 decoded=4 empty=4
validation step=6001 val_loss=2.0 cer=0.5 wer=0.6 word-f1=0.1 decoded=4 empty=4
validation step=6002 val_loss=2.0
validation step=6003 val_loss=2.0 cer=0.5 wer=0.6 word-f1=0.1 decoded=4 empty=4
Checkpoint saved: /x/ckpt_5.pt (step 5, loss 1)
DONE: 100 steps, 12.5s (0.125s/step). Loss first=3.0 last=1.0 delta=-2.0
supervisor: chain exited with code 1
supervisor: chain exited with code 2
supervisor: chain exited with code 2
CUDA out of memory here
Traceback (most recent call last):
STAGE 1b: not a header
STAGE 2: again
ALL STAGES DONE""".split("\n")


def log(spark, names=("a",)):
    rows = [(n, k, 1000.0 + 200 * k, x) for n in names for k, x in enumerate(LOG)]
    return spark.createDataFrame(rows, "log string, seq long, ts double, line string")


def test_events(spark):
    got = telemetry.events(log(spark)).orderBy("seq", "sub").collect()
    kinds = [r["event"] for r in got]
    assert kinds == ["stage_header", "train_step", "train_step", "nan_loss", "train_step", "step_rate_low", "stage_header", "val", "val", "val", "empty_decode_streak", "val", "checkpoint", "stage_summary", "supervisor_restart", "supervisor_restart", "supervisor_restart", "oom", "traceback", "stage_header", "chain_done"]
    at = {r["event"]: r for r in got}
    assert at["step_rate_low"]["rate"] == pytest.approx(2 / 400, abs=1e-4) and at["step_rate_low"]["window_s"] == 400.0
    assert at["empty_decode_streak"]["streak"] == 3 and at["empty_decode_streak"]["step"] == 6003
    assert at["supervisor_restart"]["restart_streak"] == 3 and at["supervisor_restart"]["alert"] is True
    assert at["stage_summary"]["loss_delta"] == -2.0 and at["checkpoint"]["step"] == 5
    assert [r["attempt"] for r in got][-2:] == [2, 2] and at["oom"]["snippet"].startswith("CUDA")
    assert got[2]["loss"] is None  # what isn't a number comes out as null
    assert telemetry.scalars(telemetry.events(log(spark))).filter("tag = 'train/loss'").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = log(spark, ("a", "b"))
    source = tmp_path / "in"
    source.mkdir()
    everything = [r.asDict() for r in rows.collect()]
    for part in range(3):  # three files, three micro-batches
        own = [r for r in everything if r["seq"] * 3 // len(LOG) == part]
        (source / f"{part}.json").write_text("\n".join(json.dumps(r) for r in own))
        os.utime(source / f"{part}.json", (1_700_000_000 + part * 60,) * 2)  # read in order of their times
    stream = spark.readStream.schema("log string, seq long, ts double, line string").option("maxFilesPerTrigger", 1).json(str(source))
    made = telemetry.stream_events(stream)
    made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(spark.read.schema(telemetry.OUTPUT).parquet(str(tmp_path / "out"))) == key(telemetry.events(rows))


def run(values, **rule):
    p, r = early_stop.Progress(), early_stop.Rule(**rule)
    return [early_stop.decide(p, v, r) for v in values]


def test_early_stop():
    assert run([k / 100 * 3 for k in range(40)]) == [None] * 40
    flat = run([0.5] * 20)
    assert flat.index("patience_exceeded") == 10
    assert run([5.0] * 6 + [9.0] * 3, higher_is_better=False, patience=99)[-1] == "spike_detected"
    assert run([0.5] * 5, patience=1) == [None] * 5
    p = early_stop.Progress()
    for v in (0.1, 0.2, 0.3):
        early_stop.decide(p, v, early_stop.Rule())
    assert early_stop.Progress.restored(json.loads(json.dumps(p.saved()))) == p


def test_folds(spark):
    rows = spark.createDataFrame([("r", k, v) for k, v in enumerate([0.1, 0.2, 0.2, 0.2])], "run string, step long, value double")
    got = early_stop.decisions(rows, early_stop.Rule(window=1, patience=2, warmup=0)).orderBy("step").collect()
    assert [r["reason"] for r in got] == [None, None, None, "patience_exceeded"]
    ema = rows.select("step", ordering.tail_ema("value", ["run"], ["step"], 3).alias("e")).orderBy("step").collect()
    assert ema[1]["e"] == pytest.approx(2 / 3 * 0.2 + 1 / 3 * 0.1)
    picks = spark.createDataFrame([("r", 1, 0.5, 0.4), ("r", 2, 0.3, None), ("r", 3, 0.6, 0.35), ("r", 4, 0.7, 0.6)], "run string, step long, gate double, truth double")
    got = early_stop.selections(picks).orderBy("step").collect()
    assert [(r["passed"], r["accepted"], r["best"]) for r in got] == [(True, True, 0.4), (False, False, 0.4), (True, False, 0.4), (True, True, 0.6)]


def test_values_that_are_no_numbers_dont_improve(spark):
    nan = float("nan")
    values = [0.1, 0.2, 0.3] + [nan] * 17
    rows = spark.createDataFrame([("r", k, v) for k, v in enumerate(values)] + [("r", 99, None)], "run string, step long, value double")
    got = early_stop.decisions(rows).orderBy("step").collect()
    assert len(got) == 20 and got[-1]["waited"] == 17 and got[-1]["spiked"] == 0
    assert [r["reason"] for r in got].index("patience_exceeded") == 12


def test_runs_go_on_from_a_saved_state(spark):
    values = [0.1, 0.5, 0.4, 0.4, 0.4, 0.4, 0.4]
    rows = spark.createDataFrame([("r", k, v) for k, v in enumerate(values)], "run string, step long, value double")
    rule, p = early_stop.Rule(patience=3, warmup=2), early_stop.Progress()
    whole = [tuple(r) for r in early_stop.decisions(rows, rule).orderBy("step").collect()]
    for v in values[:3]:
        early_stop.decide(p, v, rule)
    assert [tuple(r) for r in early_stop.decisions(rows.filter("step >= 3"), rule, saved={"r": p.saved()}).orderBy("step").collect()] == whole[3:]


def test_times_of_lines(spark):
    lines = ["begin", "[2024-05-01 10:00:00,500] step=1 loss=1.0 text=1.0 loc=2.0 lr=1e-4", "step=2 loss=1.0 text=1.0 loc=2.0 lr=1e-4", "2024-05-01T11:00:00 step=3 loss=1.0 text=1.0 loc=2.0 lr=1e-4"]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(lines)], "log string, seq long, line string")
    ts = [r["ts"] for r in telemetry.timed(df, 2.0).orderBy("seq").collect()]
    assert ts[0] == 0.0 and ts[2] - ts[1] == 2.0 and ts[3] - ts[1] == 3599.5
    assert "step_rate_low" in [r["event"] for r in telemetry.events(telemetry.timed(df)).collect()]
