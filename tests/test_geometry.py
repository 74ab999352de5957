import pytest
from pyspark.sql import functions as F

from pageloom.functions import geometry as g


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first()["v"]


def box(*v):
    return g.box(*[F.lit(x) for x in v])


def tup(r):
    return None if r is None else (r["x1"], r["y1"], r["x2"], r["y2"])


def test_iou_and_areas(value):
    assert value(g.iou(box(0, 0, 10, 10), box(5, 5, 15, 15))) == pytest.approx(25 / 175)
    assert value(g.iou(box(0, 0, 0, 10), box(0, 0, 10, 10))) == 0.0
    assert value(g.intersection(box(0, 0, 10, 10), box(10, 0, 20, 10))) == 0
    assert value(g.safe_area(box(10, 0, 5, 10))) == 0


def test_wire_boxes(value):
    wire = lambda *v: g.wire_box(F.array(*[F.lit(float(x)) for x in v]), F.lit(1000), F.lit(800))
    assert tup(value(wire(0.1, 0.2, 0.3, 0.05))) == (100, 160, 400, 200)
    assert value(wire(0.1, 0.2, 0.0, 0.05)) is None
    assert value(wire(0.1, 0.2, 0.3)) is None
    assert value(wire(0.1, 0.2, 0.0001, 0.05)) is None
    assert tup(value(g.denormalised(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0), F.lit(50), F.lit(40)))) == (0, 0, 50, 40)


def test_half_even_and_padding(value):
    assert tup(value(g.scaled(box(1, 1, 5, 5), 0.5, 0.5))) == (0, 0, 2, 2)
    assert tup(value(g.expanded(box(10, 20, 100, 50), 2))) == (8, 18, 102, 52)
    assert tup(value(g.expanded(box(10, 20, 100, 50), -2))) == (12, 22, 98, 48)
    assert tup(value(g.padded(box(10, 20, 100, 50), 2))) == (8, 18, 102, 52)
    with pytest.raises(Exception, match="inverted"):
        value(g.padded(box(0, 0, 2, 2), -5))


def test_polygons_and_rotation(value):
    xs, ys = F.array(*map(F.lit, (10.0, 30.0, 28.0, 12.0))), F.array(*map(F.lit, (20.0, 25.0, 50.0, 45.0)))
    assert tup(value(g.quad_box(xs, ys))) == (10, 20, 30, 50)
    assert value(g.quad_box(F.slice(xs, 1, 2), F.slice(ys, 1, 2))) is None
    assert tup(value(g.rotated(box(10, 10, 20, 20), F.lit(0.0), F.lit(50), F.lit(50)))) == (10, 10, 20, 20)
    r = tup(value(g.rotated(box(10, 40, 90, 60), F.lit(90.0), F.lit(50), F.lit(50))))
    assert r[2] - r[0] in (19, 20, 21) and r[3] - r[1] in (79, 80, 81)


def test_clip_fit_crop_contains(value):
    assert tup(value(g.clipped(box(-5, -5, 500, 500), F.lit(100), F.lit(50)))) == (0, 0, 100, 50)
    assert value(g.fit_size(F.lit(2000), F.lit(1000), F.lit(1000), F.lit(1000)))["w"] == 1000
    assert value(g.fit_scale(F.lit(10), F.lit(10), F.lit(1000), F.lit(1000))) == 1.0
    assert tup(value(g.line_crop(box(10, 10, 60, 30), F.lit(100), F.lit(100)))["box"]) == (0, 0, 58, 28)
    assert value(g.line_crop(box(10, 10, 60, 15), F.lit(100), F.lit(100))) is None
    assert value(g.contains(box(0, 0, 10, 10), box(0, 0, 10, 10))) is True
    assert value(g.contains(box(0, 0, 10, 10), box(0, 0, 11, 10))) is False


def test_grid(value):
    assert value(g.axis_token(F.lit(-3), "x", 10, 5)) == "<x_0>"
    assert value(g.axis_token(F.lit(999), "y", 10, 5)) == "<y_4>"
    assert value(g.token_px(F.lit("<xy_12>"), 10)) == 120
    assert value(g.grid_tokens(25, 15, 10)) == ["<x_0>", "<x_1>", "<x_2>", "<y_0>", "<y_1>"]
    assert value(g.grid_tokens(25, 15, 10, True)) == ["<xy_0>", "<xy_1>", "<xy_2>"]


def test_presets():
    assert g.page_preset() == g.PAGE_PRESETS["medium"]
    assert g.page_preset("auto") == g.PAGE_PRESETS["tiny"]
    assert g.page_preset("auto", 79.4) == g.PAGE_PRESETS["paper"]
    with pytest.raises(ValueError):
        g.page_preset("huge")
